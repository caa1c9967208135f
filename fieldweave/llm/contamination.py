"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, partition p holding sizes in (u/2, u].
For a partition a document is cut into overlapping stretches of 2u shingles, u apart, so an
item's occurrence lies in one of them and the Jaccard similarity of item and stretch cannot
be small, however long the document. Items and stretches meet in any of ``BANDS`` MinHash
values (bands of one row). A document that met an item is verified on the spot: it is
contaminated if it holds PERCENT of the item's distinct shingles.

An item of fewer than five words is one shingle of its own length and is looked up among
the document's shingles of that length. Items travel to the tasks in blocks of about
``ITEM_BLOCK`` items and ``BLOCK_BYTES`` of text, one block at a time: its results are written
and it is given up before the next one is made. Documents are read once for a block, and a
Python worker builds a block's tables once for all of its tasks.

Defined results: null or wordless texts and items contain nothing and are in nothing; rows
that repeat a doc_id or item_id give a pair once, with the counts of the text that is
contained best; a null doc_id or item_id is a value like others; ``decontaminate`` goes by
texts, so neither nulls nor repeated ids save a row; empty tables give no pairs; further
columns are not read. Case A-Z is ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, small
from .shingles import WIDE, K, chunks, common, shingle_hashes, shingle_sets, stream, word_hashes

#: Shared shingles that make an item contained, of a hundred.
PERCENT = 75
#: MinHash values of an item. At the least similarity of a whole item to its stretch, 1/4,
#: 40 values miss one in 100,000; at that of three quarters of one, 3/17, one in 2,300.
BANDS = 40
ITEM_BLOCK, BLOCK_BYTES = 50_000, 32 << 20

_U = np.uint64
_FACTORS = stream(11, BANDS)
_SLOTS = 1 << 16


class Items:
    """A block of items: their sets, and their MinHash values by size partition."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        texts = [t for _, t in rows]
        n_words = []
        for _, raws in chunks(texts):
            _, at = word_hashes(raws)
            n_words += np.diff(at).tolist()
        self.sets = [s for _, s in shingle_sets(texts)]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        short: dict[int, list[int]] = {}
        sized: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if not len(s):
                continue
            if n_words[k] < K:
                short.setdefault(n_words[k], []).append(k)
            else:
                sized.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        for m, ks in short.items():
            values = np.array([self.sets[k][0] for k in ks], _U)
            order = np.argsort(values)
            self.short[m] = values[order], np.array(ks)[order]
        for u, ks in sized.items():
            least = np.stack([[(self.sets[k] * f).min() for f in _FACTORS] for k in ks]).astype(_U)
            tables = []
            for j in range(BANDS):
                order = np.argsort(least[:, j], kind="stable")
                slots = np.zeros(_SLOTS, bool)
                slots[(least[:, j] & _U(_SLOTS - 1)).astype(np.int64)] = True
                tables.append((least[order, j], np.array(ks)[order], slots))
            self.partitions[u] = tables


def _lookup(values: np.ndarray, table: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int]]:
    """(index in values, item) of every equal pair; ``table`` is ascending, with repeats."""
    lo, hi = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    for i in np.flatnonzero(hi > lo):
        for k in range(lo[i], hi[i]):
            yield int(i), int(items[k])


def _stretches(sizes: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the pieces of u shingles in the joined runs of ``sizes``, each piece's
    document, and whether the next piece is of the same document."""
    pieces = -(-sizes // u)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + within * u
    return starts, doc, np.concatenate([doc[1:] == doc[:-1], [False]])


def _met(run: np.ndarray, sizes: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(document, item) pairs that share a MinHash value in some stretch."""
    out: set[tuple[int, int]] = set()
    if not len(run):
        return out
    cuts = {u: _stretches(sizes, u) for u in items.partitions}
    for j in range(BANDS):
        with np.errstate(over="ignore"):
            values = run * _FACTORS[j]
        for u, tables in items.partitions.items():
            starts, doc, joined = cuts[u]
            least = np.minimum.reduceat(values, starts)
            least = np.where(joined, np.minimum(least, np.concatenate([least[1:], least[:1]])), least)
            table, ks, slots = tables[j]
            at = np.flatnonzero(slots[(least & _U(_SLOTS - 1)).astype(np.int64)])
            out.update((int(doc[at[i]]), k) for i, k in _lookup(least[at], table, ks))
    return out


def _pairs(texts: list[str | None], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text's index, item's index, shared shingles, item's shingles) of contained items."""
    for first, raws in chunks(texts, WIDE):
        words, at = word_hashes(raws)
        n_words = np.diff(at)
        for m, (table, ks) in items.short.items():
            found = set()
            run = shingle_hashes(words, m)
            if len(words) >= m:
                for i, k in _lookup(run, table, ks):
                    d = int(np.searchsorted(at, i, "right")) - 1
                    if i + m <= at[d + 1]:
                        found.add((d, k))
            yield from ((first + d, k, 1, 1) for d, k in sorted(found))
        if not items.partitions or len(words) < K:
            continue
        joint = shingle_hashes(words, K)
        sizes = np.maximum(n_words - K + 1, 0)
        valid = np.repeat(at[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        run = joint[valid]
        ends = np.cumsum(sizes)
        whole: dict[int, np.ndarray] = {}
        for d, k in sorted(_met(run, sizes, items)):
            if d not in whole:
                whole = {d: np.unique(run[ends[d] - sizes[d] : ends[d]])}
            shared, n = common(items.sets[k], whole[d]), len(items.sets[k])
            if 100 * shared >= PERCENT * n:
                yield first + d, k, shared, n


_built: dict[str, Items] = {}


def _items(name: str, block: Broadcast) -> Items:
    """The tables of a block, which the worker keeps until it meets another block."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(block.value)
    return _built[name]


def _search(name: str, block: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _items(name, block)
        for batch in batches:
            ids = batch[["k1", "k2"]]
            rows = [(i, items.ids[k], shared, n) for i, k, shared, n in _pairs(batch["text"].tolist(), items)]
            found = pd.DataFrame(rows, columns=["row", "item_id", "n_shared", "n_item"]).astype({"item_id": "Int64"})
            yield pd.concat([ids.iloc[found.pop("row").to_numpy(np.int64)].reset_index(drop=True), found], axis=1)

    return run


def _found(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, item_id, n_shared, n_item) of ``docs`` (k1, k2, text) and the items in them."""
    spark, out = docs.sparkSession, None
    wanted = scratch.keep(items.where("text is not null").distinct().withColumn("h", F.xxhash64("item_id", "text")), "items")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n // ITEM_BLOCK), -(-size // BLOCK_BYTES))
    for b in range(n_blocks):
        rows = [(r[0], r[1]) for r in wanted.where(F.pmod("h", F.lit(n_blocks)) == b).select("item_id", "text").toLocalIterator()]
        block = spark.sparkContext.broadcast(rows)
        hits = docs.mapInPandas(_search(uuid.uuid4().hex, block), "k1 long, k2 long, item_id long, n_shared long, n_item long")
        hits = scratch.keep(hits, "hits")
        block.destroy()
        out = hits if out is None else out.union(hits)
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    scratch = Scratch(docs.sparkSession, "contamination")
    # A null would make the ids of its batch floats, which 64-bit ids do not survive.
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"), F.col("doc_id").isNull().cast("long").alias("k2"), "text")
    found = _found(keyed, benchmark.select("item_id", "text"), scratch)
    best = F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")
    pairs = found.groupBy("k1", "k2", "item_id").agg(F.max(best).alias("b"))
    return pairs.select(F.when(F.col("k2") == 0, F.col("k1")).alias("doc_id"), "item_id", "b.n_shared", "b.n_item", "b.containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item. Texts are known by 128
    bits of hash, so a row needs no id."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    text = F.coalesce("text", F.lit(""))
    keys = {"__text_h1": F.xxhash64(text), "__text_h2": F.xxhash64(F.lit("second"), text)}
    keyed = docs.select(*[e.alias(k) for k, e in zip(("k1", "k2"), keys.values(), strict=True)], "text")
    found = _found(keyed, benchmark.select("item_id", "text"), scratch)
    hit = scratch.keep(found.select(F.col("k1").alias("__text_h1"), F.col("k2").alias("__text_h2")).distinct(), "hit")
    scratch.close(hit)
    return docs.withColumns(keys).join(small(hit, hit.count()), list(keys), "left_anti").select(*docs.columns)
