"""Jaccard join of documents on 5-word shingles, as a blocked sparse product.

The document by n-gram incidence matrix is multiplied with its transpose, block by block
of n-grams (rows dealt by n-gram hash). Size-derived bounds discard most of it unseen:

* a link needs an overlap of at least ceil(t n) for either size n, so two linked documents
  share an n-gram among the first n - ceil(t n) + 1 of each under any one global order;
  only those rows of the matrix enter the product. The order puts n-grams that many
  documents hold last (by log2 of their counted documents), so widespread passages stay out;
* sizes must satisfy min >= t max.

A block of an n-gram multiplies each row with the block's pivot only, which accumulates
counts for (pivot, document) pairs: linear in the block. Each document is compared with
its best pivot, links join into components, and in some rounds new pivots are drawn. The
blocks that then still hold several components give the pairs across them; a pair whose
remaining n-grams could no longer reach the overlap of a link is discarded, the others are
compared too, but those whose 1024-bit sketches differ in more bits than the sets of a link
can (exact as well). Pairs inside a component need no comparison, so large groups of copies never
expand into pairs, and no link between components is lost.

Documents with equal shingle sets form a class known by its least doc_id; the join runs
over classes, and copies follow their class.

Defined results: null or wordless texts have no shingles, component_id is the doc_id;
fewer than five words are one shingle; rows that repeat a doc_id count as copies of it; a
row with a null doc_id is beside the join, each one by itself: it has n_shingles, but null
component_id and class_id, and ``one_of_each`` keeps it; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import PERCENT, blocks, linked_components
from ..sources.shared import Scratch, small
from .shingles import common, mix, shingle_sets
from .slices import map_slices

#: Documents that make an n-gram widespread, and the most such n-grams that are ordered by
#: count (the rest go by hash: the order is a matter of speed, any order gives all links).
HOT_DOCS, HOT_MOST = 8, 1_000_000
#: Words of 64 bits in a document's sketch.
SKETCH = [f"sketch_{i}" for i in range(16)]
#: n-grams that are counted together in a task.
COUNT_CHUNK = 1 << 20

_U = np.uint64


def need(n: int) -> int:
    return -(-PERCENT * n // 100)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U))
        b = int(mix(s + _U(0x5851F42D4C957F2D)).sum(dtype=_U))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and fingerprint of each document's set, and the n-grams frequent in the task's
    chunks: one that many documents hold stands out in some chunk."""
    held, n_held, seen = [], 0, set()
    columns = ["doc_id", "n", "fa", "fb", "gram", "docs"]

    def frequent() -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 2
        out = pd.DataFrame({"gram": values[often].view(np.int64), "docs": counts[often].astype(np.int64)})
        return out.reindex(columns=columns)

    for batch in batches:
        rows = []
        for i, s in shingle_sets(batch["text"].tolist()):
            fa, fb = _fingerprint(s) if len(s) else (None, None)
            rows.append((len(s), fa, fb))
            if len(s) and fa not in seen:
                seen.add(fa)
                held.append(s)
                n_held += len(s)
                if n_held >= COUNT_CHUNK:
                    yield frequent()
                    held, n_held, seen = [], 0, set()
        out = pd.DataFrame(rows, columns=["n", "fa", "fb"], dtype="Int64").assign(doc_id=batch["doc_id"].to_numpy())
        yield out.reindex(columns=columns)
    if held:
        yield frequent()


SURVEY = "doc_id long, n long, fa long, fb long, gram long, docs long"


def ordered_prefix(s: np.ndarray, grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - need(n) + 1 values of ``s`` (ascending) in the global order."""
    take = len(s) - need(len(s)) + 1
    if len(grams):
        at = np.searchsorted(grams, s)
        at[at == len(grams)] = 0
        rank = np.where(grams[at] == s, ranks[at], 0)
        if rank.any():
            s = s[np.lexsort((s, rank))]
    return s[:take]


def _prefixes(hot: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, ranks = hot.value
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            docs, sizes, rows, n_rows = [], [], [], 0
            for i, s in shingle_sets(texts):
                if not len(s):
                    continue
                p = ordered_prefix(s, grams, ranks)
                rows.append(p)
                docs.append((ids[i], len(s), len(p)))
                n_rows += len(p)
                if n_rows >= 200_000:
                    yield _frame(docs, rows)
                    docs, rows, n_rows = [], [], 0
            if rows:
                yield _frame(docs, rows)

    return run


def _frame(docs: list, rows: list) -> pd.DataFrame:
    d = np.array(docs, dtype=np.int64)
    return pd.DataFrame({"key": np.concatenate(rows).view(np.int64), "node": np.repeat(d[:, 0], d[:, 2]), "n": np.repeat(d[:, 1], d[:, 2]).astype(np.int32), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in d[:, 2]])})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's n-grams, whole (64 bits) and cut to their low 16 bits, and a sketch:
    one bit for each slot that an n-gram falls into by its highest bits."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        out = [(ids[i], np.sort(s.astype(np.uint16)).tobytes(), s.tobytes(), *sketch(s)) for i, s in shingle_sets(batch["text"].tolist())]
        yield pd.DataFrame(out, columns=["node", "low", "grams", *SKETCH])


def sketch(s: np.ndarray) -> list[int]:
    """The set's bits, as the longs of ``SKETCH``."""
    slots = 64 * len(SKETCH)
    bits = np.zeros(slots, dtype=bool)
    bits[(s >> _U(64 - (slots.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def at_most(a: np.ndarray, b: np.ndarray) -> int:
    """No overlap of the sets that ``a`` and ``b`` (ascending, with repeats) were cut from is
    larger: equal n-grams have equal low bits."""
    va, na = np.unique(a, return_counts=True)
    vb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum())


def _overlaps(dtype: type) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    count = common if dtype is _U else at_most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
                s, t = np.frombuffer(x, dtype), np.frombuffer(y, dtype)
                both = count(s, t)
                rows.append((a, b, 100 * both >= PERCENT * (len(s) + len(t) - both)))
            yield pd.DataFrame(rows, columns=["a", "b", "linked"])

    return run


def enough(keys: Column, n: Column, m: Column) -> Column:
    """Whether documents of ``n`` and ``m`` n-grams that share ``keys`` of their prefixes can
    be linked. Up to where the first of the prefixes ends all common n-grams are counted,
    and after it that document has need - 1 left; a link takes PERCENT of the union."""
    need = F.ceil(F.greatest(n, m) * F.lit(PERCENT) / F.lit(100))
    return F.lit(100 + PERCENT) * (keys + need - 1) >= F.lit(PERCENT) * (n + m)


def _compare(pairs: DataFrame, sets: DataFrame, column: str, dtype: type) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, from the overlap of their sets in ``column``."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = sets.select("node", column).join(small(involved, 2 * pairs.count()), "node", "left_semi")
    x = own.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = own.select(F.col("node").alias("b"), F.col(column).alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return map_slices(both, _overlaps(dtype), "a long, b long, linked boolean")


def _verify(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs`` (a, b) with ``linked``. Sets of 16-bit n-grams, a quarter of the bytes, bound
    the overlap from above and settle most pairs; whole sets settle the rest."""
    bound = scratch.keep(_compare(pairs, sets, "low", np.uint16), "bound")
    near = scratch.keep(bound.where("linked").select("a", "b"), "near")
    return bound.where("NOT linked").unionByName(_compare(near, sets, "grams", _U))


def jaccard_components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every document."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    # A null would make the ids of its slice floats.
    unnamed = docs.where("doc_id IS NULL").select(F.lit(0).cast("long").alias("doc_id"), "text")
    unnamed = map_slices(unnamed, _survey, SURVEY).where("gram is null")

    survey = scratch.keep(map_slices(texts, _survey, SURVEY), "survey")
    sized = survey.where("gram is null").select("doc_id", "n", "fa", "fb")
    # Written, so that the join below is of two plain shuffles and a large class is split.
    classes = scratch.keep(sized.where("n > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("class_id")), "classes")
    members = scratch.keep(
        sized.join(classes, ["fa", "fb"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "members"
    )
    hot = (
        survey.where("gram is not null").groupBy("gram").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= HOT_DOCS)
        .orderBy(F.col("docs").desc(), "gram").limit(HOT_MOST).select("gram", F.floor(F.log2("docs")).cast("long").alias("rank")).toPandas()
    )
    grams = hot["gram"].to_numpy(np.int64).view(_U)
    order = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[order], hot["rank"].to_numpy(np.int64)[order]))

    # The product's rows: one text of each class, dealt by n-gram.
    distinct = members.where("n > 0 and doc_id <> class_id").select("doc_id").distinct()
    copies = small(distinct, distinct.count())
    rows = map_slices(texts.join(copies, "doc_id", "left_anti"), _prefixes(frequent), "key long, node long, n int, pos int")
    shared = blocks(rows, scratch)

    # The sets of all documents that share a block, made once for all comparisons.
    involved = scratch.keep(shared.select(F.col("node").alias("doc_id")).distinct(), "involved")
    n = involved.count()
    schema = "node long, low binary, grams binary, " + ", ".join(f"{c} long" for c in SKETCH)
    sets = scratch.keep(map_slices(texts.join(small(involved, n), "doc_id", "left_semi"), _sets, schema), "sets")
    if sets.count() > n:  # rows that repeat a doc_id
        sets = scratch.keep(sets.groupBy("node").agg(F.min_by(F.struct("low", "grams", *SKETCH), "grams").alias("s")).select("node", "s.*"), "sets")
    found = linked_components(shared, lambda pairs: _verify(pairs, sets, scratch), scratch, enough, sets.select("node", *SKETCH))
    scratch.close(members, found)
    frequent.destroy()
    named = (
        members.join(found, F.col("class_id") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    )
    none = F.lit(None).cast("long")
    return named.unionByName(unnamed.select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id"), none.alias("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the least doc_id of each component only, and one row of a repeated one;
    rows with a null doc_id all stay."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    first = jaccard_components(docs, scratch).where("doc_id = component_id").select("doc_id")
    kept = scratch.keep(first, "kept")
    scratch.close(kept)
    n, n_ids = kept.agg(F.count("*"), F.countDistinct("doc_id")).first()
    ids = kept.distinct() if n > n_ids else kept
    out = docs.join(small(ids, n_ids), "doc_id", "left_semi").select(docs.columns)
    out = out.dropDuplicates(["doc_id"]) if n > n_ids else out
    return out.unionByName(docs.where("doc_id IS NULL"))


def digest(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
