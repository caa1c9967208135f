"""Repeated passages, by MinHash banding over content-defined paragraphs.

A passage that is pasted into the middle of a line shares no line with its source, so a
paragraph here is a run of words cut where the words themselves say so: at positions whose
two-word hash is the least of some ``WINDOW`` consecutive ones. A repeated passage of
more than twice that many words is cut alike in every document, at most WINDOW words
from either end. Paragraphs of at least ``MIN_WORDS`` words get MinHash bands, tuned to
the least number that reaches the wanted recall at the similarity of a link. Paragraphs
that collide in a band are compared by exact Jaccard similarity of their shingle sets
(equal sets are one node from the start), links join into clusters, and in each cluster
all paragraphs but those of its least doc_id are removals. Neighbouring paragraphs of a
document make a run; runs under ``MIN_RUN`` words are short common lines and stay.

Defined results: null, empty and short texts have no paragraphs; repeated rows count as one
document (doc_id is its key); rows with a null doc_id take no part: no row could name them,
and nothing of them is removed; a paragraph repeated inside one document only is left alone;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .linking import PERCENT, linked_components, packed_blocks
from ..sources.shared import Scratch, small
from .shingles import K, chunks, common, mix, shingle_hashes, stream, word_hashes
from .slices import map_slices

WINDOW, MIN_WORDS, MIN_RUN = 14, 6, 18
RECALL, ROWS = 0.98, 2
#: Slots of a task's table of the sets that it has given already.
SEEN = 1 << 18
#: Power of two of the bits that tell the sets to be compared, at most.
MARKS = 26
#: Words of 64 bits in a set's sketch. Near copies just below a link differ in a shingle or two
#: too many; in few slots, so many of these fall on others' bits that the pair passes.
SKETCH = [f"sketch_{i}" for i in range(16)]

_U = np.uint64


def tune_bands(similarity: float = PERCENT / 100, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least bands b with 1 - (1 - s^r)^b >= recall."""
    b = 1
    while 1 - (1 - similarity**rows) ** b < recall:
        b += 1
    return b


BANDS = tune_bands()
_FACTORS = stream(21, BANDS * ROWS)
_BAND = stream(22, BANDS)


def _extreme(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``w`` consecutive values."""
    f, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= w:
        x = f(x[:-span], x[span:])
        span *= 2
    return x if span == w else f(x[: len(x) - (w - span)], x[w - span :])


def cut_points(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs of joined texts, whose words begin at ``at`` (one more at the
    end): the texts' own, and positions whose two-word hash is the least of some WINDOW
    consecutive ones of the same text."""
    n = len(words)
    firsts = at[:-1][np.diff(at) > 0]
    if n <= WINDOW:
        return firsts
    with np.errstate(over="ignore"):
        h = mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:])
    least = _extreme(h, WINDOW, True)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least[text[: len(least)] != text[WINDOW : WINDOW + len(least)]] = 0  # a window of two texts chooses nothing
    pad = np.zeros(WINDOW - 1, _U)
    chosen = np.append(_extreme(np.concatenate([pad, least, pad]), WINDOW, False) == h, False)
    chosen[firsts] = True
    return np.flatnonzero(chosen)


@dataclass
class Paragraphs:
    """The paragraphs of a run of texts that have MIN_WORDS: each one's text, word range in
    the text, shingles (joined, with where each one's begin), set hash and set size."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    run: np.ndarray
    offset: np.ndarray
    node: np.ndarray
    n: np.ndarray


def paragraphs(texts: list[str | None]) -> Iterator[Paragraphs]:
    for first, raws in chunks(texts):
        words, at = word_hashes(raws)
        starts = cut_points(words, at)
        text = np.searchsorted(at, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(words)), at[text + 1])
        big = ends - starts >= MIN_WORDS
        starts, ends, text = starts[big], ends[big], text[big]
        if not len(starts):
            continue
        sizes = ends - starts - K + 1
        offset = np.cumsum(sizes) - sizes
        run = shingle_hashes(words, K)[np.repeat(starts - offset, sizes) + np.arange(sizes.sum())]
        node, n = _fingerprints(run, offset)
        yield Paragraphs(first + text, starts - at[text], ends - at[text], run, offset, node, n)


def _fingerprints(run: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of each paragraph's distinct set."""
    fresh = np.ones(len(run), dtype=bool)
    order = np.argsort(run)
    s = run[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    # Only shingles that occur again in these texts can repeat in a paragraph.
    again = order[same[1:] | same[:-1]]
    if len(again):
        which = np.searchsorted(offset, again, "right")
        at = np.lexsort((run[again], which))
        again, which = again[at], which[at]
        fresh[again[1:][(run[again[1:]] == run[again[:-1]]) & (which[1:] == which[:-1])]] = False
    with np.errstate(over="ignore"):
        terms = np.where(fresh, mix(run + _U(0x5851F42D4C957F2D)), _U(0))
        prints = mix(np.add.reduceat(terms, offset))
    return prints, np.add.reduceat(fresh, offset, dtype=np.int64)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every paragraph: doc_id, word range, and its set's hash."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        for p in paragraphs(batch["text"].tolist()):
            yield pd.DataFrame({"doc_id": ids[p.text], "start": p.start, "end": p.end, "node": p.node.view(np.int64)})


class _Once:
    """Tells the sets that a task has not met lately, so that a paragraph of many texts leaves
    a task once or a few times. A slot holds one set; what it forgets is given again."""

    def __init__(self) -> None:
        self.slots = np.arange(SEEN, dtype=_U) ^ _U(1)  # no set of a slot

    def __call__(self, p: Paragraphs) -> tuple[np.ndarray, np.ndarray]:
        """The new ones of the distinct sets, and each one's first paragraph."""
        nodes, first = np.unique(p.node, return_index=True)
        at = (nodes & _U(SEEN - 1)).astype(np.int64)
        new = self.slots[at] != nodes
        self.slots[at] = nodes
        return nodes[new], first[new]


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, node, n): each paragraph's set with the keys of its bands."""
    once = _Once()
    for batch in batches:
        for p in paragraphs(batch["text"].tolist()):
            nodes, first = once(p)
            with np.errstate(over="ignore"):
                least = [np.minimum.reduceat(p.run * f, p.offset)[first] * f for f in _FACTORS]
                keys = [mix(sum(least[b * ROWS : (b + 1) * ROWS], np.zeros(len(nodes), _U)) + _BAND[b]) for b in range(BANDS)]
            for key in keys:
                yield pd.DataFrame({"key": key.view(np.int64), "node": nodes.view(np.int64), "n": p.n[first].astype(np.int32)})


def sketches(p: Paragraphs) -> np.ndarray:
    """Each paragraph's set as the longs of ``SKETCH``: one bit for each slot that a shingle
    falls into by its highest bits."""
    slots = 64 * len(SKETCH)
    which = np.repeat(np.arange(len(p.offset)), np.diff(np.append(p.offset, len(p.run))))
    bits = np.zeros((len(p.offset), slots), dtype=bool)
    bits[which, (p.run >> _U(64 - (slots.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


class Marks:
    """A bit set that tells whether a set can be one of those marked: every marked one is
    found, and some others. It takes 8 MB at most, so it travels to the tasks at any size."""

    def __init__(self, nodes: DataFrame, count: int):
        self.power = min(MARKS, max(15, (32 * count).bit_length()))
        n = F.col("node")
        bits = nodes.select(F.explode(F.array(F.shiftrightunsigned(n, 64 - self.power), n.bitwiseAND((1 << self.power) - 1))).alias("bit"))
        words = bits.groupBy(F.shiftright("bit", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("word"))
        self.bits = np.zeros(1 << self.power >> 3, np.uint8)
        for at, word in words.toLocalIterator():
            self.bits[at << 12 : at + 1 << 12] = np.frombuffer(word, np.uint8)

    def __call__(self, nodes: np.ndarray) -> np.ndarray:
        found = np.ones(len(nodes), dtype=bool)
        for bit in (nodes >> _U(64 - self.power), nodes & _U((1 << self.power) - 1)):
            found &= (self.bits[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _of(p: Paragraphs, at: np.ndarray) -> Paragraphs:
    """The paragraphs at the places ``at``."""
    sizes = np.diff(np.append(p.offset, len(p.run)))[at]
    offset = np.cumsum(sizes) - sizes
    run = p.run[np.repeat(p.offset[at] - offset, sizes) + np.arange(sizes.sum())]
    return Paragraphs(p.text[at], p.start[at], p.end[at], run, offset, p.node[at], p.n[at])


def _sets(batches: Iterator[pd.DataFrame], marks: Marks) -> Iterator[pd.DataFrame]:
    """The sets that ``marks`` tells, and their sketches."""
    once = _Once()
    for batch in batches:
        for p in paragraphs(batch["text"].tolist()):
            nodes, first = once(p)
            first = first[marks(nodes)]
            if not len(first):
                continue
            q = _of(p, first)
            words = dict(zip(SKETCH, sketches(q).T, strict=True))
            grams = [np.unique(q.run[a:b]).tobytes() for a, b in zip(q.offset, [*q.offset[1:], len(q.run)], strict=True)]
            yield pd.DataFrame({"node": q.node.view(np.int64), **words, "grams": grams})


SETS = "node long, " + "".join(f"{c} long, " for c in SKETCH) + "grams binary"


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
            s, t = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = common(s, t)
            rows.append((a, b, 100 * both >= PERCENT * (len(s) + len(t) - both)))
        yield pd.DataFrame(rows, columns=["a", "b", "linked"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, from the overlap of their sets."""
    x = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return map_slices(both, _overlaps, "a long, b long, linked boolean", 4096)


def paragraph_clusters(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All paragraphs (doc_id, start, end, node), and (node, cluster_id, lo, hi) of the sets
    that stand in several documents or collide with others in a band: ``lo`` and ``hi`` are
    a set's least and greatest doc_id.

    Paragraphs of one band that the rounds left in different clusters are compared pair by
    pair, but those whose sketches rule a link out, so only what the bands miss is lost.
    """
    parts = scratch.keep(map_slices(texts, _parts, "doc_id long, start int, end int, node long"), "parts")
    shared = packed_blocks(texts, _bands, BANDS * parts.count(), scratch)
    involved = scratch.keep(shared.select("node").distinct().withColumn("involved", F.lit(True)), "involved")
    held = parts.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    nodes = scratch.keep(held.join(involved, "node", "left").where("involved or lo < hi"), "nodes")

    marks = Marks(involved, involved.count())
    sets = map_slices(texts, lambda frames: _sets(frames, marks), SETS).join(involved.select("node"), "node", "left_semi")
    sets = scratch.keep(sets.dropDuplicates(["node"]), "sets")
    found = linked_components(shared, lambda pairs: _verify(pairs, sets), scratch, sketches=sets.select("node", *SKETCH))
    clusters = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster_id"), "lo", "hi")
    clusters = scratch.keep(clusters, "clusters")
    scratch.close(parts, clusters)
    return parts, clusters


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, cluster_id, n_docs, removed) of repeated passages.

    ``start`` and ``end`` count the document's words; ``cluster_id`` names the cluster of
    the passage's first paragraph, ``n_docs`` that cluster's documents; ``removed`` is false
    in the cluster's least doc_id, which keeps the passage.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    parts, clusters = paragraph_clusters(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), scratch)
    several = clusters.groupBy("cluster_id").agg(F.min("lo").alias("keeper"), F.max("hi").alias("most")).where("keeper < most")
    flagged = scratch.keep(clusters.join(several, "cluster_id").select("node", "cluster_id", "keeper"), "flagged")
    # Of two written tables, so that the rows of a set that many documents hold are split.
    members = scratch.keep(
        parts.join(small(flagged, flagged.count()), "node").select("doc_id", "start", "end", "cluster_id", (F.col("doc_id") != F.col("keeper")).alias("removed")),
        "members",
    )
    sizes = members.groupBy("cluster_id", "doc_id").agg(F.lit(1).alias("one")).groupBy("cluster_id").agg(F.count("*").alias("n_docs"))
    sizes = scratch.keep(sizes, "sizes")
    # Runs of a document: the next flagged paragraph begins within WINDOW words of the last one's end.
    order = Window.partitionBy("doc_id", "removed").orderBy("start")
    broken = members.withColumn("fresh", F.when(F.col("start") - F.lag("end").over(order) <= WINDOW, 0).otherwise(1))
    runs = broken.withColumn("run", F.sum("fresh").over(order)).groupBy("doc_id", "removed", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("cluster_id", "start").alias("cluster_id")
    )
    runs = scratch.keep(runs.where(F.col("end") - F.col("start") >= MIN_RUN), "runs")
    out = scratch.keep(
        runs.join(small(sizes, sizes.count()), "cluster_id").select(
            "doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "cluster_id", "n_docs", "removed"
        ),
        "passages",
    )
    scratch.close(out)
    return out


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@F.pandas_udf(StringType())
def _cut_out(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    def one(text: str | None, spans: list | None) -> str | None:
        if text is None or spans is None:
            return text
        words, kept, at = [m.span() for m in _WORDS.finditer(text)], [], 0
        for span in spans:
            if span["start"] < len(words):
                kept.append(text[at : words[span["start"]][0]])
                at = words[min(span["end"], len(words)) - 1][1]
        return "".join([*kept, text[at:]])

    return pd.Series([one(t, s) for t, s in zip(texts, cuts, strict=True)], dtype=object)


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with each text cut down to what is not a removed passage; the white space
    around a passage stays."""
    cuts = repeated_passages(docs).where("removed").groupBy(F.col("doc_id").alias("_d")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts")
    )
    cut = _cut_out(F.when(F.col("_cuts").isNotNull(), F.col("text")), F.col("_cuts"))
    return (
        docs.join(cuts, F.col("doc_id") == F.col("_d"), "left")
        .withColumn("text", F.when(F.col("_cuts").isNotNull(), cut).otherwise(F.col("text"))).select(docs.columns)
    )


def digest(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs)
