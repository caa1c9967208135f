"""Best-fit packing of documents into sequences of a fixed capacity.

Documents become token ids plus a separator, and only longer ones are cut into pieces of
the capacity (the first may be shorter). Packing then runs in supersteps, largest pieces
first. Pieces and gaps are range-sorted: lengths and gaps are whole numbers up to the
capacity, so a sorted range of equal pieces, or of sequences with equal gaps, is kept as a
run (a length, a count), and the state of all sequences is a few runs for each value,
whatever the corpus. In a superstep the pieces of one length sweep to their successor, the
smallest gap that takes them; conflicts are resolved by rank, piece number r of the run
going to the r-th place of the gaps; the gaps are updated and the sweep repeats until the
run is placed. Ranking the pieces and giving each its place are distributed: a piece's rank
is its number among equal lengths in its task plus the count in the tasks before.

The ids are those of the vocabulary's own tokenizer. Texts of Latin letters go through a
faster encoder of the same ranks, others through the tokenizer itself.

Defined results: a null or empty text is the separator alone; rows that repeat a doc_id are
packed each by itself; an empty table gives no pieces; further columns are not read; a
text that holds a special token's string gets that token, as the tokenizer gives it.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, small

CAPACITY, SEPARATOR = 2048, 0
VOCABULARY = "byte_bpe_50k"


@dataclass(frozen=True)
class Vocabulary:
    """Contents of the tokenizer's file, and of its ranks for the faster encoder."""

    tokenizer: str
    ranks: bytes
    pattern: str


def public_vocabulary(name: str = VOCABULARY) -> Vocabulary:
    import public_tokenizers

    at = lambda ending: Path(public_tokenizers.path(f"{name}.{ending}"))
    return Vocabulary(at("json").read_text(encoding="utf-8"), at("tiktoken").read_bytes(), public_tokenizers.PATTERN)


class Encoder:
    """Token ids of a text, alike from either encoder."""

    #: Letters and signs whose classes all Unicode versions agree on.
    _plain = re.compile(r"[\x20-\x7E\n\t\xA1-\xFFĀ-ſ–—‘-”…€]*+\Z")

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_str(vocabulary.tokenizer)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.ranks.splitlines())}
        self.fast = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self._plain.match(text) and not self._added.search(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short of the capacity."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(vocabulary: Broadcast, capacity: int, with_ids: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, ranks = Encoder(Vocabulary(*vocabulary.value)), TaskContext.get().partitionId(), {}
        columns = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids]
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encoder.ids(text or ""), SEPARATOR], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rank = ranks[length] = ranks.get(length, -1) + 1
                    rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), task, rank, *[own.astype(np.int32)] * with_ids))
                size += len(ids)
                if with_ids and size > 4_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return run


def token_pieces(docs: DataFrame, vocabulary: Vocabulary | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]) of every piece; ``rank``
    numbers the pieces of a length in a task, so the table must be written before it is used."""
    v = vocabulary or public_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast((v.tokenizer, v.ranks, v.pattern))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInPandas(_pieces(shared, capacity, with_ids), schema)


@dataclass(frozen=True)
class Match:
    """Pieces of ``length`` with ranks lo to hi - 1: ``per`` to a sequence, from ``base`` on."""

    length: int
    lo: int
    hi: int
    base: int
    per: int
    offset: int


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> list[Match]:
    """Best-fit of ``counts`` pieces by length; the state is runs of sequences by gap."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    order: list[int] = []  # the gaps there are, ascending
    out: list[Match] = []
    opened = 0

    def put(gap: int, base: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((base, n))

    for length in sorted(counts, reverse=True):
        lo, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = order[at]
            base, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = gap // length
            take = min(left, n * per)
            full, rest = divmod(take, per)
            out.append(Match(length, lo, lo + take, base, per, capacity - gap))
            put(gap - per * length, base, full)
            put(gap - rest * length, base + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            put(gap, base + used, n - used)
            lo, left = lo + take, left - take
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written ``pieces`` (length, task, rank, ...)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # At most one row for each length: bounded by the capacity.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    matches = [(m.length, m.lo, m.hi, m.base, m.per, m.offset) for m in supersteps(histogram, capacity)]
    plan = spark.createDataFrame(matches, "_length long, _lo long, _hi long, _base long, _per long, _offset long")
    ranked = pieces.join(starts, ["length", "task"]).withColumn("_r", F.col("rank") + F.col("_before"))
    on = (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi"))
    i = F.col("_r") - F.col("_lo")
    return (
        ranked.join(small(plan, len(matches)), on)
        .withColumn("sequence_id", F.col("_base") + F.floor(i / F.col("_per")).cast("long"))
        .withColumn("offset", F.col("_offset") + F.pmod(i, F.col("_per")) * F.col("length"))
        .drop("_r", "_before", *plan.columns)
    )


def pack_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Every piece with its ids and its place; the tokens are made once and written."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, vocabulary, capacity, with_ids), "pieces")
    return pack(pieces, capacity).drop("task", "rank")


def digest(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
