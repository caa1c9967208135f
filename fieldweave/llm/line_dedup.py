r"""Line dedup over levelled sorted runs (DataFrame functions only).

The corpus is taken in batches. ``LineRuns`` holds what earlier batches contained as runs:
tables of (line hash, documents holding it, largest of their ids), bucketed and sorted by
the hash. A new batch is counted by hash and merge-anti-joined with every run: the lines
that nobody held before become a run of level 0, so that a line stands in one run only; the
others are increments, kept in levels of their own. Two tables of one level are merged
into one of the next by a sort-merge full join; as both are bucketed alike, neither the
joins nor the merges move a table's rows again. After the last batch the runs and the
increments are merged into the totals, and lines found in ``min_docs`` documents go
everywhere but in the largest one.

A line is known by 128 bits of hash. doc_id is the key of a document: rows that repeat
one count as one document, and each row loses the same lines if its text is the same.
Defined results: a null or empty text is one empty line, which is never dropped (keys
shorter than ``min_chars`` stay); an empty table gives an empty result; further columns
of the input are passed through by ``dedup_lines`` and do not clash, as working columns
carry a prefix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, partitions
from .text import SPACE_CHARS, ascii_lower, let, lines

K = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def hashed_lines(docs: DataFrame, n_batches: int, min_chars: int = 20) -> DataFrame:
    """(batch, doc_id, row_hash, pos, k1, k2) of every line whose key has ``min_chars``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    return (
        docs.select(F.col("doc_id"), F.xxhash64(t).alias("row_hash"), F.inline(F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)))
        .select(
            F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch"),
            "doc_id", "row_hash", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), F.col("key")).alias("k2"),
        )
    )


class LineRuns:
    """``runs`` and ``increments`` of (k1, k2, n_docs, keep_doc) by level; ``fanout`` 2: two of
    a level merge. A line is in one of the runs, that of the batch that first held it."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = partitions(self.spark)
        self.runs: dict[int, DataFrame] = {}
        self.increments: dict[int, DataFrame] = {}

    def _run(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written bucketed and sorted by the hash, one file a bucket."""
        table, path = f"line_run_{uuid.uuid4().hex}", self.scratch.path(name)
        (
            df.repartition(self.buckets, *K).write.format("parquet").option("path", path)
            .bucketBy(self.buckets, *K).sortBy(*K).saveAsTable(table)
        )
        out = self.spark.table(table)
        out._scratch_path, out._table = path, table
        return out

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run._table}")
        self.scratch.free(run)

    def add(self, batch: DataFrame) -> None:
        """Take a batch of (doc_id, k1, k2): count it by line and add what the merge-anti-join
        with the runs leaves as a run, the rest as an increment."""
        counts = (
            batch.groupBy(*K, "doc_id").agg(F.lit(1).alias("one"))
            .groupBy(*K).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"))
        )
        if not self.runs:
            self._place(self.runs, self._run(counts, "run"))
            return
        counted = self._run(counts, "batch")
        unseen = counted
        for earlier in self.runs.values():
            unseen = unseen.join(earlier.select(*K).hint("merge"), K, "left_anti")
        fresh = self._run(unseen, "run")
        self._place(self.increments, self._run(counted.join(fresh.select(*K).hint("merge"), K, "left_anti"), "increment"))
        self._place(self.runs, fresh)
        self._drop(counted)

    def _place(self, levels: dict[int, DataFrame], run: DataFrame) -> None:
        level = 0
        while level in levels:
            run = self._merge(levels.pop(level), run)
            level += 1
        levels[level] = run

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = a.alias("x"), b.hint("merge").alias("y")
        both = x.join(y, (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")), "full").select(
            F.coalesce("x.k1", "y.k1").alias("k1"),
            F.coalesce("x.k2", "y.k2").alias("k2"),
            (F.coalesce("x.n_docs", F.lit(0)) + F.coalesce("y.n_docs", F.lit(0))).alias("n_docs"),
            F.greatest("x.keep_doc", "y.keep_doc").alias("keep_doc"),
        )
        out = self._run(both, "merged")
        self._drop(a)
        self._drop(b)
        return out

    def compact(self) -> DataFrame:
        """All runs and increments merged into one table of totals, smallest first."""
        each = [levels[k] for levels in (self.increments, self.runs) for k in sorted(levels)]
        merged = each[0]
        for run in each[1:]:
            merged = self._merge(merged, run)
        self.runs, self.increments = {max(self.runs): merged}, {}
        return merged

    def close(self) -> None:
        """Drop all tables."""
        for run in [*self.runs.values(), *self.increments.values()]:
            self._drop(run)
        self.runs, self.increments = {}, {}


def repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_batches: int = 4) -> DataFrame:
    """(doc_id, row_hash, drops): the ascending positions that each document's text loses."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    hashed = scratch.keep(hashed_lines(docs, n_batches, min_chars), "lines", ["batch"])
    runs = LineRuns(scratch)
    for k in range(n_batches):
        runs.add(hashed.where(F.col("batch") == k))
    totals = runs.compact().where(F.col("n_docs") >= min_docs)
    # Lines of more than one part in 8 n of all are at most 8 n lines: those are broadcast,
    # so that no task gets all rows of a line that a third of the corpus holds.
    parts = 8 * partitions(docs.sparkSession)
    common = max(min_docs, hashed.count() // parts + 1)
    hot = F.broadcast(totals.where(F.col("n_docs") >= common))
    rest = hashed.join(hot.select(*K), K, "left_anti").join(totals.where(F.col("n_docs") < common), K)
    found = hashed.join(hot, K).unionByName(rest)
    drops = (
        found.where(F.col("doc_id") != F.col("keep_doc")).select("doc_id", "row_hash", "pos").distinct()
        .groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list("pos")).alias("drops"))
    )
    out = scratch.keep(drops, "drops")
    runs.close()
    scratch.close(out)
    return out


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_batches: int = 4) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, ``n_lines`` before and ``n_dropped``."""
    drops = repeated_lines(docs, min_docs, min_chars, n_batches).select(
        F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h"), F.col("drops").alias("_drops")
    )
    on = (F.col("doc_id") == F.col("_d")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_h"))

    def kept(all_lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_drops"))
        return F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")

    stays = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(let(lines(F.col("text")), kept))
    rest = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return docs.join(drops, on, "left").select(
        *rest,
        F.size(lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        stays.alias("text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
