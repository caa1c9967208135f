"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local-mode session (one machine) gets a temporary
    folder; any other session is refused, as executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldweave-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Bytes of rows that cross to Python together. A batch stands outside the heap, twice while its
#: buffers grow, and again in the worker; Spark's own bound of 64 MB lets texts and sets fill it.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside cross to Python in batches of ``BATCH_BYTES`` at most, or of
    what the session sets if that is less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, now = spark.conf.get(name), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(name, min(now, BATCH_BYTES) if now > 0 else BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of one run. ``keep`` writes one, ``free`` deletes those no longer read, and
    ``close`` all but the given ones, which the run's result still reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: list[DataFrame] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends at the files."""
        path = self.path(name)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with small_batches(self.spark):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept.append(out)
        return out

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                delete(self.spark, path)
        self.kept = [t for t in self.kept if not any(t is x for x in tables)]

    def close(self, *but: DataFrame) -> None:
        self.free(*[t for t in self.kept if not any(t is x for x in but)])


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, the deployer's knob for parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes up to which a table is broadcast, as estimated from its rows and fields.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` take at most ``most`` bytes in a
    hash table: 32 for a row, 8 for a number and 64 for anything else.

    Beyond the bound the table goes without a hint and Spark shuffles both sides.
    """
    row = 32 + sum(8 if isinstance(f.dataType, NumericType) else 64 for f in df.schema.fields)
    return F.broadcast(df) if rows * row <= most else df
