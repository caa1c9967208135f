"""Row numbers and running counts over a whole table, without one task for all rows.

The rows are dealt into ranges of the order and written; a range's rows are numbered by
themselves, and start after the counts of the ranges before it, one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, partitions

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def numbered(rows: DataFrame, order: list[Column | str], total: str | None = None) -> DataFrame:
    """``rows`` with ``n``, from 1 in ``order``, and with ``total``, the running sum of that
    column as ``n_total``. Ties of the whole order are numbered in any order."""
    scratch = Scratch(rows.sparkSession, "numbering")
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    dealt = scratch.keep(dealt, "ranges")
    own = F.col(total).cast("long") if total else F.lit(0).cast("long")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_count"), F.coalesce(F.sum(own), F.lit(0)).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(*BEFORE)  # a row for each range
    starts = counts.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_count", "_sum")])
    of_range = Window.partitionBy("_range").orderBy(*order)
    out = dealt.join(F.broadcast(starts), "_range").withColumn("n", F.row_number().over(of_range) + F.col("_count_before"))
    if total:
        out = out.withColumn("n_total", F.sum(own).over(of_range.rowsBetween(*SO_FAR)) + F.col("_sum_before"))
    return out.drop("_range", "_count_before", "_sum_before")
