"""Verdict cache and result sinks.

The cache is a Parquet table of verdicts by key; a run adds its misses in one append, so a
repeated run finds them. Reports are written as tables; workbooks are an option for people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import run_stamp
from ..operators.judge import VERDICT
from ..operators.results import SHEET, TIER_SHEET, sheet
from .shared import delete
from .xlsx import MOST_ROWS, workbook

CACHE_SCHEMA = f"cache_key string, {VERDICT}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached verdicts, one for each key; none where there is no table yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).dropDuplicates(["cache_key"])


def add_to_cache(fresh: DataFrame, path: str) -> None:
    fresh.write.mode("append").parquet(path)


def stamp(spark: SparkSession) -> str:
    return spark.range(1).select(run_stamp(F.current_timestamp())).first()[0]


def save_results(results: DataFrame, statistics_sheet: DataFrame, tiers: DataFrame | None, path: str, run: str | None = None, workbooks: bool = False) -> dict[str, str]:
    """Results and statistics as JSON lines, the sheet as headed CSV, tiers as Parquet by
    category, each in a folder of the run; with ``workbooks`` also as xlsx files."""
    spark = results.sparkSession
    run = run or stamp(spark)
    out = {k: f"{path}/{k}/run={run}" for k in ("results", "statistics", "sheet")}
    results.write.json(out["results"])
    statistics_sheet.write.json(out["statistics"])
    sheet(results).write.option("header", True).csv(out["sheet"])
    if tiers is not None:
        out["tiers"] = f"{path}/tiers/run={run}"
        tiers.write.partitionBy("confidence_category").parquet(out["tiers"])
    if workbooks:
        named = {"匹配结果": sheet(results), "统计信息": statistics_sheet}
        out["workbook"] = f"{path}/matching_{run}.xlsx"
        write_workbook(spark, named, out["workbook"])
        if tiers is not None:
            by_tier = {c: sheet(tiers.where(F.col("confidence_category") == c), TIER_SHEET) for c in ("high", "medium", "low", "potential")}
            out["tier_workbook"] = f"{path}/tiers_{run}.xlsx"
            write_workbook(spark, by_tier, out["tier_workbook"])
    return out


def write_workbook(spark: SparkSession, sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook of several sheets, for reports of bounded size; empty sheets are left out."""
    content = {}
    for name, df in sheets.items():
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a workbook takes {MOST_ROWS} rows; sheet {name} has more")
        content[name] = [df.columns, *map(list, rows)] if rows else []
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        stream.write(workbook(content))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    delete(spark, path)


__all__ = ["SHEET", "add_to_cache", "read_cache", "remove", "save_results", "stamp", "write_workbook"]
