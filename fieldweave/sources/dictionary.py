"""Data dictionaries: one row for each column of a described table.

A dictionary is read with a fixed schema (never inferred), gets ordinals in the order of
first appearance, and is prepared once: tokens of the names and pinyin initials. Order
matters downstream, so it is carried in columns instead of in the row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pinyin import pinyin_initials

#: The headers of dictionary files, in our order of columns.
HEADERS = {"表名": "table_name", "表描述": "table_desc", "字段名": "name", "字段描述": "desc", "字段类型": "type"}
COLUMNS = list(HEADERS.values())
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
FILE_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in HEADERS])
ORDERED = T.StructType([*SCHEMA.fields, T.StructField("row_ord", T.LongType())])


def read_dictionary(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A dictionary file (csv, json, parquet or xlsx, by ending) with its rows numbered.

    Files are numbered in Spark's order of files and rows within them; xlsx sheets by row.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "xlsx":
        from .xlsx import XlsxSource

        spark.dataSource.register(XlsxSource)
        rows = spark.read.format("xlsx").schema(ORDERED_FILE).load(path)
        return rows.select(*[F.col(h).alias(c) for h, c in HEADERS.items()], "row_ord")
    reader = spark.read.schema(FILE_SCHEMA)
    reader = reader.option("header", True).option("enforceSchema", False) if fmt == "csv" else reader
    rows = reader.format(fmt).load(path)
    return rows.select(*[F.col(h).alias(c) for h, c in HEADERS.items()], F.monotonically_increasing_id().alias("row_ord"))


ORDERED_FILE = T.StructType([*FILE_SCHEMA.fields, T.StructField("row_ord", T.LongType())])


def from_rows(spark: SparkSession, rows: list[tuple[str | None, ...]]) -> DataFrame:
    """A dictionary of literal rows (table_name, table_desc, name, desc, type)."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ORDERED)


def paired_read(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Both dictionaries in one relation, told apart by ``side``."""
    s, t = (read_dictionary(spark, p).withColumn("side", F.lit(k)) for p, k in ((source, "source"), (target, "target")))
    return s.unionByName(t)


def tokens(name: Column) -> Column:
    """Lower-case parts of a name: cut at camel humps and at whatever is no letter or digit;
    Han runs stay whole."""
    humps = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9一-龥]+"), lambda x: x != "")


def simple_tokens(name: Column) -> Column:
    """Lower-case parts between underscores."""
    return F.filter(F.split(F.lower(name), "_"), lambda x: x != "")


def ordered(rows: DataFrame) -> DataFrame:
    """``table_ord`` by a table's first row and ``field_ord`` by its rows, nulls as ''. Rows
    of one table name are one table, described by the last of its rows that says anything."""
    clean = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS], "row_ord").where("table_name <> ''")
    tables = clean.groupBy("table_name").agg(F.min("row_ord").alias("first"))
    # One row for each described table, so one window over all of them is small.
    tables = tables.select("table_name", (F.row_number().over(Window.orderBy("first")) - 1).alias("table_ord"))
    fields = clean.withColumn("field_ord", F.row_number().over(Window.partitionBy("table_name").orderBy("row_ord")) - 1)
    return fields.drop("row_ord").join(tables, "table_name").select("table_ord", "field_ord", *COLUMNS)


def prepare(rows: DataFrame, enable_pinyin: bool = True, enable_abbreviation: bool = True, split: str = "full") -> DataFrame:
    """The dictionary with ordinals, ``tokens`` and pinyin initials (`` '' `` when disabled)."""
    on = enable_pinyin and enable_abbreviation
    initials = lambda c: pinyin_initials(F.col(c)) if on else F.lit("")
    cut = tokens if split == "full" else simple_tokens
    return ordered(rows).select(
        "*", cut(F.col("name")).alias("tokens"), initials("name").alias("name_pinyin_abbr"), initials("desc").alias("desc_pinyin_abbr")
    )


def tables_of(fields: DataFrame) -> DataFrame:
    """One row for each table, with its fields nested in order."""
    item = F.struct("field_ord", "name", "desc", "type")
    return fields.groupBy("table_ord", "table_name").agg(
        F.max("table_desc").alias("table_desc"), F.count("*").alias("n_fields"), F.array_sort(F.collect_list(item)).alias("fields")
    )


def first_of_name(fields: DataFrame) -> DataFrame:
    """One row for each (table, field name): of repeated names the first."""
    rest = [c for c in fields.columns if c not in ("table_name", "name")]
    best = fields.groupBy("table_name", "name").agg(F.min_by(F.struct(*rest), "field_ord").alias("_f"))
    return best.select("table_name", "name", *[F.col(f"_f.{c}").alias(c) for c in rest])


#: The sample dictionaries (table, table description, field, description, type).
SAMPLE_SOURCE = [
    ("T_XGXT_T_SS_ZNCQ_XSGSQK", "归宿情况", "XSBH", "学生编号", "VARCHAR"),
    ("T_XGXT_T_SS_ZNCQ_XSGSQK", "归宿情况", "XM", "姓名", "VARCHAR"),
    ("T_XGXT_T_SS_ZNCQ_XSGSQK", "归宿情况", "WID", "WID", "VARCHAR"),
    ("T_XGXT_T_SS_ZNCQ_XSGSQK", "归宿情况", "QKLX", "情况类型", "INT"),
    ("T_XGXT_T_SS_ZNCQ_XSGSQK", "归宿情况", "LOGIN_TIME", "登录时间", "DATETIME"),
]
SAMPLE_TARGET = [
    ("T_RKJXXXHPT_T_CXJX_BKSXKXX", "本科生学生信息", "XH", "学号", "VARCHAR"),
    ("T_RKJXXXHPT_T_CXJX_BKSXKXX", "本科生学生信息", "XM", "姓名", "VARCHAR"),
    ("T_RKJXXXHPT_T_CXJX_BKSXKXX", "本科生学生信息", "WID", "WID", "VARCHAR"),
    ("T_RKJXXXHPT_T_CXJX_BKSXKXX", "本科生学生信息", "XDRSDM", "下达人身份码", "VARCHAR"),
    ("T_RKJXXXHPT_T_CXJX_BKSXKXX", "本科生学生信息", "FB_TIME", "FB_TIME", "DATETIME"),
]
