"""Chinese text to pinyin.

The readings of the Han block come from the ICU transliterator on Spark's class path, one
call for the whole block, so the table is of fixed size and is not kept in the repository.
Conversion runs once for a field, before any pairing.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = "一", "龥"


@functools.cache
def readings(toned: bool = False) -> dict[str, str]:
    """Each Han character's reading, without tone marks unless ``toned``."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rule = "Han-Latin" if toned else "Han-Latin; Latin-ASCII"
    chars = [chr(c) for c in range(ord(FIRST), ord(LAST) + 1)]
    said = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate("\n".join(chars))
    return dict(zip(chars, (line.strip().lower() for line in said.split("\n")), strict=True))


def to_pinyin(text: str, table: dict[str, str], delimiter: str = "") -> str:
    """Han runs as readings joined by ``delimiter``; everything else as it is."""
    out, run = [], []
    for c in text:
        if FIRST <= c <= LAST:
            run.append(table.get(c, c))
            continue
        out.append(delimiter.join(run) + c)
        run = []
    return "".join(out) + delimiter.join(run)


def initials(text: str, table: dict[str, str]) -> str:
    """First letters of Han characters and the ASCII letters and digits, in upper case."""
    kept = (table.get(c, c)[:1] if FIRST <= c <= LAST else c if c.isascii() and c.isalnum() else "" for c in text)
    return "".join(kept).upper()


def _column(f, text: Column, *args, toned: bool = False) -> Column:
    table = readings(toned)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(t or "", table, *args))

    return run(text)


def pinyin(text: Column, delimiter: str = "", toned: bool = False) -> Column:
    return _column(to_pinyin, text, delimiter, toned=toned)


def pinyin_initials(text: Column) -> Column:
    return _column(initials, text)
