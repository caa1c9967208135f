"""Formatted text columns: two-decimal numbers, percentages, the matching basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_decimals(x: Column) -> Column:
    """'1234.56', ties to even; digits are not grouped."""
    return F.translate(F.format_number(x, 2), ",", "")


def percent(part: Column, whole: Column) -> Column:
    """'12.34%' of two counts; null where the whole is not positive."""
    return F.when(whole > 0, F.concat(two_decimals(100.0 * part / whole), F.lit("%")))


def squeezed(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def shortened(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def matching_basis(reason: Column, similarity: Column, confidence: Column) -> Column:
    given = F.coalesce(reason, F.lit(""))
    return F.concat_ws(
        "；",
        F.when(given != "", shortened(squeezed(given))),
        F.concat(F.lit("特征相似度: "), two_decimals(F.coalesce(similarity, F.lit(0.0)))),
        F.concat(F.lit("LLM置信度: "), two_decimals(F.coalesce(confidence, F.lit(0.0)))),
    )


def run_stamp(at: Column) -> Column:
    """A run's stamp for output names, as yyyyMMddHHmmss."""
    return F.date_format(at, "yyyyMMddHHmmss")
