"""String ratios as columns.

``indel_ratio`` stays in the JVM. ``gestalt_ratio`` has no built-in equivalent; it is an
Arrow UDF over the standard library's matcher. ``pair_ratios`` gives all ratios of a field
pair in one crossing of the Python boundary, each distinct pair of strings once a batch.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS(a, b) / (len a + len b); two empty strings are equal (1.0). One row of the
    longest-common-subsequence table is folded over the characters of ``a``."""
    width = F.length(b)
    empty = F.transform(F.sequence(F.lit(0), width), lambda _: F.lit(0))

    def row(before: Column, ch: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            up, left, corner = F.get(before, j), F.element_at(done, -1), F.get(before, j - 1)
            return F.concat(done, F.array(F.when(F.substring(b, j, F.lit(1)) == ch, corner + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(1), width), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), empty, row), -1)
    both = F.length(a) + width
    return F.when(both == 0, F.lit(1.0)).when((F.length(a) == 0) | (width == 0), F.lit(0.0)).otherwise(2.0 * lcs / both)


def lcs_ratio(a: str, b: str) -> float:
    """``indel_ratio`` of two strings: a bit-parallel LCS over whole numbers."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full  # positions of a that no match has used
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return 2.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def gestalt(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    seen: dict[tuple[str, str], float] = {}
    return pd.Series([seen[p] if p in seen else seen.setdefault(p, gestalt(*p)) for p in zip(a, b, strict=True)], dtype="float64")


RATIOS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("indel_name", "gestalt_name", "gestalt_desc", "gestalt_desc_lower", "gestalt_type", "pinyin_st", "pinyin_ts")]
)


@F.pandas_udf(RATIOS)
def pair_ratios(
    s_name: pd.Series, t_name: pd.Series, s_desc: pd.Series, t_desc: pd.Series, s_type: pd.Series, t_type: pd.Series,
    s_full: pd.Series, s_abbr: pd.Series, t_full: pd.Series, t_abbr: pd.Series,
) -> pd.DataFrame:
    """Ratios of lower-case names and types, of descriptions as they are and lower-case, and
    of each side's description in pinyin (whole or initials) with the other's name."""
    seen: dict[tuple, float] = {}

    def of(f, a: str, b: str) -> float:
        key = (f is gestalt, a, b)
        if key not in seen:
            seen[key] = f(a, b)
        return seen[key]

    def near(full: str, abbr: str, name: str) -> float:
        return max(of(lcs_ratio, x, name) if x and name else 0.0 for x in (full, abbr))

    rows = [
        (
            of(lcs_ratio, a, b), of(gestalt, a, b),
            of(gestalt, c, d) if c and d else 0.0, of(gestalt, c.lower(), d.lower()) if c and d else 0.0, of(gestalt, e, f),
            near(g, h, b) if c else 0.0, near(i, j, a) if d else 0.0,
        )
        for a, b, c, d, e, f, g, h, i, j in zip(s_name, t_name, s_desc, t_desc, s_type, t_type, s_full, s_abbr, t_full, t_abbr, strict=True)
    ]
    return pd.DataFrame(rows, columns=RATIOS.names)


def string_similarity(a: Column, b: Column) -> Column:
    """Indel ratio of the lower-case strings, 0 if either is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(indel_ratio(F.lower(a), F.lower(b)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """0.8 if one string holds the other, else 0."""
    return F.when(a.contains(b) | b.contains(a), F.lit(0.8)).otherwise(F.lit(0.0))


def affix_ratio(a: Column, b: Column) -> Column:
    """Longest common prefix or suffix of at least two characters, over the longer length."""
    la, lb = F.length(a), F.length(b)
    short = F.least(la, lb)
    sizes = F.sequence(F.lit(2), short)
    prefix = F.filter(sizes, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    suffix = F.filter(sizes, lambda i: F.substring(a, la - i + 1, i) == F.substring(b, lb - i + 1, i))
    best = F.coalesce(F.array_max(F.concat(prefix, suffix)), F.lit(0))
    return F.when(short < 2, F.lit(0.0)).otherwise(best / F.greatest(la, lb))


def length_bound(a: Column, b: Column) -> Column:
    """No ratio of the two strings is larger: twice the shorter length over both."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)
