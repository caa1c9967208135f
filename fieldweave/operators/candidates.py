"""Table pairs, candidates and one-to-one assignment.

Ties are broken by ordinals everywhere: a pair's rank among the table pairs, then the
order of tables and fields in their dictionaries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import gestalt_ratio
from ..sources.dictionary import tables_of
from ..sources.shared import Scratch
from .numbering import numbered

ORDER = ["pair_ord", "source_table_ord", "target_table_ord", "source_ord", "target_ord"]
#: Edges up to which greedy assignment is one fold in one task; beyond it runs in rounds.
FOLD_ROWS = 20_000


def table_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every pair of tables with its similarity: 0.7 of the names', 0.3 of the descriptions'."""
    s = tables_of(source).select(F.col("table_ord").alias("source_table_ord"), F.col("table_name").alias("source_table"), F.col("table_desc").alias("source_desc"), F.col("n_fields").alias("source_fields"))
    t = tables_of(target).select(F.col("table_ord").alias("target_table_ord"), F.col("table_name").alias("target_table"), F.col("table_desc").alias("target_desc"), F.col("n_fields").alias("target_fields"))
    names = gestalt_ratio(F.lower("source_table"), F.lower("target_table"))
    descs = F.when((F.col("source_desc") != "") & (F.col("target_desc") != ""), gestalt_ratio(F.lower("source_desc"), F.lower("target_desc"))).otherwise(F.lit(0.0))
    return s.crossJoin(t).withColumn("similarity", 0.7 * names + 0.3 * descs)


def best_table_pairs(source: DataFrame, target: DataFrame, threshold: float = 0.3, max_pairs: int | None = 50) -> DataFrame:
    """Pairs that reach the threshold, the ``max_pairs`` most similar, ranked by ``pair_ord``."""
    kept = table_pairs(source, target).where(F.col("similarity") >= threshold)
    order = [F.col("similarity").desc(), "source_table_ord", "target_table_ord"]
    if not max_pairs:
        return numbered(kept, order).withColumn("pair_ord", (F.col("n") - 1).cast("long")).drop("n")
    top = kept.orderBy(*order).limit(max_pairs)  # one small window
    return top.withColumn("pair_ord", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def first_table_pairs(source: DataFrame, target: DataFrame, max_pairs: int = 20, n_tables: int | None = None) -> DataFrame:
    """The first tables of both sides, without a look at similarity."""
    n = n_tables or (max_pairs // 5 if max_pairs > 5 else 1)
    pairs = table_pairs(source.where(F.col("table_ord") < n), target.where(F.col("table_ord") < n))
    return pairs.withColumn("pair_ord", (F.col("source_table_ord") * n + F.col("target_table_ord")).cast("long"))


def chosen_table_pairs(source: DataFrame, target: DataFrame, source_tables: list[str], target_tables: list[str]) -> DataFrame:
    """The product of two lists of tables, in the lists' order."""
    pairs = table_pairs(source.where(F.col("table_name").isin(source_tables)), target.where(F.col("table_name").isin(target_tables)))
    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return pairs.withColumn("pair_ord", at("source_table", source_tables) * len(target_tables) + at("target_table", target_tables))


def picks(text: str, n: int) -> list[int]:
    """Positions named by a list such as '1, 3': digits within 1 to ``n``, from 0."""
    return [int(p) - 1 for p in (x.strip() for x in text.split(",")) if p.isdigit() and 1 <= int(p) <= n]


def is_exact() -> Column:
    return F.lower("source_field") == F.lower("target_field")


def candidates(pairs: DataFrame, threshold: float = 0.5, above: bool = False) -> DataFrame:
    """Pairs that reach the threshold, or only those ``above`` it."""
    return pairs.where(F.col("similarity") > threshold if above else F.col("similarity") >= threshold)


def sequence() -> Column:
    """A candidate's place: similarity first, then the ordinals."""
    return F.struct((-F.col("similarity")).alias("s"), *ORDER)


def greedy(edges: DataFrame, source_key: list[str], target_key: list[str], order: Column, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Edges kept by taking them in order and dropping those with a taken end.

    Up to ``fold_rows`` edges are folded in one task. More go in rounds: an edge that is
    first at both its ends is kept, and the edges at its ends go; every round keeps the
    first edge of all, so the rounds end, and give what the fold gives.
    """
    columns = edges.columns
    held = edges.select("*", F.struct(*source_key).alias("_s"), F.struct(*target_key).alias("_t"), order.alias("_o"))
    scratch = Scratch(edges.sparkSession, "greedy")
    held = scratch.keep(held, "edges")
    n = held.count()
    if n <= fold_rows:
        return _folded(held, columns)
    kept = None
    while n:
        s = held.groupBy("_s").agg(F.min("_o").alias("_so"))
        t = held.groupBy("_t").agg(F.min("_o").alias("_to"))
        now = scratch.keep(held.join(s, "_s").join(t, "_t").where((F.col("_o") == F.col("_so")) & (F.col("_o") == F.col("_to"))).select(held.columns), "kept")
        kept = now if kept is None else kept.unionByName(now)
        rest = held.join(now.select("_s"), "_s", "left_anti").join(now.select("_t"), "_t", "left_anti")
        after = scratch.keep(rest.select(held.columns), "edges")
        scratch.free(held)
        held, n = after, after.count()
    return kept.select(columns)


def _folded(held: DataFrame, columns: list[str]) -> DataFrame:
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used_s, used_t, keep = set(), set(), []
        for i, s, t in rows.sort_values("_o").loc[:, ["_i", "_s", "_t"]].itertuples(index=False):
            if s not in used_s and t not in used_t:
                used_s.add(s), used_t.add(t), keep.append(i)
        return pd.DataFrame({"_i": keep})

    # Only ends and order enter the fold, as text and rank.
    numbered = held.withColumn("_i", F.row_number().over(Window.orderBy("_o")).cast("long"))
    ends = numbered.select(F.lit(0).alias("_g"), "_i", F.to_json("_s").alias("_s"), F.to_json("_t").alias("_t"), F.col("_i").alias("_o"))
    kept = ends.groupBy("_g").applyInPandas(fold, "_i long")
    return numbered.join(kept, "_i", "left_semi").select(columns)


def matching_rule(found: DataFrame, scope: str = "name") -> DataFrame:
    """Equal names first, all of them; then the rest, greedily by similarity, one use of a
    name. ``exact`` tells the two apart; with ``scope`` 'table' a name counts in its table."""
    marked = found.withColumn("exact", is_exact())
    exact, rest = marked.where("exact"), marked.where("NOT exact")
    s, t = (["source_field"], ["target_field"]) if scope == "name" else (["source_table", "source_field"], ["target_table", "target_field"])
    rest = rest.join(exact.select(*s).distinct(), s, "left_anti").join(exact.select(*t).distinct(), t, "left_anti").select(marked.columns)
    return exact.unionByName(greedy(rest, s, t, sequence()))


def in_rule_order() -> list[Column]:
    """The rule's output order: equal names, then the others, each by similarity."""
    return [F.col("exact").desc(), F.col("similarity").desc(), *[F.col(c) for c in ORDER]]


def capped(ruled: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates in the rule's order."""
    return ruled.orderBy(*in_rule_order()).limit(most)


def one_to_one(judged: DataFrame) -> DataFrame:
    """Results by confidence, one use of a table's field on either side."""
    order = F.struct((-F.col("confidence")).alias("c"), (~F.col("exact")).alias("e"), (-F.col("similarity")).alias("s"), *ORDER)
    return greedy(judged, ["source_table", "source_field"], ["target_table", "target_field"], order)


def batch_numbers(rows: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """The batch of each row, in the given order."""
    return numbered(rows, order).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("long")).drop("n")


def n_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """How many field pairs there are, from counts alone."""
    pairs = table_pairs(source, target)
    return pairs.agg(F.coalesce(F.sum(F.col("source_fields") * F.col("target_fields")), F.lit(0)).cast("long").alias("n_pairs"))
