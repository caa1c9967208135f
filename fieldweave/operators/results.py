"""From verdicts to results: thresholds, tiers, enrichment, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import matching_basis, percent
from .candidates import one_to_one
from .judge import layer, with_fields
from .numbering import numbered

#: Headers of the results sheet and of the tier sheets, in order.
SHEET = {
    "source_table": "源表", "source_field": "源字段", "source_field_desc": "源字段描述", "target_table": "目标表", "target_field": "目标字段",
    "target_field_desc": "目标字段描述", "match": "是否匹配", "confidence": "置信度", "similarity": "相似度", "reason": "理由", "matching_basis": "匹配依据",
}
TIER_SHEET = {k: SHEET[k] for k in ("source_table", "source_field", "target_table", "target_field", "confidence", "similarity", "reason")}
BUCKETS = ("0.9-1.0", "0.8-0.9", "0.7-0.8", "0.6-0.7", "0.5-0.6", "0.0-0.5")


def accepted(judged: DataFrame, threshold: float = 0.7) -> DataFrame:
    return judged.where(F.col("match") & (F.col("confidence") >= threshold))


def tier(confidence: Column, high: float = 0.8, medium: float = 0.6, low: float = 0.4) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").when(confidence >= low, "low").otherwise("potential")


def tiered(judged: DataFrame, high: float = 0.8, medium: float = 0.6, low: float = 0.4) -> DataFrame:
    """Matched rows with their ``confidence_category``."""
    return judged.where("match").withColumn("confidence_category", tier(F.col("confidence"), high, medium, low))


def tier_counts(tiers: DataFrame) -> DataFrame:
    """Counts of all four tiers, absent ones as 0."""
    names = tiers.sparkSession.createDataFrame([("high",), ("medium",), ("low",), ("potential",)], "confidence_category string")
    return names.join(tiers.groupBy("confidence_category").count(), "confidence_category", "left").select("confidence_category", F.coalesce("count", F.lit(0)).alias("n"))


def first_of_tier(tiers: DataFrame, k: int, order: list[Column | str]) -> DataFrame:
    return tiers.withColumn("place", F.row_number().over(Window.partitionBy("confidence_category").orderBy(*order))).where(F.col("place") <= k)


def layer_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(layer(F.col("similarity")).alias("layer")).agg(F.count("*").alias("n"))


def split_by_fallback(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches an endpoint gave, and matches a rule gave."""
    rule = F.coalesce("fallback", F.lit(False))
    return judged.where(F.col("match") & ~rule), judged.where(F.col("match") & rule)


def enriched(results: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Results with both fields' metadata and the matching basis."""
    have = {f"{s}_{c}" for s in ("source", "target") for c in ("field_desc", "field_type", "table_desc")} & set(results.columns)
    return with_fields(results.drop(*have), source, target).withColumn("matching_basis", matching_basis(F.col("reason"), F.col("similarity"), F.col("confidence")))


def final_results(judged: DataFrame, source: DataFrame, target: DataFrame, threshold: float = 0.7) -> DataFrame:
    return enriched(one_to_one(accepted(judged, threshold)), source, target)


def sheet(results: DataFrame, headers: dict[str, str] = SHEET) -> DataFrame:
    """The sheet's columns under their headers; columns the results lack are left out."""
    return results.select(*[F.col(c).alias(h) for c, h in headers.items() if c in results.columns])


def bucket(confidence: Column) -> Column:
    out = F.lit(BUCKETS[-1])
    for least, name in ((0.5, BUCKETS[4]), (0.6, BUCKETS[3]), (0.7, BUCKETS[2]), (0.8, BUCKETS[1]), (0.9, BUCKETS[0])):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def histogram(judged: DataFrame) -> DataFrame:
    """All six buckets with their counts, empty ones as 0."""
    names = judged.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return names.join(judged.groupBy(bucket(F.col("confidence")).alias("bucket")).count(), "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


def table_pair_counts(judged: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Confident matches of each pair of tables."""
    return accepted(judged, threshold).groupBy(F.concat_ws(" <-> ", "source_table", "target_table").alias("table_pair")).agg(F.count("*").alias("n"))


def statistics(judged: DataFrame, source: DataFrame, target: DataFrame, found: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """One typed row. Participants and the candidate count come from the candidates, or from
    the results where there are none."""

    def dictionary(fields: DataFrame, side: str) -> DataFrame:
        return fields.agg(F.countDistinct("table_name").alias(f"{side}_tables"), F.count("*").alias(f"{side}_fields"))

    def members(rows: DataFrame, mark: str) -> DataFrame:
        counts = [F.countDistinct(f"{s}_table").alias(f"{mark}_{s}_tables") for s in ("source", "target")]
        counts += [F.countDistinct(F.struct(f"{s}_table", f"{s}_field")).alias(f"{mark}_{s}_fields") for s in ("source", "target")]
        return rows.agg(F.count("*").alias(f"{mark}_n"), *counts)

    sure = F.col("match") & (F.col("confidence") >= threshold)
    one = (
        dictionary(source, "source").crossJoin(dictionary(target, "target"))
        .crossJoin(members(found if found is not None else judged.limit(0), "c")).crossJoin(members(judged, "r"))
        .crossJoin(judged.agg(F.count_if("match").alias("matched"), F.count_if(sure).alias("high_confidence")))
    )
    some = F.col("c_n") > 0
    either = lambda c: F.when(some, F.col(f"c_{c}")).otherwise(F.col(f"r_{c}")).alias(f"participating_{c}")
    pick = one.select(
        "source_tables", "target_tables", "source_fields", "target_fields",
        *[either(f"{s}_{k}") for s in ("source", "target") for k in ("tables", "fields")],
        F.when(some, F.col("c_n")).otherwise(F.col("r_n")).alias("candidates"), "matched", "high_confidence",
    )
    total = F.col("source_fields") * F.col("target_fields")
    return pick.select(
        "*",
        total.alias("possible_pairs"),
        F.when(total > 0, F.round((1 - F.col("candidates") / total) * 100, 6)).alias("pruned_percent"),
        percent(F.col("high_confidence"), F.col("source_fields")).alias("source_match_rate"),
        percent(F.col("high_confidence"), F.col("target_fields")).alias("target_match_rate"),
        percent(F.col("high_confidence"), F.col("candidates")).alias("candidate_match_rate"),
    )


def statistics_sheet(stats: DataFrame, counts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(统计项目, 数值): the typed row as lines, then the nested counts as 'name - key' lines."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in stats.columns]))
    lines = stats.select(items.alias("i")).select("i.k", "i.v")
    nested = counts.select(F.concat(F.lit("table_pairs - "), "table_pair").alias("k"), F.col("n").cast("string").alias("v"))
    spread = buckets.select(F.concat(F.lit("confidence - "), "bucket").alias("k"), F.col("n").cast("string").alias("v"))
    return lines.unionByName(nested).unionByName(spread).where("v IS NOT NULL").select(F.col("k").alias("统计项目"), F.col("v").alias("数值"))


def judge_counters(judged: DataFrame) -> DataFrame:
    """Calls that succeeded, fell back, failed or came from the cache, with their rates."""
    rule, held = F.coalesce("fallback", F.lit(False)), F.coalesce("cached", F.lit(False))
    n = F.count("*")
    good = F.count_if(~rule & ~F.col("is_error"))
    return judged.agg(
        n.alias("n"), good.alias("succeeded"), F.count_if(rule).alias("fell_back"), F.count_if("is_error").alias("failed"), F.count_if(held).alias("from_cache"),
        F.round(100.0 * good / F.greatest(n, F.lit(1)), 6).alias("success_rate"), F.round(100.0 * F.count_if(held) / F.greatest(n, F.lit(1)), 6).alias("cache_rate"),
    )


def running_success(outcomes: DataFrame, order: str = "seq", every: int = 5) -> DataFrame:
    """(seq, ok) with the running success rate, at every ``every``-th row."""
    rows = numbered(outcomes.select(order, "ok"), [order], "ok").select(order, F.col("n").cast("int").alias("n"), F.col("n_total").alias("n_ok"))
    return rows.where(F.col("n") % every == 0).withColumn("rate", F.round(F.col("n_ok") / F.col("n"), 6))
