"""The matching pipeline, from dictionaries to results, and its presets.

dictionaries, table pairs, scored pairs over the threshold, the exact/greedy rule, a cap,
the judge, tiers or a threshold, one-to-one, enrichment, statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import judge as J
from ..operators import results as R
from ..operators.scoring import similarity_pairs
from ..sources import store
from ..sources.config import Config
from ..sources.dictionary import prepare
from ..sources.shared import Scratch

Judge = J.RuleJudge | J.ResponseJudge | J.HttpJudge


@dataclass(frozen=True)
class Plan:
    """What a preset fixes; None takes the configuration's value."""

    family: str = "base"
    similarity_threshold: float | None = None
    confidence_threshold: float | None = None
    pairs: str = "all"  # or best, first
    pair_threshold: float = 0.3
    max_pairs: int = 50
    first_tables: int | None = None
    max_judged: int | None = None
    layered: bool = False
    tiers: bool = False
    statistics_threshold: float | None = None
    cache_variant: str = "base"
    rule: str = "fixed"


#: The presets, by what they stand for.
PRESETS = {
    "base": Plan(),
    "direct": Plan(similarity_threshold=0.3, confidence_threshold=0.3, max_judged=20, rule="pipeline"),
    "fixed": Plan(pairs="first", max_pairs=20, max_judged=50, cache_variant="fixed", rule="fixed"),
    "pruned": Plan(pairs="best", pair_threshold=0.3, max_pairs=50, max_judged=100, rule="pipeline"),
    "enhanced": Plan(family="enhanced", pairs="best", pair_threshold=0.2, max_pairs=20, max_judged=50, layered=True, tiers=True, statistics_threshold=0.4, cache_variant="fields", rule="enhanced"),
    "stable": Plan(family="enhanced", pairs="best", pair_threshold=0.2, max_pairs=15, max_judged=30, layered=True, tiers=True, statistics_threshold=0.4, cache_variant="fields", rule="ultra"),
}


@dataclass
class Outcome:
    """What a run gives, as plans over written candidates and verdicts."""

    candidates: DataFrame
    judged: DataFrame
    tiers: DataFrame | None
    results: DataFrame
    statistics: DataFrame
    statistics_sheet: DataFrame
    fresh: DataFrame


def scored(source: DataFrame, target: DataFrame, plan: Plan, config: Config) -> DataFrame:
    """Pairs that reach the similarity threshold, with their ordinals."""
    threshold = config.thresholds.similarity_threshold if plan.similarity_threshold is None else plan.similarity_threshold
    pairs = None
    if plan.pairs == "best":
        pairs = C.best_table_pairs(source, target, plan.pair_threshold, plan.max_pairs)
    elif plan.pairs == "first":
        pairs = C.first_table_pairs(source, target, plan.max_pairs, plan.first_tables)
    return similarity_pairs(source, target, plan.family, config.similarity.weights, config.similarity.pinyin_boost, pairs, threshold)


def run(source_rows: DataFrame, target_rows: DataFrame, plan: Plan = PRESETS["base"], config: Config = Config(), judge: Judge | None = None, cached: DataFrame | None = None) -> Outcome:
    """Match two dictionaries (rows as read). Candidates and verdicts are written once, so
    nothing is scored or asked again by what branches off them."""
    scratch = Scratch(source_rows.sparkSession, "matching")
    chinese = config.chinese
    source, target = (scratch.keep(prepare(x, chinese.enable_pinyin, chinese.enable_abbreviation), "fields") for x in (source_rows, target_rows))
    found = scratch.keep(scored(source, target, plan, config), "candidates")
    ruled = C.matching_rule(found)
    ruled = C.capped(ruled, plan.max_judged) if plan.max_judged else ruled
    judge = judge or J.RuleJudge(plan.rule, config.matching_strategy.enable_aggressive_mode)
    with_meta = J.with_fields(ruled, source, target)
    verdicts, fresh = J.judge_with_cache(with_meta, judge, cached if config.system.cache_enabled else None, plan.cache_variant)
    judged = scratch.keep(verdicts, "judged")

    t = config.thresholds
    confident = t.confidence_threshold if plan.confidence_threshold is None else plan.confidence_threshold
    tiers = R.tiered(judged, t.high_confidence, t.medium_confidence, t.low_confidence) if plan.tiers else None
    chosen = tiers.where("confidence_category = 'high'") if tiers is not None else judged
    results = R.final_results(chosen, source, target, confident)
    counted = confident if plan.statistics_threshold is None else plan.statistics_threshold
    stats = R.statistics(judged, source, target, found, counted)
    sheet = R.statistics_sheet(stats, R.table_pair_counts(judged, counted), R.histogram(judged))
    names = [c.split()[0] for c in J.VERDICT.split(", ")]
    entries = judged.where("NOT cached AND NOT is_error AND NOT coalesce(fallback, false) AND confidence > 0").select("cache_key", *names).dropDuplicates(["cache_key"])
    return Outcome(found, judged, tiers, results, stats, sheet, entries)


def in_judging_order(judged: DataFrame) -> DataFrame:
    """Layer by layer, high similarity first, in the rule's order within a layer."""
    return judged.orderBy(J.layer_rank(F.col("similarity")), *C.in_rule_order())


def match_files(spark: SparkSession, source: str, target: str, output: str, preset: str = "base", config: Config = Config(), judge: Judge | None = None, cache: str | None = None, workbooks: bool = False, **changes) -> dict[str, str]:
    """Read two dictionaries, match, save results; new verdicts go to the ``cache`` table."""
    from ..sources.dictionary import read_dictionary

    plan = replace(PRESETS[preset], **changes)
    held = store.read_cache(spark, cache) if cache else None
    done = run(read_dictionary(spark, source), read_dictionary(spark, target), plan, config, judge, held)
    out = store.save_results(done.results, done.statistics_sheet, done.tiers, output, workbooks=workbooks)
    if cache:
        store.add_to_cache(done.fresh, cache)
    return out
