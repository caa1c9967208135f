"""Command line: match two data dictionaries."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.judge import HttpJudge
from .operators.results import first_of_tier, tier_counts
from .plans.matching import PRESETS, match_files
from .sources.config import load

TIER_SCHEMA = "source_table string, source_field string, target_table string, target_field string, similarity double, confidence double, reason string, confidence_category string"


def report(spark: SparkSession, saved: dict[str, str], top: int) -> None:
    """Statistics, the most confident results, and the first of each tier, on the console."""
    spark.read.json(saved["statistics"]).show(200, False)
    results = spark.read.json(saved["results"])
    if "confidence" in results.columns:
        shown = [c for c in ("source_table", "source_field", "target_table", "target_field", "confidence", "matching_basis") if c in results.columns]
        results.orderBy(F.col("confidence").desc(), *shown[:4]).select(*shown).limit(top).show(top, False)
    if "tiers" in saved:
        tiers = spark.read.schema(TIER_SCHEMA).parquet(saved["tiers"])
        tier_counts(tiers).show()
        first_of_tier(tiers, 3, [F.col("confidence").desc(), "source_table", "source_field", "target_table", "target_field"]).show(12, False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fieldweave", description=__doc__)
    p.add_argument("--source", required=True, help="source dictionary (csv, json, parquet or xlsx)")
    p.add_argument("--target", required=True, help="target dictionary")
    p.add_argument("--output", default="output", help="folder of the results")
    p.add_argument("--config", help="YAML settings")
    p.add_argument("--preset", choices=sorted(PRESETS), default="base")
    p.add_argument("--auto", action="store_true", help="pick table pairs by similarity")
    p.add_argument("--max-pairs", type=int, help="table pairs at most")
    p.add_argument("--max-llm", type=int, help="candidates put to the judge at most")
    p.add_argument("--base-delay", type=float, help="seconds between calls to an endpoint")
    p.add_argument("--online", action="store_true", help="ask the configured endpoint instead of the rules")
    p.add_argument("--cache", help="table of earlier verdicts")
    p.add_argument("--top", type=int, default=5, help="results shown, and three of each tier")
    p.add_argument("--workbooks", action="store_true", help="write xlsx files too")
    a = p.parse_args(argv)
    config = load(a.config)
    judge = None
    if a.online:
        e = config.openai
        judge = HttpJudge(e.api_base_url, e.api_key, e.model, e.temperature, e.max_tokens, e.timeout_s, batch_size=config.system.batch_size)
        judge = replace(judge, min_interval_s=a.base_delay) if a.base_delay else judge
    changes = {k: v for k, v in (("pairs", "best" if a.auto else None), ("max_pairs", a.max_pairs), ("max_judged", a.max_llm)) if v is not None}
    spark = SparkSession.builder.appName("fieldweave").getOrCreate()
    saved = match_files(spark, a.source, a.target, a.output, a.preset, config, judge, a.cache, a.workbooks, **changes)
    for kind, path in saved.items():
        print(f"{kind}: {path}")
    report(spark, saved, a.top)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
