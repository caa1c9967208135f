"""Adaptive delay between calls to an endpoint.

The state is (delay, streak). Five successes in a row shorten the delay, a throttled
failure doubles it, any failure ends the streak. One transition function serves a replay of
logged outcomes (a fold in the JVM), and a live stream of outcomes by endpoint (arbitrary
stateful processing with checkpointed state).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Rule:
    base_s: float = 3.0
    least_s: float = 1.0
    most_s: float = 30.0
    streak: int = 5
    faster: float = 0.8
    slower: float = 2.0
    retries_s: tuple[float, ...] = (2.0, 5.0, 10.0)


_THROTTLED = "429|频率|rate"


def throttled(error: Column) -> Column:
    """Whether a failure's text speaks of too many requests."""
    return F.coalesce(F.lower(error).rlike(_THROTTLED), F.lit(False))


def is_throttled(error: str) -> bool:
    return re.search(_THROTTLED, error.lower()) is not None


def step(rule: Rule, delay: float, streak: int, ok: bool, limited: bool) -> tuple[float, int]:
    if ok:
        streak += 1
        return (max(rule.least_s, rule.faster * delay), 0) if streak >= rule.streak else (delay, streak)
    return (min(rule.most_s, rule.slower * delay) if limited else delay), 0


def replay(outcomes: DataFrame, key: str = "endpoint", order: str = "seq", rule: Rule = Rule()) -> DataFrame:
    """(key, delay, streak, n) after all outcomes (key, order, ok, limited) of each key. A
    key's outcomes come together: calls to one endpoint are spaced by the delay itself."""
    log = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "ok", "limited")))
    start = F.struct(F.lit(rule.base_s).alias("delay"), F.lit(0).alias("streak"))

    def fold(s: Column, x: Column) -> Column:
        full = s["streak"] + 1 >= rule.streak
        delay = (
            F.when(x["ok"] & full, F.greatest(F.lit(rule.least_s), s["delay"] * rule.faster))
            .when(~x["ok"] & x["limited"], F.least(F.lit(rule.most_s), s["delay"] * rule.slower)).otherwise(s["delay"])
        )
        return F.struct(delay.alias("delay"), F.when(x["ok"] & ~full, s["streak"] + 1).otherwise(F.lit(0)).alias("streak"))

    folded = outcomes.groupBy(key).agg(log.alias("log")).withColumn("s", F.aggregate("log", start, fold))
    return folded.select(key, F.col("s.delay").alias("delay"), F.col("s.streak").alias("streak"), F.size("log").cast("long").alias("n"))


def live(outcomes: DataFrame, key: str = "endpoint", rule: Rule = Rule()) -> DataFrame:
    """A stream of (key, seq, ok, limited) as a stream of each key's (key, delay, streak, n)."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay, streak, n = state.get if state.exists else (rule.base_s, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for ok, limited in zip(rows["ok"], rows["limited"], strict=True):
            delay, streak = step(rule, delay, streak, bool(ok), bool(limited))
            n += 1
        state.update((delay, streak, n))
        yield pd.DataFrame([(*name, delay, streak, n)], columns=[key, "delay", "streak", "n"])

    kind = dict(outcomes.dtypes)[key]
    return outcomes.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, delay double, streak int, n long", "delay double, streak int, n long", "update", GroupStateTimeout.NoTimeout
    )


def retry_schedule(attempts: int = 3, base: float = 2.0) -> Column:
    """Seconds before each repeated attempt, doubling, without the random part."""
    return F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda n: F.lit(base) * F.pow(F.lit(2.0), n - 1))
