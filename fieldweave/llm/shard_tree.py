"""Shards by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions of racks of shards, each shard with a weight and each inner node the
sum below it. A document descends level by level: every child draws ln(u) / weight, with u
in (0, 1) from a hash of the document's id and the child's name, and the largest draw
wins. A child's draw depends on its own name and weight alone, so changing a weight can
only move documents into or out of the subtrees whose weights changed.

The default tree fills regions of ``REGION_SHARDS``. Where the next shard opens a region, the
law is `key`: id and shard count decide, and as the new region is drawn against the old ones
alone, one more shard takes documents only into itself. At other counts the next shard
stands inside a region, moves are confined to that region's subtree, and the law is named
`subtree`.

Defined results: a null text has no bytes (size 1, crc32 0); a null id draws as the text
"null"; rows that repeat an id share its shard and get slots of their own; ties of draws
go to the child named last; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import partitions, small
from .text import let

REGION_SHARDS, RACK_SHARDS = 8, 4


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int, weights: dict[int, float] | None = None) -> tuple[Shard, ...]:
    """Shards 0 to ``n_shards`` - 1 in racks of RACK_SHARDS and regions of REGION_SHARDS."""
    return tuple(Shard(k // REGION_SHARDS, k // RACK_SHARDS, k, (weights or {}).get(k, 1.0)) for k in range(n_shards))


def _draw(key: Column, name: str, weight: float) -> Column:
    """ln(u) / weight; u is an odd multiple of 2^-53, so never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 13), 16, 10).cast("long")
    u = (F.lit(2) * bits + 1).cast("double") / F.lit(float(1 << 53))
    return F.log(u) / F.lit(weight)


def _winner(key: Column, level: str, children: dict[int, float]) -> Column:
    live = {k: w for k, w in sorted(children.items()) if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct(_draw(key, f"{level}{k}", w).alias("draw"), F.lit(k).alias("k")) for k, w in live.items()]
    return F.array_max(F.array(*draws))["k"]


def shard_of(doc_id: Column, shards: tuple[Shard, ...]) -> Column:
    """The shard that ``doc_id`` descends to."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    total: dict[tuple, float] = {}
    for s in shards:
        for node in (("region", s.region), ("rack", s.region, s.rack)):
            total[node] = total.get(node, 0.0) + s.weight

    def pick(chosen: Column, options: list[tuple[int, Column]]) -> Column:
        out = F.lit(None).cast("int")
        for k, value in options:
            out = F.when(chosen == k, value).otherwise(out)
        return out

    def in_rack(region: int, rack: int) -> Column:
        return _winner(key, "shard", {s.shard: s.weight for s in shards if (s.region, s.rack) == (region, rack)})

    def in_region(region: int) -> Column:
        racks = {n[2]: w for n, w in total.items() if n[0] == "rack" and n[1] == region and w > 0}
        return let(_winner(key, "rack", racks), lambda r: pick(r, [(k, in_rack(region, k)) for k in racks]))

    regions = {n[1]: w for n, w in total.items() if n[0] == "region" and w > 0}
    return let(_winner(key, "region", regions), lambda r: pick(r, [(k, in_region(k)) for k in regions])).cast("int")


def with_slots(placed: DataFrame, n_shards: int, shard: str = "shard", order: str = "doc_id") -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    A shard's rows are numbered in as many parts as there are shuffle partitions, and a
    part starts after the rows of those before it; no task holds a whole shard.
    """
    n = partitions(placed.sparkSession)
    parted = placed.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns if c != shard]), F.lit(n)).cast("int"))
    counts = parted.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = parted.withColumn("_i", F.row_number().over(Window.partitionBy(shard, "_part").orderBy(order)) - 1)
    starts = small(starts, n_shards * n)  # a row for each shard and part at most
    return (
        numbered.join(starts, F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        .withColumn("slot", (F.col("_start") + F.col("_i")).cast("long")).drop("_part", "_i", "_s", "_p", "_start")
    )


def assign_shards(docs: DataFrame, n_shards: int = 16, weights: dict[int, float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    now, grown = tree(n_shards, weights), tree(n_shards + 1, weights)
    placed = docs.select(
        "doc_id",
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("subtree" if n_shards % REGION_SHARDS else "key").alias("law"),
        shard_of(F.col("doc_id"), now).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )
    return with_slots(placed, n_shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
