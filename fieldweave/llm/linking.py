"""Candidate pairs from blocks, verified until no link between components is missing.

A block holds the nodes that share a key. Its rows are swept against a pivot: linear in
the block, whatever its size. Where most keys are of one node, the rows cross as arrays in
buckets of keys, and only the others become rows. Verified links join into components, and
the blocks that still hold several components give the pairs across them, which are
verified too. A pair inside a component is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from ..sources.shared import Scratch, partitions
from .slices import map_slices

#: A link: 100 * intersection >= PERCENT * union; sizes then differ by no more either.
PERCENT = 75


#: Rows that a task packs together, rows of a bucket, and how many times as many a worker holds.
PACK, BUCKET, OVERFULL = 1 << 19, 1 << 19, 4


#: Star rounds before the pairs across components.
ROUNDS = 4


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, node, n, pos, c) grouped by key: those of keys with two nodes or more, each with
    its key's pivot, the first row of the key. A row whose size rules a link to the pivot
    out, or that is of the pivot's component c, is given as its own pivot. The last row of a
    batch waits for the next one, which tells whether its key goes on."""
    names = ("key", "node", "n", "pos", "c")
    pivot, wait, wait_new = (None, 0, 0, 0, 0), None, True

    def given(rows: list[tuple[int, int, int, int, int]]) -> pd.DataFrame:
        nonlocal pivot
        pivots = []
        for row in rows:
            key, node, n, _, c = row
            if pivot[0] != key:
                pivot = row
            apart = pivot[4] != c and 100 * pivot[2] >= PERCENT * n and 100 * n >= PERCENT * pivot[2]
            pivots.append((pivot[1], pivot[2]) if apart else (node, n))
        out = pd.DataFrame(rows, columns=names)
        out[["pivot", "pivot_n"]] = pivots
        return out

    for batch in batches:
        columns = [batch[c].to_numpy(np.int64) for c in names]
        if wait is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(wait, columns, strict=True)]
        keys = columns[0]
        if not len(keys):
            continue
        again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (columns[1][1:] == columns[1][:-1])])
        columns = [c[~again] for c in columns]
        keys = columns[0]
        new = np.concatenate([[wait_new if wait is not None else True], keys[1:] != keys[:-1]])
        keep = np.flatnonzero(~new[:-1] | ~new[1:])
        wait, wait_new = tuple(int(c[-1]) for c in columns), bool(new[-1])
        if len(keep):
            yield given(list(zip(*(c[keep].tolist() for c in columns), strict=True)))
    if wait is not None and not wait_new:
        yield given([wait])


def _swept(rows: DataFrame, turn: int) -> DataFrame:
    """``rows`` swept in an order of nodes that is alike for all keys: the most ``central``
    first if that column is there, else in an order that each turn draws anew."""
    at = [F.col("central").desc()] if "central" in rows.columns else []
    dealt = rows.repartition(partitions(rows.sparkSession), "key").withColumn("_at", F.xxhash64(F.lit(turn), F.col("node")))
    if "c" not in rows.columns:
        dealt = dealt.withColumn("c", F.col("node"))
    if "pos" not in rows.columns:
        dealt = dealt.withColumn("pos", F.lit(0))
    return (
        dealt.sortWithinPartitions("key", *at, "_at", "node").select("key", "node", "n", "pos", "c")
        .mapInPandas(sweep, "key long, node long, n int, pos int, c long, pivot long, pivot_n int")
    )


def _central(left: DataFrame) -> DataFrame:
    """``left`` with ``central``, the rows that a node meets over all its keys: the source of
    a group of near copies meets most, and more of the group is linked to it than to others."""
    sizes = left.groupBy("key").agg(F.count("*").alias("size"))
    of_node = left.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("central"))
    return left.join(of_node, "node")


def blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (key, node, n, pos) of keys that several nodes share, with their pivots; rows
    that repeat a node in a key count once. ``pos`` is 0, or, where keys are elements in one
    order for all nodes, the key's place among the node's n."""
    return scratch.keep(_swept(rows, 0).drop("c"), "blocks")


def pack(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Rows (key, node, n) as arrays of up to PACK rows, cut into ``buckets`` ranges of keys."""
    held, size = [], 0

    def packed() -> pd.DataFrame:
        keys, nodes, ns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, nodes, ns = keys[order], nodes[order], ns[order]
        # The highest 32 bits of a key, as a share of their range.
        bucket = ((keys >> 32) + (1 << 31)) * buckets >> 32
        at = np.flatnonzero(_changes(bucket)).tolist()
        spans = list(zip(at, [*at[1:], len(keys)], strict=True))
        return pd.DataFrame({"bucket": bucket[at], **{c: [x[a:b].tobytes() for a, b in spans] for c, x in (("keys", keys), ("nodes", nodes), ("ns", ns))}})

    for batch in batches:
        held.append((batch["key"].to_numpy(np.int64), batch["node"].to_numpy(np.int64), batch["n"].to_numpy(np.int32)))
        size += len(batch)
        if size >= PACK:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first one does."""
    return np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]


def sweep_bucket(keys: np.ndarray, nodes: np.ndarray, ns: np.ndarray) -> pd.DataFrame:
    """The rows of keys with two nodes or more, with their pivots: as ``sweep``, with the
    nodes' own order (they are hashes) and each node a component of its own."""
    order = np.argsort(keys)
    other = _changes(keys[order])
    at = order[~other | ~np.append(other[1:], True)[: len(other)]]
    at = at[np.lexsort((nodes[at], keys[at]))]
    key, node, n = keys[at], nodes[at], ns[at].astype(np.int64)
    fresh = _changes(key) | _changes(node)
    key, node, n = key[fresh], node[fresh], n[fresh]
    new = _changes(key)
    several = ~new | ~np.append(new[1:], True)[: len(new)]
    key, node, n = key[several], node[several], n[several]
    starts = np.flatnonzero(_changes(key))
    first = np.repeat(starts, np.diff(np.append(starts, len(key))))
    near = (100 * n[first] >= PERCENT * n) & (100 * n >= PERCENT * n[first])
    rows = {"key": key, "node": node, "n": n, "pos": 0, "pivot": np.where(near, node[first], node), "pivot_n": np.where(near, n[first], n)}
    return pd.DataFrame({**rows, "swept": True})


def sweep_packed(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The swept rows of packed rows grouped by bucket. A bucket of more than ``most`` rows
    is not held: its rows are given as they are, not swept."""
    held, size, at = [], 0, None

    def arrays() -> list[np.ndarray]:
        return [np.concatenate([np.frombuffer(row[i], t) for row in held]) for i, t in enumerate((np.int64, np.int64, np.int32))]

    def raw() -> pd.DataFrame:
        key, node, n = arrays()
        return pd.DataFrame({"key": key, "node": node, "n": n, "pos": 0, "pivot": node, "pivot_n": n, "swept": False})

    for batch in batches:
        for bucket, *row in zip(*(batch[c] for c in ("bucket", "keys", "nodes", "ns")), strict=True):
            if bucket != at:
                if held:
                    yield sweep_bucket(*arrays())
                held, size, at = [], 0, bucket
            held.append(row)
            size += len(row[2]) // 4
            if size > most:
                yield raw()
                held = []
    if held:
        yield sweep_bucket(*arrays())


def packed_blocks(source: DataFrame, rows_of: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], count: int, scratch: Scratch) -> DataFrame:
    """``blocks`` of the rows (key, node, n) that ``rows_of`` gives for ``source``, some
    ``count`` of them, with keys and nodes that are hashes. Keys of a single node, most of
    them, never become rows of a plan. Rows of buckets that a few keys fill beyond OVERFULL
    times the usual size are sorted by the plan, which can spill."""
    n = partitions(scratch.spark)
    buckets = n * max(1, -(-count // (n * BUCKET)))
    packed = map_slices(source, lambda frames: pack(rows_of(frames), buckets), "bucket long, keys binary, nodes binary, ns binary")
    dealt = packed.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")
    schema = "key long, node long, n int, pos int, pivot long, pivot_n int, swept boolean"
    found = scratch.keep(map_slices(dealt, lambda frames: sweep_packed(frames, OVERFULL * BUCKET), schema), "buckets")
    if not found.where("NOT swept").head(1):
        return found.drop("swept")
    rest = _swept(found.where("NOT swept").select("key", "node", "n"), 0).drop("c")
    return scratch.keep(found.where("swept").drop("swept").unionByName(rest), "blocks")


Enough = Callable[[Column, Column, Column], Column]


def linked_components(
    shared: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, enough: Enough = lambda keys, n, m: F.lit(True), sketches: DataFrame | None = None
) -> DataFrame:
    """(node, component) of every node with a link.

    ``shared`` comes from ``blocks``; ``verify`` adds ``linked`` to pairs (a, b), a < b.
    ``enough`` (of the number of keys that a pair shares, and its sizes) is false only for
    pairs that cannot be linked if those are all their keys. In each of some rounds a node
    is compared with the pivot of another component that it shares most keys with. The
    counts are of some keys only, so what they rule out is left to the pairs across
    components; the rounds make those pairs few, and leave out none. ``sketches`` (node and
    long columns, the words of a bit set) is for keys that unlike nodes share in numbers: bit
    i is set if any of the node's n elements falls into slot i. Sketches differ in no more
    bits than sets in elements, so pairs that differ in too many are no links and are not formed.
    """
    stars, left, tried, links, found = shared, None, None, None, None
    for turn in range(1, ROUNDS + 1):
        counts = stars.where("node <> pivot").groupBy("node", "pivot", "n", "pivot_n").agg(F.count("*").alias("keys"))
        best = (
            counts.where(enough(F.col("keys"), F.col("n"), F.col("pivot_n")))
            .groupBy("node").agg(F.max_by("pivot", F.struct("keys", "pivot")).alias("pivot"))
        )
        pairs = best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        new = scratch.keep(verify(scratch.keep(pairs, "pairs")), "tried")
        tried = new if tried is None else tried.union(new)
        n_new, n_linked = new.agg(F.count("*"), F.count_if("linked")).first()
        if turn == 1 or n_linked:
            links = tried.where("linked").select("a", "b")
            found = scratch.keep(components(links, scratch), "components")
            apart = scratch.keep(_apart(shared, found), "apart")
            if left is not None:
                scratch.free(left)
            left = apart
        if turn == ROUNDS or 20 * n_linked <= n_new:
            break
        stars = _swept(_central(left) if turn % 2 else left, turn)

    rest = left if sketches is None else left.join(sketches, "node")
    x, y = rest.alias("x"), rest.alias("y")
    size = F.lit(PERCENT) * (F.col("x.n") + F.col("y.n"))
    near = (100 * F.col("x.n") >= PERCENT * F.col("y.n")) & (100 * F.col("y.n") >= PERCENT * F.col("x.n"))
    if sketches is not None:
        # A link's symmetric difference is at most (100 - PERCENT) / (100 + PERCENT) of n + m.
        words = [c for c in sketches.columns if c != "node"]
        apart = reduce(add, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in words))
        near &= (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("x.n") + F.col("y.n"))
    # From their first common element on, both nodes have the whole overlap of a link left.
    ample = ((100 + PERCENT) * (F.col("x.n") - F.col("x.pos")) >= size) & ((100 + PERCENT) * (F.col("y.n") - F.col("y.pos")) >= size)
    across = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & near & ample)
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    )
    more = scratch.keep(verify(scratch.keep(across, "across")), "more")
    if more.where("linked").head(1):
        found = scratch.keep(components(links.union(more.where("linked").select("a", "b")), scratch), "components")
    scratch.free(left, more)
    return found


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of keys that hold several components, with their component c."""
    labels = found.select(F.col("node").alias("_node"), "component")
    at = shared.select("key", "node", "n", "pos").join(labels, F.col("node") == F.col("_node"), "left")
    at = at.select("key", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    several = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return at.join(several, "key", "left_semi")
