"""Line dedup, shards, quality rules and licences against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import license_scan, line_dedup, quality_rules, shard_tree
from fieldweave.sources.shared import Scratch

from .edge import EDGE, edge_docs, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def test_quality_measures(spark):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.digest(edge_docs(spark)).collect())
    assert got == collections.Counter((i, *measures(t)) for i, t, _ in EDGE)
    assert quality_rules.digest(empty_docs(spark)).count() == 0


def test_both_ways_to_find_repeats_agree(spark):
    texts = ["a b c a b c d", "x x x x x", "a b c d e f", " ".join("ab" [i % 2] for i in range(50)), "q " * 3]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from fieldweave.llm.text import let, words

    got = df.select(
        "text", quality_rules.repeat_words(words(F.col("text"))).alias("n"),
        let(words(F.col("text")), lambda w: F.when(F.size(w) >= 4, let(quality_rules._repeat_starts_by_words(w), quality_rules._covered)).otherwise(0)).alias("m"),
    )
    for r in got.collect():
        assert r.n == r.m == measures(r.text)[4], r


def test_policies_and_ablations(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    entries = quality_rules.ledger(docs).cache()
    kept = quality_rules.apply_policy(entries).where("kept").count()
    assert quality_rules.filter_documents(docs).count() == kept
    assert quality_rules.filter_documents(edge_docs(spark)).columns == edge_docs(spark).columns
    for r in quality_rules.ablations(entries).collect():
        rest = quality_rules.Policy("t", tuple(x for x in quality_rules.POLICY.rules if x != r.rule))
        assert r.n_kept_without == quality_rules.apply_policy(entries, rest).where("kept").count()
        assert r.n_failed == entries.where(F.col("fail_bits").bitwiseAND(F.lit(r.bit)) != 0).count()
    assert kept < quality_rules.apply_policy(entries, quality_rules.BASE_POLICY).where("kept").count()


def test_clean_documents_stay(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = quality_rules.digest(spark.read.parquet(f"{data}/documents.parquet")).join(labels, "doc_id")
    assert kept.where("quality = 1 AND NOT kept AND NOT base_failed").count() == 0
    assert kept.where("quality = 0 AND kept").count() == 0


def lines_by_hand(rows):
    space = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key := lower(line.strip(space))) >= 20:
                held[key].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(lower(x.strip(space)), ())) < 3 or max(held[lower(x.strip(space))]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    rows = [(i, t) for i, t, _ in EDGE]
    rows += [(20 + i, f"  Shared line of more than twenty\t\nown line number {i} is long enough\nshort") for i in range(6)]
    rows += [(40, "shared LINE of more than twenty"), (41, "twice only, but more than twenty"), (42, "twice only, but more than twenty\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, line_dedup.digest(df).collect())) == lines_by_hand(rows)
    clash = edge_docs(spark).withColumn("k1", F.lit("mine")).withColumn("n_lines", F.lit("mine"))
    out = line_dedup.dedup_lines(clash)
    assert out.count() == len(EDGE) and dict(out.dtypes)["k1"] == "string"
    assert line_dedup.digest(empty_docs(spark)).count() == 0


def test_line_runs_by_batch(spark):
    """A line is in the run of the batch that first held it; what the anti-join finds again is an increment."""
    runs = line_dedup.LineRuns(Scratch(spark, "test"))
    batch = lambda *x: spark.createDataFrame(x, "doc_id long, k1 long, k2 long")
    held = lambda levels: {k: sorted(map(tuple, df.collect())) for k, df in levels.items()}
    runs.add(batch((1, 1, 0), (1, 1, 0), (2, 2, 0)))
    runs.add(batch((3, 2, 0), (3, 3, 0)))
    assert held(runs.runs) == {1: [(1, 0, 1, 1), (2, 0, 1, 2), (3, 0, 1, 3)]} and held(runs.increments) == {0: [(2, 0, 1, 3)]}
    runs.add(batch((9, 1, 0), (9, 4, 0)))
    assert held(runs.runs)[0] == [(4, 0, 1, 9)] and held(runs.increments) == {1: [(1, 0, 1, 9), (2, 0, 1, 3)]}
    total = {r.k1: (r.n_docs, r.keep_doc) for r in runs.compact().collect()}
    assert total == {1: (2, 9), 2: (2, 3), 3: (1, 3), 4: (1, 9)}
    tables = [r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("line_run_")]
    runs.close()
    assert len(tables) == 1 and not spark.catalog.tableExists(tables[0])


def shard_by_hand(doc_id, n):
    shards = [(k // 8, k // 4, k) for k in range(n)]

    def draw(name, weight):
        bits = int(hashlib.md5(f"{'null' if doc_id is None else doc_id}/{name}".encode()).hexdigest()[:13], 16)
        return math.log((2 * bits + 1) / (1 << 53)) / weight

    for level, name in enumerate(("region", "rack", "shard")):
        count = collections.Counter(s[level] for s in shards)
        best = max(count, key=lambda k: (draw(f"{name}{k}", count[k]) if len(count) > 1 else 0, k))
        shards = [s for s in shards if s[level] == best]
    return shards[0][2]


def test_draws_against_plain_python(spark):
    ids = [None, *range(-3, 700), 2**60]
    rows = shard_tree.assign_shards(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {i: (shard_by_hand(i, 16), shard_by_hand(i, 17)) for i in ids}
    other = shard_tree.assign_shards(spark.range(300).selectExpr("id AS doc_id", "'x' AS text"), 17).collect()
    assert {r.law for r in other} == {"subtree"} and all(r.shard == shard_by_hand(r.doc_id, 17) for r in other)
    assert all(r.grown_shard // 8 in (r.shard // 8, 2) for r in other)


def test_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("té "), "id")).alias("text"))
    rows = shard_tree.assign_shards(docs).collect()
    assert len(rows) == 4000
    for r in rows:
        raw = (f"té {r.doc_id}" if r.doc_id % 7 else "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.4 * 250
    assert 120 < sum(r.grown_shard == 16 for r in rows) < 360
    edge = shard_tree.assign_shards(edge_docs(spark)).collect()
    assert len(edge) == len(EDGE) and shard_tree.assign_shards(empty_docs(spark)).count() == 0


def test_weight_changes_move_only_into_or_out_of_their_subtree(spark):
    ids = spark.range(3000)
    before, after = shard_tree.tree(16), shard_tree.tree(16, {5: 3.0})
    moved = ids.select(shard_tree.shard_of(F.col("id"), before).alias("a"), shard_tree.shard_of(F.col("id"), after).alias("b")).where("a <> b").collect()
    region = lambda s: s // shard_tree.REGION_SHARDS
    assert moved and all(region(r.b) == region(5) for r in moved)
    assert all(r.a // 8 != r.b // 8 or r.a // 4 == r.b // 4 == 1 or r.b // 4 == 1 for r in moved)
    drained = ids.select(shard_tree.shard_of(F.col("id"), shard_tree.tree(16, {5: 0.0})).alias("s")).where("s = 5").count()
    assert drained == 0


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "word word Released under the BSD License. more words": "BSD", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "Apache-2.0",
    "Licensed under the Zolo License, version 4.": "unknown", "She renewed her license to drive a bus.": "unknown", "Nothing to see here.": "none", "": "none",
}


def test_licences(spark):
    rows = [(i, f"first line\n{t}\nlast") for i, t in enumerate(NOTICES)] + [(50, None), (51, "\n".join(list(NOTICES)[:2]))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows + rows[:1], "doc_id long, text string")).collect()}
    for i, expected in enumerate(NOTICES.values()):
        assert got[i].license == expected, rows[i]
    assert got[50].license == "none" and got[51].families == "Apache-2.0,MIT" and got[51].n_families == 2
    assert license_scan.scan(edge_docs(spark)).count() == len(EDGE)
    assert license_scan.scan(empty_docs(spark)).count() == 0


def test_licence_probabilities_agree_with_the_model(spark):
    m = license_scan.model()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NOTICES)], "row long, text string")
    for r in license_scan.classify(license_scan.proposals(df)).collect():
        text = list(NOTICES)[r.row]
        x = [m.grams[g] for g in license_scan.n_grams(license_scan.word_list(text)) if g in m.grams]
        if x:
            assert r.probability == pytest.approx(max(m.probabilities(x)), abs=1e-6)


def test_held_out_wordings():
    precision, recall = license_scan.evaluate(license_scan.model())
    assert precision >= 0.99 and recall >= 0.95
    assert not {t for t, _ in license_scan.wordings(license_scan.MEASURE)} & {t for part in range(2) for t, _ in license_scan.wordings(part)}
    for family, names in license_scan.NAMES.items():
        assert family in license_scan.TEMPLATES and all(any(a in n for a in license_scan.ANCHORS) for n in names)


def scan_by_hand(text):
    m, found = license_scan.model(), []
    low = (text or "").lower()
    for line in low.split("\n"):
        if any(a in line for a in license_scan.ANCHORS):
            found.append(license_scan.word_list(line))
    ls = [ws for ws in map(license_scan.word_list, low.split("\n")) if ws]
    joined = {}
    for t in (t for ts in license_scan.TEMPLATES.values() for t in ts):
        words = license_scan.word_list(t)
        holds = lambda i, j: len({*words} & {w for ws in ls[i:j] for w in ws}) >= license_scan.CONFIRM * len({*words})  # noqa: B023, E731
        for i in range(len(ls)):
            if not {*words} & {*ls[i]}:
                continue
            j = next((j for j in range(i, min(i + len(words), len(ls) - 1) + 1) if holds(i, j + 1)), i)
            if j > i and sum(map(len, ls[i + 1 : j])) < len(words) and not holds(i + 1, j + 1):
                joined[i, j] = [w for ws in ls[i : j + 1] for w in ws]
    scored = []
    for words in [*found, *joined.values()]:
        family, p = m.classify(" ".join(words))
        if family != "unknown":
            scored.append((license_scan.confirmed(family, " ".join(words)), p, family))
    best = max(scored, default=(False, 0, ""))
    name = "none" if not found and not joined else best[2] if best[0] else "unknown"
    return name, len(found) + len(joined), ",".join(sorted({f for c, _, f in scored if c}))


def test_licences_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = {10**6 + i: "\n".join(f"# {w}" for w in t.replace(";", ";\n").split("\n")) + "\n\nx" for i, t in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts)}
    wrap = {2 * 10**6 + i: " ".join(t.split()[:9]) + "\n  * " + " ".join(t.split()[9:]) for i, t in enumerate(own.values())}
    texts |= own | wrap
    got = license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.license, r.n_proposals, r.families) for r in got} == {i: scan_by_hand(t) for i, t in texts.items()}
    assert sum(r.license not in ("none", "unknown") for r in got if r.doc_id >= 10**6) >= 0.95 * (len(own) + len(wrap))


PROBES = {
    "MIT License\n\nCopyright (c) 2020 X": "MIT", "Released under the terms of the MIT licence": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "License: BSD-3-Clause": "BSD", "Mozilla Public Licence 2.0": "MPL-2.0", "ISC License": "ISC", "Distributed under the Apache 2.0 terms": "Apache-2.0",
    "GPLv3+": "GPL-3.0", "This file is free software under GPL v3": "GPL-3.0", "She studied at MIT.": "none",
}


def test_wordings_that_are_no_templates(spark):
    got = license_scan.scan(spark.createDataFrame(list(enumerate(PROBES)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == dict(enumerate(PROBES.values()))
