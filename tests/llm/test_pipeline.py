"""The pipeline against plain Python, stage by stage."""

import collections
import itertools

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import contamination, line_dedup, quality_rules

from .edge import edge_docs, empty_docs
from .test_arrow import WORD, grams, groups
from .test_native import lines_by_hand, measures


def test_stages_are_the_wanted_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_each_stage_against_plain_python(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns

    kept = stages["quality_rules"](spark, docs, data).cache()
    verdict = {r.doc_id: r.kept for r in quality_rules.digest(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if verdict[r.doc_id]}
    assert all(not measures(r.text)[-1] for r in kept.collect()) and kept.columns == columns

    shorter = stages["line_dedup"](spark, kept, data).cache()
    expected = lines_by_hand([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(kept).collect()) == expected
    assert shorter.columns == columns and shorter.where(F.col("n_chars") != F.length("text")).count() == 0
    assert shorter.dtypes == docs.dtypes

    single = stages["ngram_join"](spark, shorter, data).cache()
    rows = sorted((r.doc_id, r.text) for r in shorter.collect())
    sets = [grams(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    least = groups(len(rows), links)
    assert {r.doc_id for r in single.collect()} == {rows[i][0] for i in range(len(rows)) if least[i] == i}

    clean = stages["decontamination"](spark, single, data).cache()
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = [grams(r.text) for r in bench.collect()]
    stays = {r.doc_id for r in clean.collect()}
    for r in single.collect():
        assert all(len(next(iter(q))) == 5 for q in items if q)
        assert (r.doc_id in stays) != any(q and 100 * len(q & grams(r.text)) >= 75 * len(q) for q in items)
    assert contamination.contained_items(clean, bench).count() == 0 and clean.columns == columns

    packed = stages["packing"](spark, clean, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    run = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, data).collect()}
    assert run == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


@pytest.mark.parametrize("make", [edge_docs, empty_docs])
def test_edges_pass_all_stages(spark, data, make):
    docs = make(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        if name != "packing":
            assert docs.columns == columns
    assert docs.count() <= 1 or make is edge_docs
    assert WORD.findall(" a ") == ["a"]
