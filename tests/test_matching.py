import random
import time

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import candidates as C
from fieldweave.operators import judge as J
from fieldweave.operators import results as R
from fieldweave.operators import scoring as S
from fieldweave.operators.numbering import numbered
from fieldweave.plans import matching as M
from fieldweave.plans.samples import SOURCE, TARGET
from fieldweave.sources import config, store, xlsx
from fieldweave.sources import dictionary as D
from fieldweave.streaming.rate_control import Rule

#: Base similarity of the sample dictionaries, tokens split on underscores.
GOLDEN = {
    ("XSBH", "XH"): 0.406667, ("XSBH", "XDRSDM"): 0.188, ("XM", "XM"): 0.66, ("WID", "WID"): 0.992, ("WID", "FB_TIME"): 0.106667,
    ("QKLX", "WID"): 0.012632, ("LOGIN_TIME", "FB_TIME"): 0.448902, ("LOGIN_TIME", "XDRSDM"): 0.073, ("XM", "XH"): 0.22,
}


def sample(spark):
    return (D.prepare(D.from_rows(spark, r), split="simple") for r in (D.SAMPLE_SOURCE, D.SAMPLE_TARGET))


def test_golden_similarity(spark):
    got = {(r.source_field, r.target_field): r.similarity for r in S.similarity_pairs(*sample(spark)).collect()}
    assert len(got) == 25
    for pair, value in GOLDEN.items():
        assert got[pair] == pytest.approx(value, abs=1e-6)


def test_threshold_filter_loses_nothing(spark):
    source, target = sample(spark)
    whole = {(r.source_field, r.target_field) for r in S.similarity_pairs(source, target).where("similarity >= 0.4").collect()}
    assert {(r.source_field, r.target_field) for r in S.similarity_pairs(source, target, threshold=0.4).collect()} == whole
    assert len(whole) == 4


def test_enhanced_smoke_pair(spark):
    a = D.prepare(D.from_rows(spark, [("t", "", "id", "标识符", "VARCHAR")]), enable_abbreviation=False).withColumn("tokens", F.array().cast("array<string>"))
    b = D.prepare(D.from_rows(spark, [("u", "", "ID", "主键", "VARCHAR")]), enable_abbreviation=False).withColumn("tokens", F.array().cast("array<string>"))
    assert S.similarity_pairs(a, b, "enhanced").first().similarity == pytest.approx(0.693, abs=1e-6)


def test_weights():
    with pytest.raises(ValueError):
        S.checked_weights((0.5, 0.5, 0.5))
    assert sum(S.scaled_weights((1, 1, 2))) == pytest.approx(1)


def test_dictionary_order_and_nulls(spark):
    rows = [("b", None, "x", None, None), ("a", "A", "y", "d", "INT"), ("b", "B", "z", "", ""), ("b", "B", "x", "again", "")]
    got = D.ordered(D.from_rows(spark, rows)).orderBy("table_ord", "field_ord").collect()
    assert [(r.table_ord, r.field_ord, r.table_name, r.name, r["desc"]) for r in got] == [(0, 0, "b", "x", ""), (0, 1, "b", "z", ""), (0, 2, "b", "x", "again"), (1, 0, "a", "y", "d")]
    assert D.first_of_name(D.ordered(D.from_rows(spark, rows))).where("name = 'x'").first()["desc"] == ""
    assert D.prepare(D.from_rows(spark, []), False).count() == 0


def greedy_by_hand(edges):
    used_s, used_t, out = set(), set(), []
    for e in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if e[0] not in used_s and e[1] not in used_t:
            used_s.add(e[0]), used_t.add(e[1]), out.append(e)
    return sorted(out)


@pytest.mark.parametrize("fold_rows", [10_000, 0])
def test_greedy_rounds_equal_the_fold(spark, fold_rows):
    rng = random.Random(1)
    edges = sorted({(f"s{rng.randint(0, 12)}", f"t{rng.randint(0, 12)}", round(rng.random(), 1)) for _ in range(120)})
    edges = list({(s, t): (s, t, v) for s, t, v in edges}.values())
    df = spark.createDataFrame(edges, "s string, t string, v double")
    got = C.greedy(df, ["s"], ["t"], F.struct((-F.col("v")).alias("v"), "s", "t"), fold_rows)
    assert sorted(map(tuple, got.collect())) == greedy_by_hand(edges)
    assert C.greedy(df.limit(0), ["s"], ["t"], F.struct("v", "s", "t"), fold_rows).count() == 0 if fold_rows else True


def test_assignment_vector(spark):
    edges = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("b", "y", 0.6), ("c", "z", 0.5)]
    df = spark.createDataFrame(edges, "s string, t string, v double")
    got = C.greedy(df, ["s"], ["t"], F.struct((-F.col("v")).alias("v"), "s", "t"))
    assert sorted(r.v for r in got.collect()) == [0.5, 0.6, 0.9]


def test_rule_keeps_equal_names_and_uses_others_once(spark):
    rows = [("t1", "id", "u1", "ID", 0.9), ("t1", "id", "u2", "id", 0.5), ("t1", "a", "u1", "b", 0.8), ("t2", "a", "u2", "c", 0.7), ("t2", "d", "u1", "id", 0.99)]
    df = spark.createDataFrame([(0, i, i, i, i, *r) for i, r in enumerate(rows)], ", ".join([*(f"{c} long" for c in C.ORDER), "source_table string", "source_field string", "target_table string", "target_field string", "similarity double"]))
    pairs = lambda x: sorted((r.source_table, r.source_field, r.target_field) for r in x.collect())
    assert pairs(C.matching_rule(df)) == [("t1", "a", "b"), ("t1", "id", "ID"), ("t1", "id", "id")]
    assert ("t2", "a", "c") in pairs(C.matching_rule(df, scope="table"))
    assert [r.similarity for r in C.capped(C.matching_rule(df), 2).collect()] == [0.9, 0.5]


#: A response, its similarity, and what the base, strict and lenient parsers make of it.
PARSED = [
    ("判断：是\n置信度：0.92\n理由：语义等价", 0.41, (True, 0.92), (True, 0.92), (True, 0.92)),
    ("判断：否\n置信度：0.15\n理由：不匹配", 0.2, (False, 0.15), (False, 0.15), (True, 0.6)),
    ("判断: 是\n理由: ok", 0.5, (True, 0.8), (True, 0.7), (True, 0.7)),
    ("判断：[是]\n置信度：[0.9]\n理由：x", 0.3, (False, 0.0), (False, 0.3), (False, 0.3)),
    ("判断：是\n置信度：0.9.\n理由：y", 0.5, (True, 0.8), (True, 0.7), (True, 0.7)),
    ("判断：是\n置信度：0\n理由：z", 0.5, (True, 0.8), (True, 0.7), (True, 0.7)),
    ("结论：是\n置信度：95\n理由：w", 0.5, (False, 95.0), (False, 95.0), (True, 1.0)),
    ("判断：否\n置信度：0.3", 0.6, (False, 0.3), (False, 0.3), (False, 0.3)),
    ("错误：429", 0.5, (False, 0.0), None, None),
]


@pytest.mark.parametrize("k,variant", [(2, "base"), (3, "strict"), (4, "lenient")])
def test_parsers(spark, k, variant):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(PARSED)], "i int, r string, s double")
    for row in df.select("i", J.parse(variant, F.col("r"), F.col("s")).alias("v")).collect():
        if (expected := PARSED[row.i][k]) is not None:
            assert (row.v.match, row.v.confidence) == (expected[0], pytest.approx(expected[1])), PARSED[row.i]
    strict = df.select("i", J.parse("lenient", F.col("r"), F.col("s"), lenient=False).alias("v")).where("i = 1").first()
    assert not strict.v.match


FALLBACKS = {
    "fixed": {0.85: (True, 0.8), 0.8: (True, 0.7), 0.65: (True, 0.7), 0.6: (False, 0.6), 0.3: (False, 0.3)},
    "enhanced": {0.8: (True, 0.8), 0.6: (True, 0.7), 0.45: (True, 0.6), 0.3: (False, 0.3)},
    "robust": {0.85: (True, 0.75), 0.65: (True, 0.7), 0.45: (False, 0.36), 0.3: (False, 0.24)},
    "ultra": {0.85: (True, 0.8), 0.65: (True, 0.7), 0.45: (False, 0.45), 0.3: (False, 0.3)},
    "similarity": {0.85: (True, 0.8), 0.45: (True, 0.7), 0.3: (True, 0.6)},
    "pipeline": {0.85: (True, 0.85), 0.8: (False, 0.8)},
}


@pytest.mark.parametrize("variant", sorted(FALLBACKS))
def test_fallback_vectors(spark, variant):
    df = spark.createDataFrame([(s, "qqq", "www", "", "") for s in FALLBACKS[variant]], "similarity double, s_name string, t_name string, s_desc string, t_desc string")
    for r in df.select("similarity", J.fallback(variant).alias("v")).collect():
        match, confidence = FALLBACKS[variant][r.similarity]
        assert (r.v.match, r.v.confidence) == (match, pytest.approx(confidence))
    if variant in ("fixed", "enhanced", "robust", "ultra"):
        same = df.withColumn("t_name", F.col("s_name")).select(J.fallback(variant).alias("v")).first()
        assert (same.v.match, same.v.confidence) == (True, 0.95)


def test_http_judge_with_a_fake_client_and_cache(spark):
    def send(text):
        return "判断：是\n置信度：0.9\n理由：好" if "c_name" in text else "错误：500"

    judge = J.HttpJudge(send=send, min_interval_s=0.0, attempts=0)
    done = M.run(D.from_rows(spark, SOURCE), D.from_rows(spark, TARGET), judge=judge)
    by = {r.source_field: r for r in done.judged.collect()}
    assert (by["c_name"].confidence, by["c_name"].fallback) == (0.9, False)
    assert by["p_type"].fallback and by["p_type"].error_msg == "错误：500"
    assert done.fresh.count() == 1
    again = M.run(D.from_rows(spark, SOURCE), D.from_rows(spark, TARGET), judge=J.RuleJudge(), cached=done.fresh)
    assert [(r.source_field, r.confidence) for r in again.judged.where("cached").collect()] == [("c_name", 0.9)]


def test_candidate_without_a_field_is_an_error_row(spark):
    rows = spark.createDataFrame([("t", "f", "u", "g", 0.9)], "source_table string, source_field string, target_table string, target_field string, similarity double")
    empty = D.prepare(D.from_rows(spark, []))
    v = J.RuleJudge().judge(J.with_fields(rows, empty, empty)).first()
    assert (v.match, v.confidence, v.is_error) == (False, 0.0, True)


@pytest.mark.parametrize("preset", sorted(M.PRESETS))
def test_presets_run(spark, preset):
    done = M.run(D.from_rows(spark, SOURCE), D.from_rows(spark, TARGET), M.PRESETS[preset])
    assert done.statistics.count() == 1
    assert done.results.count() <= done.judged.count() <= done.candidates.count()
    keys = done.results.select("source_table", "source_field")
    assert keys.count() == keys.distinct().count()


def test_empty_dictionaries(spark):
    done = M.run(D.from_rows(spark, []), D.from_rows(spark, TARGET), M.PRESETS["stable"])
    assert (done.results.count(), done.tiers.count(), done.statistics.first().candidates) == (0, 0, 0)
    assert R.tier_counts(done.tiers).agg(F.sum("n")).first()[0] == 0


def test_files_and_sinks(spark, tmp_path):
    for name, rows in (("s", SOURCE), ("t", TARGET)):
        book = xlsx.workbook({"字典": [list(D.HEADERS), *map(list, rows)]})
        (tmp_path / f"{name}.xlsx").write_bytes(book)
        D.from_rows(spark, rows).orderBy("row_ord").select(*[F.col(c).alias(h) for h, c in D.HEADERS.items()]).coalesce(1).write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    a, b = (D.ordered(D.read_dictionary(spark, str(tmp_path / f"s.{e}"))).orderBy("table_ord", "field_ord").collect() for e in ("xlsx", "csv"))
    assert a == b and len(a) == 16
    assert D.paired_read(spark, str(tmp_path / "s.csv"), str(tmp_path / "t.csv")).count() == 31
    out = M.match_files(spark, str(tmp_path / "s.xlsx"), str(tmp_path / "t.xlsx"), str(tmp_path / "out"), "enhanced", cache=str(tmp_path / "cache"), workbooks=True)
    assert spark.read.json(out["statistics"]).count() > 10
    rows = list(xlsx.sheet_rows(open(out["workbook"], "rb").read(), "统计信息"))
    assert rows[0] == ["统计项目", "数值"]
    spark.dataSource.register(xlsx.XlsxSource)
    spark.createDataFrame([("a", 1), ("<&>", 2)], "x string, y int").coalesce(1).write.format("xlsx").mode("append").save(str(tmp_path / "w.xlsx"))
    assert list(xlsx.sheet_rows((tmp_path / "w.xlsx").read_bytes())) == [["x", "y"], ["a", "1"], ["<&>", "2"]]
    assert store.read_cache(spark, str(tmp_path / "none")).count() == 0
    assert len(list(xlsx.sheet_rows(xlsx.workbook({})))) == 0


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("thresholds:\n  similarity_threshold: 0.2\nopenai:\n  api_key: secret\n")
    c = config.load(str(path))
    assert c.thresholds.similarity_threshold == 0.2 and c.system.batch_size == 5 and "secret" not in repr(c)
    assert c.with_thresholds(confidence_threshold=0.9).thresholds.confidence_threshold == 0.9
    with pytest.raises(ValueError):
        config.from_dict({"thresholds": {"nope": 1}})
    with pytest.raises(FileNotFoundError):
        config.require_files(str(path), str(tmp_path / "missing"))
    assert C.picks("1, 3, x, 9", 3) == [0, 2]


def test_command_line(spark, tmp_path, capsys):
    from fieldweave.__main__ import main

    for name, rows in (("s", SOURCE), ("t", TARGET)):
        (tmp_path / f"{name}.xlsx").write_bytes(xlsx.workbook({"x": [list(D.HEADERS), *map(list, rows)]}))
    for preset, extra in (("base", []), ("stable", ["--auto", "--max-llm", "5"])):
        assert main(["--source", str(tmp_path / "s.xlsx"), "--target", str(tmp_path / "t.xlsx"), "--output", str(tmp_path / preset), "--preset", preset, *extra]) == 0
    assert "candidates" in capsys.readouterr().out


def test_bounds_lose_no_pair(spark):
    """No pair at or above a threshold falls to the length bounds, in either family."""
    source, target = (D.prepare(D.from_rows(spark, rows)) for rows in (SOURCE, TARGET))
    for family in ("base", "enhanced"):
        every = {tuple(r[c] for c in S.PAIR): r.similarity for r in S.similarity_pairs(source, target, family).collect()}
        for least in (0.3, 0.5, 0.7):
            got = S.similarity_pairs(source, target, family, threshold=least).collect()
            assert {tuple(r[c] for c in S.PAIR) for r in got} == {k for k, v in every.items() if v >= least}


def test_numbers_and_totals(spark):
    rows = [(i * 37 % 101, i % 3 == 0) for i in range(101)]
    out = {r.seq: (r.n, r.n_total) for r in numbered(spark.createDataFrame(rows, "seq int, ok boolean").repartition(5), ["seq"], "ok").collect()}
    ordered = sorted(rows)
    assert out == {s: (k + 1, sum(ok for _, ok in ordered[: k + 1])) for k, (s, _) in enumerate(ordered)}
    assert numbered(spark.createDataFrame([], "seq int"), ["seq"]).count() == 0


def test_endpoint_follows_the_adaptive_rule(spark, tmp_path):
    log = tmp_path / "log"

    def send(text):
        with open(log, "a") as f:
            print(time.monotonic(), text[-1:], file=f)
        n = sum(1 for _ in open(log))
        return "错误：429 请求频率过高" if n == 1 else "错误：401 API密钥无效" if n == 3 else "判断：是\n置信度：0.9\n理由：x"

    rule = Rule(base_s=0.05, least_s=0.01, retries_s=(0.0, 0.0))
    judge = J.HttpJudge(send=send, attempts=2, rule_of_delay=rule)
    rows = spark.createDataFrame([(f"s{i}", "f", "t", "g", 0.5, "a", "b", "x", "y") for i in range(4)], "source_table string, source_field string, target_table string, target_field string, similarity double, source_field_desc string, target_field_desc string, source_field_type string, target_field_type string")
    rows = rows.coalesce(1)
    answers = sorted(r.response for r in judge.responses(rows).collect())
    assert [a.startswith("错误：401") for a in answers].count(True) == 1 and len(answers) == 4
    at = [float(x.split()[0]) for x in open(log)]
    assert len(at) == 5 and at[2] - at[1] >= 0.09
