import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldweave.functions import pinyin, ratios
from fieldweave.functions.formats import matching_basis, percent, run_stamp, squeezed
from fieldweave.sources.dictionary import tokens


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return 1.0 if not a and not b else 2 * row[-1] / (len(a) + len(b))


@given(st.text("abcd学", max_size=12), st.text("abcd学", max_size=12))
def test_bit_parallel_lcs(a, b):
    assert ratios.lcs_ratio(a, b) == pytest.approx(lcs_table(a, b))
    assert ratios.lcs_ratio(a, b) == pytest.approx(ratios.lcs_ratio(b, a))


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_gestalt_is_within_its_bound(a, b):
    bound = 1.0 if not a and not b else 2 * min(len(a), len(b)) / (len(a) + len(b))
    assert 0 <= ratios.gestalt(a, b) <= bound


def test_ratio_vectors(spark):
    pairs = [("abcde", "ace", 0.75), ("xsbh", "xh", 2 / 3), ("kitten", "sitting", 0.615385), ("", "a", 0.0), ("", "", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, e double")
    for r in df.select("e", ratios.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.r == pytest.approx(r.e, abs=1e-6)
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("学生编号", "学号")], "a string, b string").select("a", "b", ratios.gestalt_ratio("a", "b").alias("r"))
    assert [r.r for r in rows.collect()] == pytest.approx([0.25, 0.5, 2 / 3])
    assert all(r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio() for r in rows.collect())


def test_affix_and_containment(spark):
    df = spark.createDataFrame([("create_time", "update_time"), ("a", "ab"), ("abc", "xyz")], "a string, b string")
    got = df.select(ratios.affix_ratio(F.col("a"), F.col("b")).alias("x"), ratios.containment(F.col("a"), F.col("b")).alias("y"), ratios.string_similarity(F.col("a"), F.col("b")).alias("z")).collect()
    assert [r.x for r in got] == pytest.approx([8 / 11, 0, 0])
    assert [r.y for r in got] == [0.0, 0.8, 0.0]
    assert got[1].z == pytest.approx(2 / 3)


def test_pinyin_vectors(spark):
    table = pinyin.readings()
    assert pinyin.to_pinyin("学生编号", table) == "xueshengbianhao"
    assert pinyin.to_pinyin("ID学号2", table) == "IDxuehao2"
    assert pinyin.to_pinyin("登录时间", table, " ") == "deng lu shi jian"
    assert pinyin.initials("学生编号", table) == "XSBH"
    assert pinyin.initials("ab-学1", table) == "ABX1"
    assert pinyin.readings(toned=True)["学"] != "xue"


def test_tokens(spark):
    df = spark.createDataFrame([("c_custKey",), ("HTTPServerName",), ("学号_id2",), ("",)], "n string").select(tokens(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == [["c", "cust", "key"], ["http", "server", "name"], ["学号", "id2"], []]


def test_formats(spark):
    one = spark.range(1).select(
        matching_basis(F.lit("a \n b"), F.lit(0.125), F.lit(0.9)).alias("x"), matching_basis(F.lit("y" * 101), F.lit(0.5), F.lit(None).cast("double")).alias("y"),
        squeezed(F.lit("　a　 b ")).alias("z"), percent(F.lit(1), F.lit(3)).alias("p"), percent(F.lit(1), F.lit(0)).alias("q"), run_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("s"),
    ).first()
    assert one.x == "a b；特征相似度: 0.12；LLM置信度: 0.90"
    assert one.y == "y" * 100 + "...；特征相似度: 0.50；LLM置信度: 0.00"
    assert (one.z, one.p, one.q, one.s) == ("a b", "33.33%", None, "20240102030405")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab_c", max_size=6), st.text("ab_c", max_size=6)), min_size=1, max_size=5))
def test_columns_agree_with_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", ratios.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.r == pytest.approx(ratios.lcs_ratio(r.a, r.b))
