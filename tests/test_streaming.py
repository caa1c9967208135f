import pytest
from pyspark.sql import functions as F

from fieldweave.streaming import rate_control as RC


def by_hand(outcomes, rule=RC.Rule()):
    delay, streak = rule.base_s, 0
    for ok, limited in outcomes:
        delay, streak = RC.step(rule, delay, streak, ok, limited)
    return delay, streak


def test_replay_equals_the_steps(spark):
    log = [(k, i, (i * 7 + k) % 6 != 0, i % 2 == 0) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(log, "endpoint int, seq int, ok boolean, limited boolean")
    for r in RC.replay(df).collect():
        assert (r.delay, r.streak) == (pytest.approx(by_hand([x[2:] for x in log if x[0] == r.endpoint])[0]), by_hand([x[2:] for x in log if x[0] == r.endpoint])[1])


def test_known_run():
    assert by_hand([(True, False)] * 5 + [(False, True), (True, False)]) == (pytest.approx(4.8), 1)


def test_live_stream_keeps_its_state(spark, tmp_path):
    schema = "endpoint string, seq int, ok boolean, limited boolean"
    log = [("a", i, i % 4 != 3, True) for i in range(12)]
    for k in range(2):
        spark.createDataFrame(log[k * 6 : k * 6 + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = RC.live(stream).writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("rates").orderBy(F.col("n").desc()).first()
    assert (last.n, last.delay, last.streak) == (12, pytest.approx(by_hand([x[2:] for x in log])[0]), by_hand([x[2:] for x in log])[1])


def test_throttled(spark):
    df = spark.createDataFrame([("错误：429",), ("请求频率过高",), ("Rate limit",), ("500",), (None,)], "e string")
    assert [r[0] for r in df.select(RC.throttled(F.col("e"))).collect()] == [True, True, True, False, False]
