"""Queue and session operators, as batches and as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from oreline.streaming import events as S

T0 = datetime(2024, 1, 1)
DAY = 86_400


def at(seconds: float) -> datetime:
    return datetime.fromtimestamp(T0.timestamp() + seconds)


ACTIONS = [
    ("a", at(0), 1, "init"), ("a", at(10), 2, "assign"), ("a", at(20), 3, "approve"),  # completed
    ("b", at(0), 1, "assign"), ("b", at(5), 2, "init"), ("b", at(9), 3, "approve"),  # open: closing needs an assignment
    ("c", at(0), 1, "init"), ("c", at(0), 2, "assign"), ("c", at(8 * DAY), 3, "reject"),  # expired before the rejection
    ("d", at(3), 1, "assign"),  # never opened
    ("e", at(0), 2, "assign"), ("e", at(0), 1, "init"), ("e", at(0), 3, "modify"), ("e", at(1), 4, "init"),  # order within a time by seq
]
SCHEMA = "session string, at timestamp, seq long, action string"


def test_sessions_as_a_batch(spark):
    got = {r["session"]: r["status"] for r in S.sessions(spark.createDataFrame(ACTIONS, SCHEMA), F.lit(at(9 * DAY)).cast("timestamp")).collect()}
    assert got == {"a": "completed", "b": "expired", "c": "expired", "e": "completed"}
    early = {r["session"]: r["status"] for r in S.sessions(spark.createDataFrame(ACTIONS, SCHEMA), F.lit(at(15)).cast("timestamp")).collect()}
    assert early == {"a": "in_progress", "b": "open", "c": "in_progress", "e": "completed"}
    assert S.sessions(spark.createDataFrame([], SCHEMA), F.lit(at(0)).cast("timestamp")).count() == 0


def test_sessions_as_a_stream(spark, tmp_path):
    """Two files, the second a day late enough to fire the timers of what is still open."""
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "false")
    source = f"{tmp_path}/in"
    spark.createDataFrame(ACTIONS, SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = S.session_stream(stream).writeStream.format("memory").queryName("session_changes").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").start()
    query.processAllAvailable()
    spark.createDataFrame([("z", at(30 * DAY), 1, "init")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    spark.createDataFrame([("z", at(31 * DAY), 2, "noop")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    changes: dict[str, list[str]] = {}
    for r in spark.sql("SELECT * FROM session_changes ORDER BY session, at, status DESC").collect():
        changes.setdefault(r["session"], []).append(r["status"])
    assert set(changes["a"]) == {"open", "in_progress", "completed"}
    assert changes["b"] == ["open", "expired"] and changes["c"][-1] == "expired" and "completed" not in changes["c"]
    assert set(changes["e"]) == {"open", "in_progress", "completed"} and "d" not in changes


def test_batches_of_messages(spark):
    rows = [("k", at(0.01 * i), i) for i in range(25)] + [("k", at(31), 99), ("l", at(0), 100)]
    got = {}
    for r in S.batches(spark.createDataFrame(rows, "key string, at timestamp, seq long"), "key", "at", "seq").collect():
        got.setdefault((r["key"], r["batch"]), []).append(r["seq"])
    assert sorted(map(sorted, got.values())) == sorted([list(range(10)), list(range(10, 20)), list(range(20, 25)), [99], [100]])


def test_fan_out_and_follow_up(spark):
    r = spark.createDataFrame([(1, True, 0), (1, False, 0), (2, True, 9), (3, False, 5)], "message int, ok boolean, attempts int")
    assert {x["message"]: x["outcome"] for x in S.fan_out(r, 5).collect()} == {1: "retry", 2: "ack", 3: "dead"}
    status = spark.createDataFrame([(1, "completed"), (2, "partial")], "batch int, status string")
    keys = spark.createDataFrame([(b, k) for b in (1, 2) for k in range(9)] + [(1, 0)], "batch int, key int")
    got = [tuple(x) for x in S.follow_up(status, keys, 4).collect()]
    assert len(got) == len(set(got)) == 4 and {b for b, _ in got} == {1}
    assert sorted(got) == sorted(tuple(x) for x in S.follow_up(status, keys.repartition(5), 4).collect())
    assert S.follow_up(status, keys, 0).count() == 0
