"""Keyed deliveries and the fan-out sink as streams with restarts, and windows that open with a row."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oreline.streaming import delivery as D
from oreline.streaming import sinks as K
from oreline.streaming import windows as W

T0 = datetime(2024, 1, 1)
RESULTS = "batch string, message string, at timestamp, ok boolean, error string, total long"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def replay(rows) -> list[tuple]:
    """done, retry and dead as of a plain walk over the rows by time: (batch, message, change, attempts, completed, failed, status)."""
    out, tries, counts = [], {}, {}
    for b, m, _, ok, _, total in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        done, dead, over = counts.get(b, (0, 0, False))
        if tries.get((b, m), 0) < 0:
            continue
        n = tries.get((b, m), 0) + 1
        change = "done" if ok else "dead" if n >= 3 else "retry"
        tries[b, m] = n if change == "retry" else -n
        done, dead = done + (change == "done"), dead + (change == "dead")
        over = over or done + dead >= total
        counts[b] = done, dead, over
        out.append((b, m, change, n, done, dead, ("partial" if dead else "completed") if over else "running"))
    return sorted(out)


def test_deliveries_across_restarts(spark, tmp_path):
    """Four files of results, a new query from the checkpoint for each: attempts and counters go on where they were."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    rows = [(f"b{i % 3}", f"m{r.randrange(8)}", at(i), r.random() < 0.3, "boom", 6) for i in range(80)]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    try:
        for part in (rows[:20], rows[20:45], rows[45:], [("end", "m", at(90_000), True, None, 9)], [("end", "m2", at(190_000), True, None, 9)]):
            spark.createDataFrame(part, RESULTS).coalesce(1).write.mode("append").parquet(source)
            stream = D.delivery_stream(spark.readStream.schema(RESULTS).parquet(source))
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(D.CHANGES).parquet(out).where("batch <> 'end'").collect()
    told = sorted((x["batch"], x["message"], x["change"], x["attempts"], x["completed"], x["failed"], x["status"]) for x in got if x["change"] != "redeliver")
    assert told == replay(rows)
    # What was never delivered again is told to be due, 5 seconds times its attempts after it failed.
    final = {}
    for b, m, _, n, *_ in sorted(replay(rows), key=lambda x: x[3]):
        final[b, m] = n
    open_ = {(b, m) for b, m, change, n, *_ in replay(rows) if change == "retry" and final[b, m] == n}
    failed_at = {(x["batch"], x["message"], x["attempts"]): x["at"] for x in got if x["change"] == "retry"}
    due = {(x["batch"], x["message"]): x for x in got if x["change"] == "redeliver"}
    assert open_ <= set(due)
    assert all(x["at"] == failed_at[x["batch"], x["message"], x["attempts"]] + timedelta(seconds=5 * x["attempts"]) for x in due.values())
    dead = D.dead_letters(spark.read.schema(D.CHANGES).parquet(out)).collect()
    assert sorted((x["batch"], x["message"]) for x in dead) == sorted((b, m) for b, m, change, *_ in replay(rows) if change == "dead") and all(x["attempts"] == 3 and x["error"] == "boom" for x in dead)


def test_outcomes_as_a_batch(spark):
    rows = [("b", "x", 1, False), ("b", "x", 2, False), ("b", "x", 3, False), ("b", "x", 4, True), ("b", "y", 1, False), ("b", "y", 2, True), ("b", "y", 3, False), ("b", "z", 1, False)]
    out = D.message_outcomes(spark.createDataFrame(rows, "batch string, message string, at long, ok boolean"), "at")
    assert {tuple(r) for r in out.collect()} == {("b", "x", 3, "dead", 3), ("b", "y", 2, "done", 2), ("b", "z", 1, "retry", 1)}
    totals = spark.createDataFrame([("b", 2), ("c", 0), ("d", 1)], "batch string, total int")
    assert {tuple(r) for r in D.outcome_progress(out, totals).collect()} == {("b", 2, 1, 1, "partial"), ("c", 0, 0, 0, "completed"), ("d", 1, 0, 0, "running")}


def test_a_batch_killed_between_two_targets_is_written_once(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "id long, type string, v string"
    broken = {"left": 2}

    def fails_twice(batch):
        if broken["left"]:
            broken["left"] -= 1
            raise OSError("target is away")
        return batch.where("type <> 'c'")

    def run() -> None:
        targets = {"one": (f"{tmp_path}/one", K.routed("type", ("a", "b"))), "two": (f"{tmp_path}/two", fails_twice), "three": (f"{tmp_path}/three", K.routed("type", ("b", "c")))}
        stream = spark.readStream.schema(schema).parquet(source)
        query = stream.writeStream.foreachBatch(K.fan_out_writer(targets, "router", ["id"])).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()

    first = [(i, "abc"[i % 3], "x") for i in range(30)] + [(3, "a", "x")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    for _ in range(2):
        with pytest.raises(Exception, match="target is away"):
            run()
    one = lambda name: spark.read.parquet(f"{tmp_path}/{name}/rows/router/*").select("id").collect()
    assert len(one("one")) == len(one("three")) == 20  # written in the first attempt, and only then
    run()
    second = [(i, "abc"[i % 3], "y") for i in range(25, 45)]  # five of them are delivered again
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(source)
    run()
    for name, types in (("one", "ab"), ("two", "ab"), ("three", "bc")):
        got = K.table_rows(spark, f"{tmp_path}/{name}", "router", schema).collect()
        assert Counter(r["id"] for r in got) == Counter(i for i in range(45) if "abc"[i % 3] in types)
        assert all(r["v"] == ("x" if r["id"] < 30 else "y") for r in got)


def walked(rows, seconds: float, most: int | None = None) -> dict:
    """{(key, row): row that opened its window} by a walk; ``most`` rows a window, if given."""
    out, open_ = {}, {}
    for k, t, s in sorted(rows):
        first = open_.get(k)
        if first is None or t >= first[0] + seconds or (most and first[2] >= most):
            first = open_[k] = [t, s, 0]
        first[2] += 1
        out[k, t, s] = tuple(first[:2])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_windows_and_batches_against_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), round(r.choice([r.random() * 900, r.random() * 30]), 1), i) for i in range(300)] + [("late", 1e6 + i, 1000 + i) for i in range(3)] + [("a", 5.0, 2000), ("a", 5.0, 2001)]
    df = spark.createDataFrame([(k, at(t), s, "more") for k, t, s in rows] + [("a", None, -1, "x")], "k string, at timestamp, seq long, batch_ string").repartition(5)
    want: Counter = Counter()
    for (k, t, _), (o, _) in walked([(k, t, 0 if False else s) for k, t, s in rows], 60).items():
        want[k, at(o)] += 1
    got = W.opened_windows(df, "k", most=4, seconds=60).collect()
    assert {(x["k"], x["start"]): x["n"] for x in got} == want and all(x["rejected"] == max(0, x["n"] - 4) for x in got)
    batches = {}
    for x in W.opened_batches(df, "k", "at", "seq", most=10, seconds=30).collect():
        batches.setdefault((x["k"], x["batch"]), set()).add(x["seq"])
    plain = {}
    for (k, _, s), opener in walked(rows, 30, 10).items():
        plain.setdefault((k, opener), set()).add(s)
    assert sorted(map(sorted, batches.values())) == sorted(map(sorted, plain.values()))


def test_a_window_that_crosses_the_clock(spark):
    """Requests at 0:50 and 1:10 are in one window of a minute: the limit of one refuses the second."""
    got = W.opened_windows(spark.createDataFrame([("k", at(50)), ("k", at(70)), (None, at(1))], "k string, at timestamp"), "k", most=1).collect()
    assert sorted((x["k"] or "", x["n"], x["rejected"]) for x in got) == [("", 1, 0), ("k", 2, 1)]
    assert W.opened_windows(spark.createDataFrame([], "k string, at timestamp"), "k").count() == 0


def test_a_key_of_a_million_requests(spark):
    figures: dict = {}
    hot = spark.range(1_000_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 70_000).alias("at"))
    got = W.opened_windows(hot, "k", figures=figures).agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.max("n").alias("most")).collect()[0]
    a_window = -(-60_000 // 70)
    assert (got["windows"], got["n"], got["most"]) == (-(-1_000_000 // a_window), 1_000_000, a_window) and figures["rounds"] <= 12
