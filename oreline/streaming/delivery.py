"""Deliveries of a queue as keyed state: attempts, retries after a delay, dead letters, batch counters.

The state of a batch holds the attempts of each open message, its counters and what is
due. Timers on event time tell when a message is to be delivered again, 5 seconds times
its attempts after it failed, and drop the state of batches that nothing came in for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST, DELAY = 3, 5  # attempts of a message, and seconds times attempts until the next one
IDLE = 7 * 24 * 3600  # seconds without news after which a batch's state goes
CHANGES = "batch string, message string, change string, attempts int, at timestamp, completed long, failed long, status string, error string"


class Deliveries(StatefulProcessor):
    """Rows of a batch - message, at, ok, error, total - to changes: done, retry, redeliver, dead, and the batch's end."""

    def __init__(self, most: int = MOST, delay: int = DELAY, idle: int = IDLE):
        self.most, self.delay, self.idle = most, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getMapState("attempts", "message string", "n int")
        self.due = handle.getMapState("due", "at long, message string", "n int")
        self.counts = handle.getValueState("counts", "completed long, failed long, total long, last long, over boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        completed, failed, total, last, over = self.counts.get() or (0, 0, None, 0, False)
        out = []
        news = pd.concat(list(rows)).sort_values(["at", "message"], kind="stable")
        for r in news.itertuples():
            known = self.attempts.getValue((r.message,)) if self.attempts.containsKey((r.message,)) else (0,)
            total = int(r.total) if total is None else total
            ms = int(r.at.value // 10**6)
            last = max(last, ms)
            if known[0] < 0:
                continue  # done or dead already: delivered once more than needed
            n = known[0] + 1
            error = None if r.error is None or r.error != r.error else r.error
            if r.ok:
                completed, change = completed + 1, "done"
            elif n >= self.most:
                failed, change = failed + 1, "dead"
            else:
                change = "retry"
                when = ms + 1000 * self.delay * n
                self.due.updateValue((when, r.message), (n,))
                self.handle.registerTimer(when)
            self.attempts.updateValue((r.message,), (n if change == "retry" else -n,))
            end = completed + failed >= total and not over
            over = over or end
            status = ("partial" if failed else "completed") if over else "running"
            out.append((key[0], r.message, change, n, r.at, completed, failed, status, error))
        self.counts.update((completed, failed, total, last, over))
        self.handle.registerTimer(last + 1000 * self.idle)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        completed, failed, total, last, over = self.counts.get() or (0, 0, None, 0, False)
        for (when, message), (n,) in list(self.due.iterator()):
            if when <= now:
                self.due.removeKey((when, message))
                held = self.attempts.getValue((message,)) if self.attempts.containsKey((message,)) else (0,)
                if held[0] == n:  # not delivered again before it was due
                    out.append((key[0], message, "redeliver", n, pd.Timestamp(when, unit="ms"), completed, failed, ("partial" if failed else "completed") if over else "running", None))
        if now >= last + 1000 * self.idle:
            for state in (self.attempts, self.due, self.counts):
                state.clear()
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def delivery_stream(results: DataFrame, late: str = "1 minute", most: int = MOST, delay: int = DELAY, idle: int = IDLE) -> DataFrame:
    """Changes (see CHANGES) of a stream of delivery results: batch, message (strings), at, ok, error, total of the batch.

    A message that is done or dead is not counted again. Dead letters are the changes of
    kind dead, with the last error. Needs the RocksDB state store.
    """
    rows = results.select("batch", "message", "at", "ok", "error", "total").withWatermark("at", late)
    return rows.groupBy("batch").transformWithStateInPandas(Deliveries(most, delay, idle), CHANGES, "Append", "EventTime")


def dead_letters(changes: DataFrame) -> DataFrame:
    return changes.where("change = 'dead'").select("batch", "message", "attempts", "at", "error")


def message_outcomes(results: DataFrame, *order: str, most: int = MOST) -> DataFrame:
    """The same as a batch: what became of each message after its attempts in order (batch, message, attempts, outcome, at).

    ``results``: batch, message, ok and the columns of ``order``, the first of which is the
    time. The first ``most`` results count, and none after a success.
    """
    key = ["batch", "message"]
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= most)
    g = first.groupBy(*key).agg(F.min(F.when(F.col("ok"), F.col("_n"))).alias("_done"), F.max("_n").alias("_last"), F.collect_list(F.struct("_n", F.col(order[0]).alias("at"))).alias("_at"))
    n = F.coalesce("_done", "_last")
    outcome = F.when(F.col("_done").isNotNull(), "done").when(F.col("_last") >= most, "dead").otherwise("retry")
    at = F.filter("_at", lambda x: x["_n"] == n)[0]["at"]  # ``most`` entries at most
    return g.select(*key, n.alias("attempts"), outcome.alias("outcome"), at.alias("at"))


def outcome_progress(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """Counters and status of batches (batch, total, completed, failed, status) by what became of their messages."""
    n = lambda kind: F.count(F.when(F.col("outcome") == kind, 1))
    j = totals.join(outcomes.groupBy("batch").agg(n("done").alias("completed"), n("dead").alias("failed")), "batch", "left").na.fill(0, ["completed", "failed"])
    over = F.col("completed") + F.col("failed") >= F.col("total")
    return j.withColumn("status", F.when(~over, "running").when(F.col("failed") > 0, "partial").otherwise("completed"))
