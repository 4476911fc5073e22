"""The event pipeline: validation, routing, review sessions, retries and limits.

Each rule is one function over DataFrames that a batch and a stream share; state
that outlives a micro-batch is keyed state with a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The consumer of each event type; "" where there is none.
ROUTES = {
    "document.uploaded": "ingestion",
    "ingestion.completed": "extraction",
    "extraction.completed": "policy",
    "policy.candidate_ready": "",
    "policy.approved": "ontology",
    "ontology.normalized": "skill",
    "skill.packaged": "",
    "analysis.requested": "extraction",
    "analysis.completed": "",
    "diagnosis.completed": "",
    "diagnosis.review_completed": "",
    "factcheck.requested": "extraction",
    "factcheck.completed": "extraction",
    "evaluation.completed": "",
}
EVENT = "eventId string, occurredAt timestamp, traceId string, type string, payload string"
TTL_SECONDS = 7 * 24 * 3600


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events of JSON texts and whether they are valid: an id, a time and a known type."""
    e = raw.select(F.from_json(value, EVENT).alias("e")).select("e.*")
    return e.withColumn("valid", F.coalesce(F.col("eventId").isNotNull() & F.col("occurredAt").isNotNull() & F.col("type").isin(*ROUTES), F.lit(False)))


def target(kind: Column) -> Column:
    """Consumer of an event type; null where there is none."""
    out = F.lit(None).cast("string")
    for name, to in ROUTES.items():
        if to:
            out = F.when(kind == name, to).otherwise(out)
    return out


def route(events: DataFrame, kind: str = "type") -> DataFrame:
    return events.withColumn("target", target(F.col(kind)))


def retry_decision(attempts: Column, ok: Column, most: int = 3, delay: int = 5) -> tuple[Column, Column]:
    """What becomes of a delivery (done, dead or retry) and the seconds until a retry."""
    state = F.when(ok, "done").when(attempts >= most, "dead").otherwise("retry")
    return state, F.when(~ok & (attempts < most), attempts * delay)


def next_status(status: Column, action: Column) -> Column:
    """Status of a review session after an action; an action that does not fit changes nothing."""
    return (
        F.when((status == "none") & (action == "init"), "open")
        .when((status == "open") & (action == "assign"), "in_progress")
        .when((status == "in_progress") & action.isin("approve", "reject", "modify"), "completed")
        .otherwise(status)
    )


def sessions(actions: DataFrame, as_of: Column, key: str = "session", ttl: int = TTL_SECONDS) -> DataFrame:
    """State of each review session after all its actions up to ``as_of``.

    ``actions``: key, at (timestamp), seq (order within a time), action. A session that is
    not completed ``ttl`` seconds after it was opened is expired; actions at or after that
    moment do nothing. Illegal transitions are ignored.
    """
    use = actions.where(F.col("at") <= as_of).withColumn("_p", F.struct("at", "seq"))
    first = lambda df, name: df.groupBy(key).agg(F.min("_p").alias(name))
    opened = first(use.where("action = 'init'"), "_open")
    end = F.timestamp_seconds(F.unix_micros("_open.at") / 1e6 + ttl)
    opened = opened.withColumn("_end", end)
    live = use.where(F.col("action").isin("assign", "approve", "reject", "modify")).join(opened, key).where(F.col("at") < F.col("_end"))
    assigned = first(live.where((F.col("action") == "assign") & (F.col("_p") > F.col("_open"))), "_assigned")
    closed = first(live.where("action <> 'assign'").join(assigned, key).where(F.col("_p") > F.col("_assigned")), "_closed")
    g = opened.join(assigned, key, "left").join(closed, key, "left")
    status = F.when(F.col("_closed").isNotNull(), "completed").when(F.col("_assigned").isNotNull(), "in_progress").otherwise("open")
    expired = (status != "completed") & (as_of >= F.col("_end"))
    return g.select(key, F.col("_open.at").alias("opened_at"), F.when(expired, "expired").otherwise(status).alias("status"), F.when(expired, F.col("_end")).alias("expired_at"))


def session_stream(actions: DataFrame, key: str = "session", ttl: int = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """The same states as a stream of changes, with a timer on event time.

    ``actions``: key (string), at, seq, action. Emits key, status, at on every change of status.
    """
    after = {("none", "init"): "open", ("open", "assign"): "in_progress"} | {("in_progress", a): "completed" for a in ("approve", "reject", "modify")}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, opened = state.get if state.exists else ("none", None)
        out = []
        if state.hasTimedOut:
            if status != "completed":
                out.append((k[0], "expired", pd.Timestamp(opened + ttl * 1000, unit="ms")))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "seq"])
            for r in rows.itertuples():
                ms = int(r.at.value // 10**6)
                if opened is not None and ms >= opened + ttl * 1000:
                    continue
                new = after.get((status, r.action))
                if new:
                    opened = ms if new == "open" else opened
                    status = new
                    out.append((k[0], status, r.at))
            state.update((status, opened))
            if opened is not None:
                state.setTimeoutTimestamp(opened + ttl * 1000)
        yield pd.DataFrame(out, columns=[key, "status", "at"])

    return (
        actions.withWatermark("at", late)
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} string, status string, at timestamp", "status string, opened long", "append", "EventTimeTimeout")
    )


def fixed_window_limit(requests: DataFrame, key: str, at: str = "at", most: int = 60, seconds: int = 60) -> DataFrame:
    """Requests per key and calendar window, and how many are over the limit.

    Windows are aligned to the clock; a window that opens with a key's first request
    would depend on every request before it.
    """
    w = F.window(at, f"{seconds} seconds")
    return requests.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("rejected"))


def expired_sessions(rows: DataFrame, as_of: Column, status: str = "status", opened: str = "opened_at", days: int = 7) -> DataFrame:
    """Sessions that are neither completed nor expired and older than ``days``."""
    return rows.where(~F.col(status).isin("completed", "expired") & (F.col(opened) < as_of - F.make_interval(days=F.lit(days))))


def batch_progress(results: DataFrame, totals: DataFrame, key: str = "batch") -> DataFrame:
    """Counters and status of batches: ``results`` key, ok; ``totals`` key, total."""
    n = results.groupBy(key).agg(F.sum(F.col("ok").cast("long")).alias("completed"), F.sum((~F.col("ok")).cast("long")).alias("failed"))
    j = totals.join(n, key, "left").select(key, "total", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("failed", F.lit(0)).alias("failed"))
    done = F.col("completed") + F.col("failed") >= F.col("total")
    return j.withColumn("status", F.when(~done, "running").when(F.col("failed") > 0, "partial").otherwise("completed"))


def stage_latency(events: DataFrame, key: str, kind: str = "type", at: str = "occurredAt") -> DataFrame:
    """Seconds from each event of a document to its next one."""
    w = Window.partitionBy(key).orderBy(at)
    gap = (F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)) / 1e6
    return events.select(key, F.col(kind).alias("stage"), F.lead(kind).over(w).alias("next_stage"), gap.alias("seconds"))


def batches(messages: DataFrame, key: str, at: str, seq: str, most: int = 10, seconds: int = 30) -> DataFrame:
    """``messages`` with ``batch``: what a key gets within ``seconds`` (by the clock), ``most`` at most, in order."""
    slot = F.floor(F.unix_timestamp(at) / seconds)
    n = F.row_number().over(Window.partitionBy(key, slot).orderBy(at, seq))
    return messages.withColumn("batch", slot * 1000 + F.floor((n - 1) / most))


def fan_out(results: DataFrame, most: int) -> DataFrame:
    """What becomes of each message: ack if all its targets took it, else retry, or dead after ``most`` attempts. ``results``: message, ok, attempts."""
    g = results.groupBy("message").agg(F.count("*").alias("targets"), F.bool_and("ok").alias("_ok"), F.max("attempts").alias("_n"))
    return g.select("message", "targets", F.when(F.col("_ok"), "ack").when(F.col("_n") >= most, "dead").otherwise("retry").alias("outcome"))


def follow_up(status: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """A child batch (parent, key) of ``size`` keys for each completed batch, chosen by digest, so that a replay chooses the same.

    ``status``: batch, status; ``keys``: batch, key. A size of 0: none.
    """
    done = keys.distinct().join(status.where("status = 'completed'").select("batch"), "batch")
    digest = F.md5(F.concat_ws(":", F.col("batch").cast("string"), F.col("key").cast("string")))
    return done.withColumn("_n", F.row_number().over(Window.partitionBy("batch").orderBy(digest, "key"))).where(F.col("_n") <= size).select(F.col("batch").alias("parent"), "key")
