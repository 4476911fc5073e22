"""Event pipeline plans over the events table, as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import delivery as D
from ..streaming import events as S
from ..streaming import windows as W
from .registry import query, table

#: Event types of the stand-in table as events of the pipeline.
KINDS = {"view": "document.uploaded", "click": "ingestion.completed", "error": "no.such.type", "signup": "policy.approved", "purchase": "skill.packaged"}
KINDS_SQL = "CASE event_type WHEN 'view' THEN 'document.uploaded' WHEN 'click' THEN 'ingestion.completed' WHEN 'error' THEN 'no.such.type' WHEN 'signup' THEN 'policy.approved' WHEN 'purchase' THEN 'skill.packaged' END"


def as_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("eventId"), F.col("ts").cast("timestamp").alias("occurredAt"), kind.alias("type"), F.col("user_id").alias("document"), "event_id", "event_type")


@query(f"SELECT {KINDS_SQL} <> 'no.such.type' AS valid, count(*) AS n FROM events GROUP BY 1")
def str_01_validation(spark: SparkSession, d: str) -> DataFrame:
    raw = as_events(spark, d).select(F.to_json(F.struct("eventId", "occurredAt", "type")).alias("value"))
    return S.parse_events(raw).groupBy("valid").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CASE event_type WHEN 'view' THEN 'ingestion' WHEN 'click' THEN 'extraction' WHEN 'signup' THEN 'ontology' END, 'none') AS target, count(*) AS n FROM events GROUP BY 1")
def str_02_routing(spark: SparkSession, d: str) -> DataFrame:
    return S.route(as_events(spark, d)).groupBy(F.coalesce("target", F.lit("none")).alias("target")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 5 >= 3 THEN 'dead' ELSE 'retry' END AS state, CASE WHEN event_type = 'error' AND event_id % 5 < 3 THEN event_id % 5 * 5 END AS delay FROM events
""")
def str_05_retry(spark: SparkSession, d: str) -> DataFrame:
    state, delay = S.retry_decision(F.col("event_id") % 5, F.col("event_type") != "error")
    return table(spark, d, "events").select("event_id", state.alias("state"), delay.alias("delay"))


@query("""
WITH r AS (SELECT user_id AS batch, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY 1),
t AS (SELECT DISTINCT user_id AS batch, user_id % 4 * 40 + 1 AS total FROM events)
SELECT batch, total, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, CASE WHEN coalesce(completed, 0) + coalesce(failed, 0) < total THEN 'running' WHEN coalesce(failed, 0) > 0 THEN 'partial' ELSE 'completed' END AS status FROM t LEFT JOIN r USING (batch)
""")
def str_06_batch_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    results = e.select(F.col("user_id").alias("batch"), (F.col("event_type") != "error").alias("ok"))
    return S.batch_progress(results, e.select(F.col("user_id").alias("batch"), (F.col("user_id") % 4 * 40 + 1).alias("total")).distinct())


@query("""
WITH a AS (SELECT user_id AS session, ts AS tm, event_id, CASE event_type WHEN 'view' THEN 'init' WHEN 'click' THEN 'assign' WHEN 'signup' THEN 'approve' ELSE 'noop' END AS action FROM events WHERE ts <= TIMESTAMP '2024-01-12'),
o AS (SELECT session, min(tm) AS opened_at FROM a WHERE action = 'init' GROUP BY 1), l AS (SELECT a.*, opened_at FROM a JOIN o USING (session) WHERE tm < opened_at + INTERVAL 7 DAY),
i AS (SELECT session, min(tm) AS t FROM l WHERE action = 'assign' AND tm > opened_at GROUP BY 1), c AS (SELECT l.session, min(tm) AS t FROM l JOIN i ON i.session = l.session WHERE action = 'approve' AND tm > i.t GROUP BY 1)
SELECT CAST(o.session AS BIGINT) AS session, CASE WHEN c.t IS NOT NULL THEN 'completed' WHEN TIMESTAMP '2024-01-12' >= opened_at + INTERVAL 7 DAY THEN 'expired' WHEN i.t IS NOT NULL THEN 'in_progress' ELSE 'open' END AS status
FROM o LEFT JOIN i ON i.session = o.session LEFT JOIN c ON c.session = o.session
""")
def str_08_sessions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "view", "init").when(kind == "click", "assign").when(kind == "signup", "approve").otherwise("noop")
    a = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"))
    return S.sessions(a, F.lit("2024-01-12").cast("timestamp")).select("session", "status")


@query("""
SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, greatest(0, count(*) - 3) AS rejected FROM events GROUP BY 1, 2
""")
def str_09_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.col("ts").alias("at"))
    return S.fixed_window_limit(e, "event_type", most=3, seconds=3600)


@query("""
SELECT user_id FROM (SELECT user_id, max_by(event_type, event_id) AS status, max(ts) AS opened_at FROM events GROUP BY 1) WHERE status NOT IN ('purchase') AND opened_at < TIMESTAMP '2024-02-06 00:00:00' - INTERVAL 7 DAY
""")
def str_10_expiry_sweep(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.when(F.max_by("event_type", "event_id") == "purchase", "completed").otherwise("open").alias("status"), F.max("ts").alias("opened_at"))
    return S.expired_sessions(last, F.lit("2024-02-06 00:00:00").cast("timestamp")).select("user_id")


@query("""
SELECT stage, next_stage, count(*) AS n, floor(CAST(sum(micros) AS DOUBLE) / count(micros) / 1e6 * 100 + 0.5) / 100 AS mean_seconds FROM (SELECT event_type AS stage, lead(event_type) OVER w AS next_stage, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE next_stage IS NOT NULL GROUP BY 1, 2
""")
def str_11_stage_latency(spark: SparkSession, d: str) -> DataFrame:
    s = S.stage_latency(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", "ts").where("next_stage is not null")
    return s.groupBy("stage", "next_stage").agg(F.count("*").alias("n"), (F.floor(F.sum(F.round(F.col("seconds") * 1e6).cast("long")).cast("double") / F.count("seconds") / 1e6 * 100 + 0.5) / 100.0).alias("mean_seconds"))


@query("""
WITH m AS (SELECT event_id, user_id, epoch_us(ts) // 30000000 AS slot, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 30000000 ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, slot * 1000 + (n - 1) // 10 AS batch, count(*) AS messages, min(event_id) AS first_ FROM m GROUP BY 1, 2
""")
def str_03_batches(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a queue in batches: what arrives within 30 seconds, ten at most."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.batches(e, "user_id", "ts", "event_id").groupBy("user_id", "batch").agg(F.count("*").alias("messages"), F.min("event_id").alias("first_"))


@query("""
SELECT l_orderkey AS message, count(*) AS targets, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'ack' WHEN l_orderkey % 7 >= 5 THEN 'dead' ELSE 'retry' END AS outcome FROM lineitem GROUP BY 1
""")
def str_04_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A message goes to several targets; if any fails, all of it is delivered again, five times at most."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message"), (F.col("l_returnflag") != "R").alias("ok"), (F.col("l_orderkey") % 7).alias("attempts"))
    return S.fan_out(r, most=5)


@query("""
WITH b AS (SELECT user_id AS batch, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1), d AS (SELECT batch FROM b WHERE failed < 20),
k AS (SELECT DISTINCT user_id AS batch, CAST(value AS INTEGER) AS key FROM events WHERE event_type <> 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5(CAST(batch AS VARCHAR) || ':' || CAST(key AS VARCHAR)), key) AS n FROM k WHERE batch IN (SELECT batch FROM d))
SELECT batch AS parent, key FROM r WHERE n <= 5
""")
def str_07_cross_check(spark: SparkSession, d: str) -> DataFrame:
    """A sample of the keys of each completed batch, by digest, as its follow-up batch."""
    e = table(spark, d, "events")
    done = e.groupBy(F.col("user_id").alias("batch")).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"))
    status = done.select("batch", F.when(F.col("failed") < 20, "completed").otherwise("partial").alias("status"))
    keys = e.where("event_type <> 'error'").select(F.col("user_id").alias("batch"), F.rint("value").cast("int").alias("key"))
    return S.follow_up(status, keys, 5)


@query("""
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS batch, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message, ts, event_id, event_type NOT IN ('error', 'view') AS ok FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY batch, message ORDER BY ts, event_id) AS n FROM a), m AS (SELECT batch, message, min(n) FILTER (ok) AS done, max(n) AS last_ FROM n WHERE n <= 3 GROUP BY 1, 2)
SELECT batch, message, CAST(coalesce(done, last_) AS INTEGER) AS attempts, CASE WHEN done IS NOT NULL THEN 'done' WHEN last_ >= 3 THEN 'dead' ELSE 'retry' END AS outcome FROM m
""")
def str_05_message_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Users as batches, whole values as messages, events as attempts: counted, not handed in."""
    return D.message_outcomes(attempts(spark, d), "at", "event_id").drop("at")


@query("""
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS batch, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message, ts, event_id, event_type NOT IN ('error', 'view') AS ok FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY batch, message ORDER BY ts, event_id) AS n FROM a), m AS (SELECT batch, message, min(n) FILTER (ok) AS done, max(n) AS last_ FROM n WHERE n <= 3 GROUP BY 1, 2),
b AS (SELECT batch, count(*) - CAST(batch AS BIGINT) % 3 * 10 AS total, count(done) AS completed, count(*) FILTER (done IS NULL AND last_ >= 3) AS failed FROM m GROUP BY 1)
SELECT batch, total, completed, failed, CASE WHEN completed + failed < total THEN 'running' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM b
""")
def str_06_outcome_progress(spark: SparkSession, d: str) -> DataFrame:
    """Counters of batches from the outcomes of their messages; some batches wait for fewer than all."""
    a = attempts(spark, d)
    totals = a.groupBy("batch").agg((F.count_distinct("message") - F.col("batch").cast("long") % 3 * 10).alias("total"))
    return D.outcome_progress(D.message_outcomes(a, "at", "event_id"), totals)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("batch"), F.floor("value").cast("string").alias("message"), F.col("ts").alias("at"), "event_id", (~F.col("event_type").isin("error", "view")).alias("ok"))


#: Windows that open with a row: each next one by the first row a length after, in SQL by recursion.
OPENED_SQL = """
WITH RECURSIVE r AS (SELECT {key} AS k, epoch_us(ts) AS t FROM events), o AS (
  SELECT k, min(t) AS t FROM r GROUP BY 1 UNION ALL
  SELECT k, (SELECT min(r.t) FROM r WHERE r.k = o.k AND r.t >= o.t + {length}) AS t FROM o WHERE EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.t >= o.t + {length}))
"""


@query(
    OPENED_SQL.format(key="user_id", length=40 * 3600 * 1_000_000)
    + """, w AS (SELECT o.k, o.t, lead(o.t) OVER (PARTITION BY o.k ORDER BY o.t) AS e FROM o)
SELECT w.k AS user_id, w.t AS start_us, count(*) AS n, greatest(0, count(*) - 3) AS rejected FROM w JOIN r ON r.k = w.k AND r.t >= w.t AND (w.e IS NULL OR r.t < w.e) GROUP BY 1, 2
"""
)
def str_09_opened_windows(spark: SparkSession, d: str) -> DataFrame:
    """A user's requests in windows of 40 hours from the request that opens one, three at most."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    w = W.opened_windows(e, "user_id", most=3, seconds=40 * 3600)
    return w.select("user_id", F.unix_micros("start").alias("start_us"), "n", "rejected")


@query("""
WITH RECURSIVE r AS (SELECT user_id AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
o AS (SELECT k, 0::BIGINT AS i FROM (SELECT DISTINCT k FROM r) x UNION ALL
  SELECT k, nxt FROM (SELECT o.k, (SELECT min(b.i) FROM r a JOIN r b ON b.k = a.k AND (b.i = a.i + 10 OR b.t >= a.t + 432000000000) WHERE a.k = o.k AND a.i = o.i AND b.i > a.i) AS nxt FROM o) y WHERE nxt IS NOT NULL),
w AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS e FROM o)
SELECT w.k AS user_id, w.i AS batch, count(*) AS messages, min(event_id) AS least, max(event_id) AS most FROM w JOIN r ON r.k = w.k AND r.i >= w.i AND (w.e IS NULL OR r.i < w.e) GROUP BY 1, 2
""")
def str_03_opened_batches(spark: SparkSession, d: str) -> DataFrame:
    """A user's messages in batches of ten, or what came within five days of a batch's first."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    b = W.opened_batches(e, "user_id", "ts", "event_id", most=10, seconds=5 * 24 * 3600)
    return b.groupBy("user_id", "batch").agg(F.count("*").alias("messages"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))
