"""Relational reports: projections, filters, joins, aggregations, windows, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.text import exact_mean, like_ascii, percent, rounded
from ..operators import relational as R
from .registry import query, table

# ---- scans and filters


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def src_01_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def src_02_tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'src3'").select("doc_id", "lang", "n_chars")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 20 AND p_brand = 'Brand#2'")
def flt_01_dynamic_filter(spark: SparkSession, d: str, brand: str | None = "Brand#2", size: int | None = 20, kind: str | None = None) -> DataFrame:
    tests = [F.col("p_brand") == brand if brand else None, F.col("p_size") >= size if size is not None else None, F.col("p_type") == kind if kind else None]
    return table(spark, d, "part").where(R.conjunction(tests)).select("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%green%' OR p_type ILIKE '%green%' OR p_brand ILIKE '%green%'")
def flt_02_substring_search(spark: SparkSession, d: str, q: str = "Green") -> DataFrame:
    p = table(spark, d, "part")
    return p.where(like_ascii(F.col("p_name"), q) | like_ascii(F.col("p_type"), q) | like_ascii(F.col("p_brand"), q)).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE list_contains(string_split(json_extract_string(props, '$.k'), ','), '7')")
def flt_03_tag_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.array_contains(F.split(F.get_json_object("props", "$.k"), ","), "7")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_04_in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P') OR o_orderstatus IS NULL")
def flt_05_not_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(~F.col("o_orderstatus").isin("F", "P") | F.col("o_orderstatus").isNull()).select("o_orderkey")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def flt_06_relative_time(spark: SparkSession, d: str, as_of: str = "2024-01-30 00:00:00", days: int = 7) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(min(days, 90)))
    return table(spark, d, "events").where(F.col("ts") >= since).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def flt_07_day_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.to_date("ts") == F.lit("2024-01-15").cast("date")).select("event_id")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
k AS (SELECT conv_id, turn, text FROM r WHERE rn <= 3 AND trim(coalesce(text, '')) <> '')
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, length(text) AS n FROM k
""")
def flt_13_chunk_cap(spark: SparkSession, d: str, cap: int = 3) -> DataFrame:
    """The cap counts blank chunks, the index does not."""
    kept = R.first_n_by(table(spark, d, "conversations"), ["conv_id"], cap, F.asc("turn")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n"))


@query("SELECT event_id AS id, coalesce(event_type, 'unknown') AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(value, 0.0) AS score FROM events")
def prj_01_api_shape(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "k bigint")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce("event_type", F.lit("unknown")).alias("kind"), props["k"].alias("k"), F.coalesce("value", F.lit(0.0)).alias("score"))


@query("""
SELECT CAST(sum(CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END) AS BIGINT) AS rich,
       CAST(sum(CASE WHEN n_chars >= 500 AND n_chars < 1500 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
       CAST(sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) AS BIGINT) AS thin FROM documents
""")
def prj_02_depth_buckets(spark: SparkSession, d: str, rich: int = 1500, medium: int = 500) -> DataFrame:
    n = F.col("n_chars")
    count = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    return table(spark, d, "documents").agg(count(n >= rich, "rich"), count((n >= medium) & (n < rich), "medium"), count(n < medium, "thin"))


def severity() -> Column:
    return F.when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 40, "MEDIUM").otherwise("LOW")


SEVERITY_SQL = "CASE WHEN value >= 80 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
RANK_SQL = "CASE WHEN severity IN ('HIGH', 'critical') THEN 0 WHEN severity IN ('MEDIUM', 'warning') THEN 1 ELSE 2 END"


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings: type by event type, severity by value."""
    return table(spark, d, "events").select(F.col("event_id").alias("finding_id"), F.col("event_type").alias("type"), severity().alias("severity"), F.col("value").alias("confidence"), F.col("user_id").alias("org"), "ts")


FINDINGS_SQL = f"SELECT event_id AS finding_id, event_type AS type, {SEVERITY_SQL} AS severity, value AS confidence, user_id AS org, ts FROM events"


@query(f"SELECT finding_id, {RANK_SQL} AS rank FROM ({FINDINGS_SQL})")
def prj_03_severity_rank(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("finding_id", severity_rank(F.col("severity")).alias("rank"))


#: Items of a fact check as JSON, with what tells an endpoint from a table.
ITEMS = ('{"path": "/a"}', '{"httpMethods": ["GET"]}', '{"methodName": "m"}', '{"tableName": "t"}', '{"columns": []}', '{"other": 1}', '{"tableName": "t", "path": "/x"}', "broken")


@query(f"""
WITH i AS (SELECT event_id, {"CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ITEMS)) + " END"} AS item FROM events), j AS (SELECT event_id, CASE WHEN json_valid(item) THEN CAST(item AS JSON) END AS item FROM i)
SELECT event_id, CASE WHEN json_exists(item, '$.path') OR json_exists(item, '$.httpMethods') OR json_exists(item, '$.methodName') THEN 'api' WHEN json_exists(item, '$.tableName') OR json_exists(item, '$.columns') THEN 'table' ELSE 'api' END AS kind FROM j
""")
def prj_04_json_routing(spark: SparkSession, d: str) -> DataFrame:
    """Items of all kinds; endpoints are told first, and what tells nothing is an endpoint."""
    item = F.element_at(F.array(*map(F.lit, ITEMS)), (F.col("event_id") % len(ITEMS) + 1).cast("int"))
    has = lambda *paths: F.coalesce(*(F.get_json_object(item, p) for p in paths)).isNotNull()
    kind = F.when(has("$.path", "$.httpMethods", "$.methodName"), "api").when(has("$.tableName", "$.columns"), "table").otherwise("api")
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


# ---- joins


@query("""
SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def join_01_three_way(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_rejected"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_02_two_way(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return big.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN l ON o_custkey = c_custkey AND rn = 1
""")
def join_03_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    last = done.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "l.o_orderkey", "l.o_totalprice")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def join_09_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("""
WITH s AS (SELECT upper(lang) || ' /' || source AS k, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
t AS (SELECT upper(lang) || ' /' || source AS k, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT coalesce(s.k, t.k) AS endpoint, CASE WHEN s.k IS NULL THEN 'DOC_ONLY' WHEN t.k IS NULL THEN 'SOURCE_MISSING' WHEN s.n <> t.n THEN 'DIVERGENCE' ELSE 'MATCH' END AS state
FROM s FULL JOIN t ON s.k = t.k
""")
def join_11_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.upper("lang"), F.lit(" /"), F.col("source")).alias("endpoint"))
    side = lambda m, name: docs.where(F.col("doc_id") % m == 0).groupBy("endpoint").agg(F.count("*").alias(name))
    j = side(2, "n_source").join(side(3, "n_doc"), "endpoint", "full")
    state = F.when(F.col("n_source").isNull(), "DOC_ONLY").when(F.col("n_doc").isNull(), "SOURCE_MISSING").when(F.col("n_source") != F.col("n_doc"), "DIVERGENCE").otherwise("MATCH")
    return j.select("endpoint", state.alias("state"))


@query("""
SELECT p_partkey, coalesce(l_flag, 'none') AS flag, coalesce(p_brand, '') AS brand
FROM part LEFT JOIN (SELECT l_partkey, min(l_returnflag) AS l_flag FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_partkey = p_partkey
""")
def join_12_enrichment(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_returnflag").alias("f"))
    return table(spark, d, "part").join(flags, "p_partkey", "left").select("p_partkey", F.coalesce("f", F.lit("none")).alias("flag"), F.coalesce("p_brand", F.lit("")).alias("brand"))


@query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 50)
SELECT (SELECT count(*) FROM a JOIN b USING (user_id)) AS overlap, (SELECT count(*) FROM a WHERE user_id NOT IN (SELECT user_id FROM b)) AS only_a,
       (SELECT count(*) FROM b WHERE user_id NOT IN (SELECT user_id FROM a)) AS only_b
""")
def join_23_set_comparison(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    by = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("a"), F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), 1).otherwise(0)).alias("b"))
    n = lambda t, name: F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(name)
    return by.agg(n(F.col("a") + F.col("b") == 2, "overlap"), n(F.col("a") > F.col("b"), "only_a"), n(F.col("a") < F.col("b"), "only_b"))


# ---- aggregations


@query("""
SELECT o_custkey AS org, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS total, max(o_orderdate) AS newest FROM orders GROUP BY 1
""")
def agg_01_org_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("org")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("newest"))


@query("""
SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN event_id % 3 = 0 THEN CAST(value AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS lost, CAST(coalesce(sum(CASE WHEN event_id < 0 THEN CAST(value AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS none_, max(ts) AS newest FROM events
""")
def agg_02_null_safe_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of what a third of the events lost, and of nothing at all: 0, not null."""
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("value").cast("decimal(18,4)"))), F.lit(0)).cast("double")
    return table(spark, d, "events").agg(F.count("*").alias("n"), total(F.col("event_id") % 3 == 0).alias("lost"), total(F.col("event_id") < 0).alias("none_"), F.max("ts").alias("newest"))


@query(f"""
SELECT coalesce(type, '*') AS type, coalesce(severity, '*') AS severity, count(*) AS n FROM ({FINDINGS_SQL}) GROUP BY GROUPING SETS ((type), (severity), ())
""")
def agg_03_marginals(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).groupingSets([[F.col("type")], [F.col("severity")], []], F.col("type"), F.col("severity")).agg(F.count("*").alias("n"))
    return f.select(F.coalesce("type", F.lit("*")).alias("type"), F.coalesce("severity", F.lit("*")).alias("severity"), "n")


@query("SELECT CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def agg_04_group_by_expression(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.when(F.col("event_type") == "view", "click").otherwise(F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open,
       CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders
""")
def agg_05_conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t, name: F.sum(F.when(t, 1).otherwise(0)).alias(name)
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(n(status == "F", "finished"), n(status == "O", "open"), n((F.col("o_orderpriority") == "1-URGENT") & (status == "O"), "urgent"))


@query("SELECT l_shipmode, CAST(sum(CAST(CASE WHEN l_returnflag = 'A' THEN l_discount END AS DECIMAL(18,4))) AS DOUBLE) / count(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS trust FROM (SELECT l_linestatus AS l_shipmode, l_returnflag, l_discount FROM lineitem) GROUP BY 1")
def agg_06_conditional_average(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(exact_mean(F.when(F.col("l_returnflag") == "A", F.col("l_discount"))).alias("trust"))


@query("""
SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(floor(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) * 100 + 0.5) AS BIGINT) AS avg_value_x100,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok
FROM events GROUP BY 1
""")
def agg_07_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    ok = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.floor(exact_mean(F.col("value")) * 100 + 0.5).cast("long").alias("avg_value_x100"), F.sum(ok).alias("n_ok"))


SPANS_SQL = """SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS a, max(CASE WHEN event_type = 'purchase' THEN ts END) AS b,
  count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n_click FROM events GROUP BY 1"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min(F.when(kind == "view", F.col("ts"))).alias("a"), F.max(F.when(kind == "purchase", F.col("ts"))).alias("b"), F.count("*").alias("n"), F.sum(F.when(kind == "click", 1).otherwise(0)).alias("n_click")
    )


def seconds() -> Column:
    return (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6


@query(f"SELECT floor(CAST(sum(epoch_us(b) - epoch_us(a)) AS DOUBLE) / count(epoch_us(b) - epoch_us(a)) / 1e6 * 1000 + 0.5) / 1000 AS seconds FROM ({SPANS_SQL})")
def agg_08_average_duration(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    return spans(spark, d).agg(rounded(F.sum(micros).cast("double") / F.count(micros) / 1e6, 3).alias("seconds"))


@query("""
SELECT o_custkey AS reviewer, CASE WHEN count(*) > 0 THEN CAST(floor(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) ELSE 0 END AS completion FROM orders GROUP BY 1
""")
def agg_09_rates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("reviewer")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("x"), F.count("*").alias("n"))
    return g.select("reviewer", percent(F.col("x"), F.col("n")).alias("completion"))


@query(f"SELECT user_id, n, CAST(n_click AS BIGINT) AS n_click, floor((epoch_us(b) - epoch_us(a)) / 1e6 + 0.5) AS seconds FROM ({SPANS_SQL}) ORDER BY n DESC, user_id LIMIT 10")
def agg_10_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).orderBy(F.desc("n"), "user_id").limit(10).select("user_id", "n", "n_click", F.floor(seconds() + 0.5).cast("double").alias("seconds"))


@query("SELECT count(*) AS n, count(DISTINCT event_type) AS n_types, count(DISTINCT user_id) AS n_users FROM events")
def agg_11_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("n_types"), F.countDistinct("user_id").alias("n_users"))


@query("""
SELECT k.lang, coalesce(n, 0) AS n FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'ko']) AS lang) k
LEFT JOIN (SELECT coalesce(lang, 'en') AS lang, count(*) AS n FROM documents GROUP BY 1) c ON c.lang = k.lang
""")
def agg_12_zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("en")).alias("lang")).agg(F.count("*").alias("n"))
    return R.zero_filled(counts, "lang", ["en", "de", "fr", "es", "ko"], "n")


@query("SELECT floor(CAST(sum(CAST(floor(a * 100000000) AS BIGINT)) AS DOUBLE) / count(*) / 100000000 * 1000 + 0.5) / 1000 AS mean FROM (SELECT CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(l_discount) AS a FROM lineitem GROUP BY l_orderkey)")
def agg_13_nested_average(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(exact_mean(F.col("l_discount")).alias("a")).agg(rounded(F.sum(F.floor(F.col("a") * 100000000)).cast("double") / F.count("*") / 100000000, 3).alias("mean"))


CODES_SQL = "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'POL-' || CAST(p_partkey % 90 AS VARCHAR) || 'X' ELSE 'POL-' || right('00' || CAST(p_partkey % 997 AS VARCHAR), 3) END"


@query(rf"SELECT p_brand, CAST(max(coalesce(TRY_CAST(regexp_extract(right({CODES_SQL}, 3), '^\s*([+-]?\d+)', 1) AS INTEGER), 0)) + 1 AS BIGINT) AS next FROM part GROUP BY 1")
def agg_14_next_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The number after the greatest that a brand's policy codes end in. A suffix counts by its leading digits, one without by 0."""
    size, key = F.col("p_size"), F.col("p_partkey")
    numbered = F.concat(F.lit("POL-"), F.lpad((key % 997).cast("string"), 3, "0"))
    code = F.when(size % 4 == 0, F.col("p_name")).when(size % 4 == 1, F.concat(F.lit("POL-"), (key % 90).cast("string"), F.lit("X"))).otherwise(numbered)
    suffix = F.coalesce(F.regexp_extract(F.right(code, F.lit(3)), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    return table(spark, d, "part").groupBy("p_brand").agg((F.max(suffix) + 1).cast("long").alias("next"))


@query("""
SELECT o_orderkey, coalesce(a, 0.0) AS confidence FROM orders LEFT JOIN (SELECT l_orderkey, floor(CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(l_tax) * 10000 + 0.5) / 10000 AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def agg_15_refresh_average(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rounded(exact_mean(F.col("l_tax")), 4).alias("a"))
    return table(spark, d, "orders").select("o_orderkey").join(a, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", F.lit(0.0)).alias("confidence"))


def tags() -> Column:
    return F.explode(F.array_distinct(F.filter(F.split(F.lower("p_name"), "[^a-z]+"), lambda t: t != ""))).alias("tag")


TAGS_SQL = "SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z]+'), lambda t: t <> ''))) AS tag FROM part"


@query(f"SELECT tag, count(*) AS n FROM ({TAGS_SQL}) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def agg_16_tag_frequency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(tags()).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query(f"SELECT DISTINCT tag FROM ({TAGS_SQL})")
def agg_17_distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(tags()).distinct()


@query("""
SELECT lang, floor(quantile_cont(n_chars, 0.25) * 1000 + 0.5) / 1000 AS p25, floor(quantile_cont(n_chars, 0.5) * 1000 + 0.5) / 1000 AS median, floor(quantile_cont(n_chars, 0.75) * 1000 + 0.5) / 1000 AS p75,
       min(n_chars) AS least, max(n_chars) AS most, floor(avg(n_chars) * 1000 + 0.5) / 1000 AS mean FROM documents GROUP BY 1
""")
def agg_18_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles out of the counts of each value, so that no task holds a language's rows."""
    return R.quantiles(table(spark, d, "documents"), "lang", "n_chars", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query("""
WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 AND toxic = 0 THEN 'junk' END], lambda x: x IS NOT NULL)) AS c FROM labels)
SELECT c AS criterion, count(*) AS n, floor(count(*) * 1000.0::DOUBLE / (SELECT count(*) FROM labels) + 0.5) / 1000 AS rate FROM f GROUP BY 1
""")
def agg_19_failure_ranking(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    failed = F.array_compact(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.when((F.col("quality") == 0) & (F.col("toxic") == 0), "junk")))
    counts = labels.select(F.explode(failed).alias("criterion")).groupBy("criterion").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("t"))
    return counts.join(F.broadcast(total)).select("criterion", "n", rounded(F.col("n") * 1.0 / F.col("t"), 3).alias("rate"))  # total: one row


@query("""
WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS p FROM conversations GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, p) AS rn FROM c)
SELECT conv_id, role FROM r WHERE rn = 1
""")
def agg_20_dominant_class(spark: SparkSession, d: str) -> DataFrame:
    return R.mode_by(table(spark, d, "conversations"), ["conv_id"], "role", "turn")


@query("""
SELECT l_partkey AS process, floor(CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(l_discount) * 100 + 0.5) / 100 AS score, count(DISTINCT l_orderkey) AS n_docs,
       bool_or(l_returnflag = 'R') AS is_core FROM lineitem GROUP BY 1
""")
def agg_21_cross_document_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("process")).agg(rounded(exact_mean(F.col("l_discount")), 2).alias("score"), F.countDistinct("l_orderkey").alias("n_docs"), F.bool_or(F.col("l_returnflag") == "R").alias("is_core"))


@query("""
SELECT l_orderkey, floor(CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(l_tax) * 1000 + 0.5) / 1000 AS score,
       CASE WHEN bool_and(l_returnflag = 'N') THEN 'validated' WHEN bool_or(l_returnflag = 'R') THEN 'unreviewed' ELSE 'reviewed' END AS level FROM lineitem GROUP BY 1
""")
def agg_22_trust(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    level = F.when(F.bool_and(flag == "N"), "validated").when(F.bool_or(flag == "R"), "unreviewed").otherwise("reviewed")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(rounded(exact_mean(F.col("l_tax")), 3).alias("score"), level.alias("level"))


@query("SELECT conv_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS depth FROM conversations GROUP BY 1")
def agg_23_text_depth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("depth"))


@query(f"""
SELECT type, count(*) AS n, CAST(sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN severity = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
       CAST(sum(CASE WHEN severity = 'LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM ({FINDINGS_SQL}) WHERE org % 10 <> 0 GROUP BY 1
""")
def agg_27_severity_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = findings(spark, d).where("org % 10 <> 0").groupBy("type").pivot("severity", ["HIGH", "MEDIUM", "LOW"]).count()
    n = lambda c: F.coalesce(c, F.lit(0))
    return p.select("type", (n("HIGH") + n("MEDIUM") + n("LOW")).alias("n"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"))


@query("""
WITH k AS (SELECT lang, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, a, b, CASE WHEN a + b > 0 THEN floor(a * 1000.0::DOUBLE / (a + b) + 0.5) / 10 ELSE 0 END AS precision_pct, CASE WHEN a + b > 0 AND floor(a * 1000.0::DOUBLE / (a + b) + 0.5) / 10 >= 75 THEN true ELSE false END AS met FROM k
""")
def agg_29_precision_kpi(spark: SparkSession, d: str, target: float = 75.0) -> DataFrame:
    k = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    k = k.groupBy("lang").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("b"))
    pct = F.when(F.col("a") + F.col("b") > 0, F.floor(F.col("a") * 1000.0 / (F.col("a") + F.col("b")) + 0.5) / F.lit(10.0)).otherwise(F.lit(0.0))
    return k.select("lang", "a", "b", pct.alias("precision_pct"), (pct >= target).alias("met"))


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, (SELECT l_returnflag FROM c c2 WHERE c2.l_suppkey = c.l_suppkey ORDER BY n DESC, p, l_returnflag LIMIT 1) AS l_returnflag FROM c GROUP BY 1
""")
def agg_31_most_referenced(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"))
    return R.mode_by(l, ["l_suppkey"], "l_returnflag", "p")


@query("""
SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1
""")
def agg_39_usage_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts >= timestamp '2024-01-10 00:00:00' AND ts < timestamp '2024-01-20 00:00:00'")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT month, n FROM (SELECT *, dense_rank() OVER (ORDER BY month DESC) AS r FROM m) WHERE r <= 6
""")
def agg_40_months_kept(spark: SparkSession, d: str, keep: int = 6) -> DataFrame:
    months = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("month")).limit(keep)


@query("SELECT c_custkey, coalesce(n, 0) AS usage_count, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def agg_41_usage_sync(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("usage_count"), "c_mktsegment")


@query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spent, sum(CAST(value AS DECIMAL(18,2))) >= 50 AS rejected FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1")
def agg_42_cost_guard(spark: SparkSession, d: str, most: int = 50) -> DataFrame:
    day = table(spark, d, "events").where(F.to_date("ts") == F.lit("2024-01-15").cast("date"))
    g = day.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("s"))
    return g.select("user_id", F.col("s").cast("double").alias("spent"), (F.col("s") >= most).alias("rejected"))


@query("SELECT coalesce(source, 'unknown') AS domain, count(*) AS n FROM documents GROUP BY 1")
def agg_43_domain_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


@query("""
SELECT split_part(p_type, ' ', 1) AS domain, p_brand AS type, count(*) AS n, min(p_name) AS first_code, max(p_name) AS last_code, floor(CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) / count(p_retailprice) * 100 + 0.5) / 100 AS mean_trust FROM part GROUP BY 1, 2
""")
def agg_45_policy_registry(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy(F.split("p_type", " ")[0].alias("domain"), F.col("p_brand").alias("type"))
    return g.agg(F.count("*").alias("n"), F.min("p_name").alias("first_code"), F.max("p_name").alias("last_code"), rounded(exact_mean(F.col("p_retailprice")), 2).alias("mean_trust"))


# ---- windows


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def win_01_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_by(table(spark, d, "conversations"), ["conv_id"], F.desc("turn")).select("conv_id", "turn", "role")


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def win_02_first_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return R.dedup_first(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events")
def win_03_running_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("run"))


@query("""
SELECT lang, doc_id, CASE WHEN r <= 10 THEN 'core' WHEN r <= 30 THEN 'important' ELSE 'standard' END AS bucket
FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)
""")
def win_04_rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Only the ranks that matter are kept by the window; all other documents are joined as standard."""
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    top = docs.withColumn("r", r).where("r <= 30").select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), "r")
    j = docs.join(top, (F.col("doc_id") == F.col("i")) & F.col("lang").eqNullSafe(F.col("l")), "left")
    return j.select("lang", "doc_id", F.when(F.col("r") <= 10, "core").when(F.col("r") <= 30, "important").otherwise("standard").alias("bucket"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def win_05_samples(spark: SparkSession, d: str) -> DataFrame:
    return R.first_n_by(table(spark, d, "events"), ["event_type"], 3, F.asc("ts"), F.asc("event_id")).select("event_type", "event_id")


@query("""
WITH w AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n, n_chars FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY source, i <= 3 ORDER BY n_chars DESC, i) AS j FROM w)
SELECT source, doc_id FROM x WHERE n <= 20 OR i <= 3 OR j <= 17
""")
def win_06_chunk_selection(spark: SparkSession, d: str) -> DataFrame:
    """All of up to 20 chunks; else the first 3 and the 17 longest others."""
    docs, by = table(spark, d, "documents").select("source", "doc_id", "n_chars"), Window.partitionBy("source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    sized = lambda df: df.join(sizes, F.col("source").eqNullSafe(F.col("s")))
    first = docs.withColumn("i", F.row_number().over(by.orderBy("doc_id"))).where("i <= 20")
    longest = docs.withColumn("j", F.row_number().over(by.orderBy(F.desc("n_chars"), "doc_id"))).where("j <= 20")
    heads = first.where("i <= 3").select(F.col("source").alias("hs"), F.col("doc_id").alias("hd"))
    rest = longest.join(heads, F.col("source").eqNullSafe(F.col("hs")) & (F.col("doc_id") == F.col("hd")), "left_anti")
    rest = rest.withColumn("k", F.row_number().over(by.orderBy("j"))).where("k <= 17")
    return sized(first).where("n <= 20 OR i <= 3").select("source", "doc_id").unionByName(sized(rest).where("n > 20").select("source", "doc_id"))


@query("SELECT s_suppkey, 'spec-api-' || lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS VARCHAR), 3, '0') AS label FROM supplier")
def win_07_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("spec-api-"), F.lpad(n.cast("string"), 3, "0")).alias("label"))


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey) * 100 + 0.5) / 100 AS share FROM lineitem")
def win_08_normalise_by_max(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("l_quantity") / F.max("l_quantity").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(share, 2).alias("share"))


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM events
""")
def win_09_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("code"))


@query("""
WITH h AS (SELECT conv_id, min(turn) AS h FROM conversations WHERE role = 'assistant' AND turn <= 10 GROUP BY 1)
SELECT c.conv_id, c.turn FROM conversations c JOIN h ON h.conv_id = c.conv_id AND c.turn > h.h
""")
def win_10_header_row(spark: SparkSession, d: str) -> DataFrame:
    header = F.min(F.when((F.col("role") == "assistant") & (F.col("turn") <= 10), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").withColumn("h", header).where("turn > h").select("conv_id", "turn")


# ---- order, limits, sets


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def srt_01_sorted_listing(spark: SparkSession, d: str, sort: str = "depth") -> DataFrame:
    keys = {"newest": F.desc("doc_id"), "oldest": F.asc("doc_id"), "depth": F.desc("n_chars"), "source": F.asc("source")}
    return table(spark, d, "documents").orderBy(keys.get(sort, keys["newest"]), "doc_id").limit(50).select("doc_id", "n_chars")


@query(f"SELECT finding_id, severity FROM ({FINDINGS_SQL}) ORDER BY {RANK_SQL}, confidence DESC NULLS LAST, finding_id LIMIT 30")
def srt_02_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).orderBy(severity_rank(F.col("severity")), F.desc_nulls_last("confidence"), "finding_id").limit(30).select("finding_id", "severity")


@query(f"SELECT finding_id FROM ({FINDINGS_SQL}) ORDER BY {RANK_SQL}, ts, finding_id LIMIT 20 OFFSET 40")
def srt_04_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(findings(spark, d), [severity_rank(F.col("severity")), F.asc("ts"), F.asc("finding_id")], 20, 40).select("finding_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 21")
def srt_05_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return R.keyset_page(table(spark, d, "orders"), "o_orderkey", 5000, 20).select("o_orderkey")


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('1:' || CAST(user_id AS VARCHAR)), user_id LIMIT 10")
def srt_06_key_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_keys(table(spark, d, "events"), "user_id", 10)


@query("""
SELECT * FROM (SELECT 'top' AS side, doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 5)
""")
def srt_07_top_and_bottom(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    end = lambda side, order: docs.orderBy(order, "doc_id").limit(5).select(F.lit(side).alias("side"), "doc_id")
    return end("top", F.desc("n_chars")).unionByName(end("bottom", F.asc("n_chars")))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def set_01_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT 'duplicate' AS type, count(*) AS n FROM documents WHERE n_chars > 2000 UNION ALL SELECT 'missing', count(*) FROM documents WHERE n_chars < 100")
def set_03_concatenation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    part = lambda name, test: docs.where(test).agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    return part("duplicate", "n_chars > 2000").unionByName(part("missing", "n_chars < 100"))


# ---- sinks as DataFrame transformations


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id // 4 END AS key, value FROM events)
SELECT event_id, key, value FROM e WHERE event_id % 12 = 0
UNION ALL SELECT event_id, key, value FROM e WHERE event_id % 12 <> 0 AND (key IS NULL
  OR key NOT IN (SELECT key FROM e WHERE event_id % 12 = 0 AND key IS NOT NULL) AND event_id = (SELECT min(f.event_id) FROM e f WHERE f.key = e.key AND f.event_id % 12 <> 0))
""")
def snk_02_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Four events share a key, some have none; every third key is there already."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.expr("event_id div 4")).alias("key"), "value")
    return R.insert_or_ignore(e.where("event_id % 12 = 0"), e.where("event_id % 12 <> 0"), ["key"], F.asc("event_id"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events")
def snk_03_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value")
    return R.upsert(e, e.where("event_id % 5 = 0").withColumn("value", F.col("value") + 1), ["event_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def snk_04_conditional_update(spark: SparkSession, d: str) -> DataFrame:
    old = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", F.when(old, "X").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""
SELECT conv_id, count(*) AS completed, CASE WHEN count(*) >= 4 THEN 'completed' ELSE 'running' END AS status FROM conversations GROUP BY 1
""")
def snk_05_counters(spark: SparkSession, d: str, total: int = 4) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("completed")).withColumn("status", F.when(F.col("completed") >= total, "completed").otherwise("running"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'vip' ELSE c_mktsegment END AS segment FROM customer")
def snk_06_bulk_update(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return table(spark, d, "customer").join(ids, "c_custkey", "left").select("c_custkey", F.when(F.col("hit"), "vip").otherwise(F.col("c_mktsegment")).alias("segment"))


@query("SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, floor(value)")
def snk_07_dedup_delete(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))
    return R.dedup_first(e, ["user_id", "event_type", "v"], "event_id").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def snk_08_delete_with_children(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-30 00:00:00'")
def snk_14_ttl_cache(spark: SparkSession, d: str, now: str = "2024-01-30 00:00:00") -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.where(F.col("ts") + F.expr("interval 1 hour") >= F.lit(now).cast("timestamp"))
