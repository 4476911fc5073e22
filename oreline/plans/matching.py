"""Matching, gap, graph and model plans over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gaps as G
from ..operators import graph as N
from ..operators import matching as M
from ..operators import models as D
from .registry import query, table


@query("""
WITH s AS (SELECT p_partkey AS src, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0),
t AS (SELECT p_partkey AS doc, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1)
SELECT src, doc, 1.0::DOUBLE AS score FROM s JOIN t USING (p_name, k)
""")
def join_04_exact_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("key", T.normalize_table(F.concat(F.lit("TB_"), F.replace("p_name", F.lit(" "), F.lit("_")))))
    return M.pair_by_rank(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("src"), "key"), p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("doc"), "key"), 1.0)


@query("""
WITH r AS (SELECT page_id, array_to_string(s[greatest(1, len(s) - 1):], '/') AS k FROM (SELECT page_id, list_filter(string_split(regexp_replace(lower(url), '^https?://[^/]+', ''), '/'), lambda x: x <> '') AS s FROM pages)),
a AS (SELECT page_id AS src, k, row_number() OVER (PARTITION BY k ORDER BY page_id) AS n FROM r WHERE page_id % 2 = 0 AND contains(k, '/')), b AS (SELECT page_id AS doc, k, row_number() OVER (PARTITION BY k ORDER BY page_id) AS n FROM r WHERE page_id % 2 = 1 AND contains(k, '/'))
SELECT src, doc, 0.85::DOUBLE AS score FROM a JOIN b USING (k, n)
""")
def join_05_resource_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", T.resource_path(F.col("url")).alias("key")).where(F.col("key").contains("/"))
    return M.pair_by_rank(p.where("page_id % 2 = 0").select(F.col("page_id").alias("src"), "key"), p.where("page_id % 2 = 1").select(F.col("page_id").alias("doc"), "key"), 0.85)


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations' texts as named things: the words of each."""
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.length(w) >= 2)).alias("tokens"))


LINES_SQL = r"SELECT conv_id * 1000 + turn AS id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: length(w) >= 2)) AS t FROM conversations"
JACCARD_SQL = "len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t)))"


@query(f"WITH l AS ({LINES_SQL}) SELECT a.id AS src, b.id AS doc, {JACCARD_SQL} AS score FROM l a JOIN l b ON a.id % 2 = 0 AND b.id % 2 = 1 AND len(a.t) > 0 AND len(b.t) > 0 AND {JACCARD_SQL} >= 0.3")
def join_06_fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    l = first_lines(spark, d)
    return M.token_pairs(l.where("id % 2 = 0").withColumnRenamed("id", "src"), l.where("id % 2 = 1").withColumnRenamed("id", "doc"), 0.3)


@query("""
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '') AS b FROM part), m AS (SELECT DISTINCT replace(p_name, ' ', '') || CASE WHEN p_size % 2 = 0 THEN 's' ELSE 'xyz' END AS a FROM part)
SELECT a, b FROM m JOIN n ON a <> b AND levenshtein(a, b) <= 2
""")
def join_07_edit_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    left = p.select(F.concat(name, F.when(F.col("p_size") % 2 == 0, "s").otherwise("xyz")).alias("a")).distinct().withColumn("src", F.col("a"))
    right = p.select(name.alias("b")).distinct().withColumn("doc", F.col("b"))
    return M.edit_pairs(left, right).select("a", "b")


@query("""
WITH a AS (SELECT DISTINCT p_name AS x FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS y FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT x, y FROM a JOIN b ON contains(x, y) OR contains(y, x)
""")
def join_13_contains(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    left = p.select(F.col("p_name").alias("a")).distinct().withColumn("src", F.col("a"))
    right = p.select(F.split("p_name", " ")[1].alias("b")).union(p.select(F.lower("p_type"))).distinct().withColumn("doc", F.col("b"))
    return M.contains_pairs(left, right).select(F.col("src").alias("x"), F.col("doc").alias("y"))


@query(f"""
WITH l AS (SELECT * FROM ({LINES_SQL}) WHERE len(t) > 0)
SELECT a.id AS i, b.id AS j, len(list_intersect(a.t, b.t))::DOUBLE / len(a.t) AS overlap FROM l a JOIN l b ON a.id < b.id AND len(list_intersect(a.t, b.t)) >= 0.5 * len(a.t)
""")
def join_16_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return M.overlap_pairs(first_lines(spark, d), 0.5)


@query(f"WITH l AS ({LINES_SQL}) SELECT a.id AS src, b.id AS doc, {JACCARD_SQL} AS score FROM l a JOIN l b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND {JACCARD_SQL} > 0.7")
def join_17_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    l = first_lines(spark, d)
    return M.token_pairs(l.withColumnRenamed("id", "src"), l.withColumnRenamed("id", "doc"), 0.7).where("src < doc and score > 0.7")


@query("""
WITH e AS (SELECT conv_id AS doc, unnest([role, 'x_' || CAST(turn % 3 AS VARCHAR)]) AS name FROM conversations), k AS (SELECT conv_id AS doc, role AS name FROM conversations WHERE role IN ('user', 'assistant'))
SELECT DISTINCT e.doc, e.name, 'missing' AS type, 'warning' AS severity FROM e LEFT JOIN k ON k.doc = e.doc AND k.name = e.name WHERE k.name IS NULL
""")
def join_19_missing_references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    relations = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("position"), F.col("role").alias("src"), F.concat(F.lit("x_"), (F.col("turn") % 3).cast("string")).alias("dst"), F.lit("uses").alias("type"))
    known = lambda test: c.where(test).select(F.col("conv_id").alias("doc"), F.col("role").alias("name"))
    return D.missing_references(relations, known("role = 'user'"), known("role = 'assistant'")).select("doc", "name", "type", "severity")


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AND c_mktsegment <> 'MACHINERY'
""")
def join_21_deprecation_candidates(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "orders").where("o_orderdate >= timestamp '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").join(used, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""
WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1)
SELECT p_partkey, coalesce(n, 0) AS n, CASE WHEN p_size % 3 = 0 THEN 'UNKNOWN' WHEN coalesce(n, 0) > 0 THEN 'OPEN' ELSE 'RESOLVED' END AS recommended FROM part LEFT JOIN a ON l_partkey = p_partkey
""")
def join_22_marker_cross_check(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    j = table(spark, d, "part").join(found, "p_partkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("p_partkey", "n", D.marker_status(F.lit("OPEN"), F.col("n"), F.col("p_size") % 3 != 0).alias("recommended"))


@query("SELECT p_partkey FROM part WHERE split_part(p_name, ' ', 1) IN (SELECT lower(c_mktsegment) FROM customer) OR lower(p_type) IN (SELECT split_part(p_name, ' ', 1) FROM part)")
def join_24_domain_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.split("p_name", " ")[0].alias("k")), F.struct(F.lit(1).alias("s"), F.lower("p_type").alias("k")))).alias("x"))
    keys = table(spark, d, "customer").select(F.lit(0).alias("s"), F.lower("c_mktsegment").alias("k")).union(table(spark, d, "part").select(F.lit(1), F.split("p_name", " ")[0]))
    return p.select("p_partkey", "x.s", "x.k").join(keys.distinct(), ["s", "k"], "left_semi").select("p_partkey").distinct()


@query("""
SELECT coalesce(n_name, 'unassigned') AS entity, string_agg(s_name, ',' ORDER BY s_name) AS attributes FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = s_nationkey GROUP BY 1
""")
def join_25_attributes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = table(spark, d, "supplier").join(n, "s_nationkey", "left")
    return j.groupBy(F.coalesce("n_name", F.lit("unassigned")).alias("entity")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("attributes"))


GAPS_SQL = """SELECT event_id, coalesce(event_type, '?') AS domain, CASE WHEN value >= 80 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, user_id % 4 = 0 AS noise, user_id FROM events"""


@query(f"""
SELECT domain, count(*) AS total, CAST(sum(CASE WHEN severity = 'HIGH' AND NOT noise THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN severity = 'MEDIUM' AND NOT noise THEN 1 ELSE 0 END) AS BIGINT) AS medium,
 CAST(sum(CASE WHEN severity = 'LOW' AND NOT noise THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN noise THEN 1 ELSE 0 END) AS BIGINT) AS noise,
 (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT event_id AS x FROM events e WHERE e.event_type = g.domain ORDER BY event_id LIMIT 3)) AS samples FROM ({GAPS_SQL}) g GROUP BY domain
""")
def agg_24_domain_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.coalesce("event_type", F.lit("?")).alias("domain"), F.when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 40, "MEDIUM").otherwise("LOW").alias("severity"), (F.col("user_id") % 4 == 0).alias("noise"), F.lit("SM").alias("gap_type"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("description"))
    return G.domain_summary(e).withColumn("samples", F.array_join("samples", ","))


@query(f"SELECT user_id AS document, count(*) AS total, CAST(sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CASE WHEN sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) >= 5 THEN 'HIGH' WHEN sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM ({GAPS_SQL}) GROUP BY 1")
def agg_25_suggestions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("document"), F.when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 40, "MEDIUM").otherwise("LOW").alias("severity"))
    return G.suggestions(e)


@query("""
WITH m AS (SELECT lang, count(*) AS n, count(CASE WHEN n_chars >= 1000 THEN 1 END) AS k FROM documents GROUP BY 1) SELECT lang, CASE WHEN n > 0 THEN floor(k * 1000.0::DOUBLE / n + 0.5) / 10 ELSE 0 END AS coverage FROM m
""")
def agg_28_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_chars") >= 1000, 1)).alias("k"))
    return m.select("lang", G.coverage(F.col("k"), F.col("n")).alias("coverage"))


@query("""
WITH c AS (SELECT l_orderkey AS t, l_linenumber AS c, l_returnflag AS sql, l_tax > 0.07 AS pk, l_linestatus AS o, l_shipdate, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem)
SELECT t AS "table", c AS "column", min_by(sql, p) AS sql, bool_or(pk) AS "primary" FROM c GROUP BY 1, 2
""")
def agg_32_merge_columns(spark: SparkSession, d: str) -> DataFrame:
    position = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("column"), F.col("l_returnflag").alias("sql"), (F.col("l_tax") > 0.07).alias("primary"), F.col("l_linestatus").alias("origin"), position.alias("position"))
    return G.merge_table_columns(c).select("table", "column", "sql", "primary")


@query("""
WITH q AS (SELECT l_orderkey, CASE min(l_returnflag) WHEN 'A' THEN 'insert' ELSE 'select' END AS kind, list_distinct(list(l_suppkey)) AS ts FROM lineitem GROUP BY 1),
t AS (SELECT kind, len(ts) AS n, unnest(ts) AS t FROM q)
SELECT t AS "table", sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) >= 3 AS entity, sum(CASE WHEN kind = 'insert' THEN 1 ELSE 0 END) >= 2 AS transaction_ FROM t GROUP BY 1
""")
def agg_33_table_relevance(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.min("l_returnflag") == "A", "insert").otherwise("select").alias("kind"), F.collect_set("l_suppkey").alias("tables"))
    return G.table_relevance(q).select("table", "entity", F.col("transaction").alias("transaction_"))


@query("""
SELECT doc_id AS src, CASE WHEN toxic IS NOT NULL THEN doc_id END AS doc, coalesce(quality * 1.0::DOUBLE, 0.0) AS score, toxic IS NOT NULL AND quality > 0 AS matched FROM documents LEFT JOIN labels USING (doc_id)
""")
def mod_15_trace_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "labels").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("doc"), F.col("quality").cast("double").alias("score"))
    return G.trace_matrix(table(spark, d, "documents").select(F.col("doc_id").alias("src")), m)


# ---- graphs

TERMS_SQL = "SELECT DISTINCT l_orderkey AS grp, 's' || CAST(l_suppkey AS VARCHAR) AS label FROM lineitem"


def terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("label")).distinct()


@query(f"SELECT count(*) AS n_terms, count(DISTINCT label) AS n_labels, count(DISTINCT grp) AS n_groups FROM ({TERMS_SQL})")
def grf_01_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).agg(F.count("*").alias("n_terms"), F.countDistinct("label").alias("n_labels"), F.countDistinct("grp").alias("n_groups"))


@query(f"SELECT label, count(*) AS n, min(grp) AS first_group FROM ({TERMS_SQL}) GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def grf_02_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("grp").alias("first_group")).orderBy(F.desc("n"), "label").limit(20)


@query(f"WITH t AS ({TERMS_SQL}) SELECT label, count(*) AS weight FROM t WHERE label <> 's7' AND grp IN (SELECT grp FROM t WHERE label = 's7') GROUP BY 1")
def grf_03_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbours(terms(spark, d), "s7")


@query(f"WITH t AS ({TERMS_SQL}) SELECT x.label AS a, y.label AS b, count(*) AS weight FROM t x JOIN t y ON x.grp = y.grp AND x.label < y.label GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 300")
def grf_04_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return N.cooccurrence(terms(spark, d)).orderBy(F.desc("weight"), "a", "b").limit(300)


@query("SELECT c_custkey AS src, o_orderkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY 1, 2 LIMIT 100")
def grf_05_default_read(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).join(table(spark, d, "customer").select(F.col("c_custkey").alias("src")), "src").orderBy("src", "dst").limit(100)


@query("SELECT user_id AS key, max_by(event_type, event_id) AS label FROM events GROUP BY 1")
def grf_06_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("label"), F.col("event_id").alias("version"))
    return N.merge_nodes(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ["key"]).select("key", "label")


@query("""
WITH s AS (SELECT doc_id AS key, unnest(['machineReadable', 'testable', 'traceable']) AS criterion, unnest([quality * 0.9::DOUBLE, 1.0 - toxic * 0.5::DOUBLE, 0.8::DOUBLE]) AS score FROM labels)
SELECT key, floor(avg(score) * 1000 + 0.5) / 1000 AS overall, CAST(sum(CASE WHEN score >= CASE criterion WHEN 'machineReadable' THEN 0.9 WHEN 'testable' THEN 0.7 ELSE 0.8 END THEN 1 ELSE 0 END) AS BIGINT) AS n_passed,
 coalesce(string_agg(CASE WHEN score < CASE criterion WHEN 'machineReadable' THEN 0.9 WHEN 'testable' THEN 0.7 ELSE 0.8 END THEN criterion END, ',' ORDER BY criterion), '') AS failed, floor(avg(score) * 1000 + 0.5) / 1000 >= 0.8 AS ready FROM s GROUP BY 1
""")
def mod_10_readiness(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(F.struct(F.lit("machineReadable").alias("criterion"), (F.col("quality") * 0.9).alias("score")), F.struct(F.lit("testable").alias("criterion"), (1.0 - F.col("toxic") * 0.5).alias("score")), F.struct(F.lit("traceable").alias("criterion"), F.lit(0.8).alias("score")))
    return D.readiness_summary(table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.explode(s).alias("x")).select("key", "x.*"))


@query("SELECT user_id, a, CASE WHEN a >= 0.67 THEN 'APPLICABLE' WHEN a <= 0.33 THEN 'NOT_APPLICABLE' ELSE 'SPLIT' END AS verdict FROM (SELECT user_id, floor(avg(CASE WHEN starts_with(event_type, 'c') OR starts_with(event_type, 'v') THEN 1.0::DOUBLE ELSE 0.0 END) * 1000 + 0.5) / 1000 AS a FROM events GROUP BY 1)")
def agg_38_provider_vote(spark: SparkSession, d: str) -> DataFrame:
    yes = F.col("event_type").startswith("c") | F.col("event_type").startswith("v")
    g = table(spark, d, "events").groupBy("user_id").agg(T.rounded(F.avg(F.when(yes, 1.0).otherwise(0.0)), 3).alias("a"))
    return g.withColumn("verdict", D.vote_verdict(F.col("a")))


@query("SELECT o_orderkey, o_totalprice / 500000 >= 0.75 AND o_orderstatus <> 'P' AS passed FROM orders")
def mod_22_handoff_gate(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "P", "DENIED").otherwise("APPROVED")
    return table(spark, d, "orders").select("o_orderkey", D.handoff_gate(F.col("o_totalprice") / 500000, verdict).alias("passed"))
