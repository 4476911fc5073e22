"""Fact check, term joins and policy reports over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity
from ..operators import factcheck as C
from ..operators import gaps as G
from ..operators import matching as M
from ..operators import models as D
from ..operators import policies as P
from ..operators import skills as K
from .registry import query, table
from .specs import CONTROLLERS, KOREAN_SQL, PARAMS_SQL, korean, nth, params

# ---- both sides of a fact check: even parts are implemented, odd ones documented


def fact_spec(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p, key = table(spark, d, "part"), F.col("p_partkey")
    one, two = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    brand = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    slash = lambda *parts: F.concat(*(x for part in parts for x in (F.lit("/"), part)))
    coded = F.element_at(F.array(slash(F.lit("api/v1"), one, two), F.concat(F.lit("https://host"), slash(one, brand, F.lit("{id}"))), slash(one, F.concat(two, F.lit("List"))), slash(F.lit("internal"), one, two), slash(F.lit("v2.1"), two, brand)), (F.col("p_size") % 5 + 1).cast("int"))
    spelt = F.when(F.col("p_size") % 3 == 0, F.array(slash(F.lit("alt"), one, brand), slash(two, one))).when(F.col("p_size") % 3 == 2, F.array().cast("array<string>"))
    told = F.element_at(F.array(slash(F.lit("api/V1"), F.upper(one), two, F.lit("")), slash(one, brand, F.lit(":key")), slash(one, two, F.lit("list")), slash(F.lit("alt"), one, brand), slash(F.lit("old"), two, brand, F.lit("x"))), (F.col("p_size") % 5 + 1).cast("int"))
    even, odd = p.where(key % 2 == 0), p.where(key % 2 == 1)
    s, sk = table(spark, d, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("TB_NATION_"), F.col("s_nationkey").cast("string"), F.when(sk % 3 == 0, "_HIST").otherwise(""))
    spoken = F.concat(F.lit("t_nation_"), F.col("s_nationkey").cast("string"), F.when(sk % 4 == 1, "s").otherwise(F.when(sk % 4 == 3, "_hist").otherwise("")))
    fields = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(j).alias("java"), F.lit(k).alias("primary")) for n, j, k in (("orderId", "Long", True), ("amount", "BigDecimal", False), ("memo", "String", False))))
    cells = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("sql"), F.lit(k).alias("primary")) for i, (n, t, k) in enumerate((("ORDER_ID", "VARCHAR(20)", True), ("AMOUNT", "NUMBER(10)", False), ("NOTE", "CLOB", False)))))
    source, document = s.where(sk % 2 == 0), s.where(sk % 2 == 1)
    noise = F.when(sk % 10 == 0, "dual").when(sk % 10 == 2, name).otherwise(name)
    args = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(a).alias("annotation"), F.lit(r).alias("required")) for n, t, a, r in (("id", "Long", "@PathVariable", True), ("q", "String", "@RequestParam", True), ("page", "Integer", "@RequestParam", False))))
    said = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("required")) for n, r in (("ID", True), ("Page", False), ("size", False))))
    return {
        "apis": even.select(key.alias("src"), coded.alias("path"), F.concat(F.lit("get"), two).alias("method"), spelt.alias("alternatives"), nth(CONTROLLERS, key).alias("controller")),
        "doc_apis": odd.select(key.alias("doc"), told.alias("path"), (key % 3 == 0).alias("required")),
        "tables": source.select(sk.alias("src"), noise.alias("name"), F.lit(3).alias("n_columns")),
        "doc_tables": document.select(sk.alias("doc"), spoken.alias("name")),
        "columns": source.select(sk.alias("src"), F.explode(fields).alias("x")).select("src", "x.*"),
        "doc_columns": document.select(sk.alias("doc"), F.explode(cells).alias("x")).select("doc", "x.*"),
        "params": even.select(key.alias("src"), coded.alias("path"), F.explode(args).alias("x")).select("src", "path", "x.*"),
        "doc_params": odd.select(key.alias("doc"), F.explode(said).alias("x")).select("doc", "x.*"),
    }


@query()
def join_04_endpoint_match(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints by ranked spellings, by resource and (JOIN-06) by similar words: one document for a source."""
    s = fact_spec(spark, d)
    return M.match_endpoints(s["apis"], s["doc_apis"])


@query()
def join_07_table_match(spark: SparkSession, d: str) -> DataFrame:
    s = fact_spec(spark, d)
    return M.match_tables(s["tables"], s["doc_tables"])


@query()
def mod_14_fact_check(spark: SparkSession, d: str) -> DataFrame:
    s = fact_spec(spark, d)
    return C.fact_check_summary(s, *C.fact_check(s))


@query()
def mod_14_gaps(spark: SparkSession, d: str) -> DataFrame:
    return C.fact_check(fact_spec(spark, d))[1]


@query("""
WITH c AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS n FROM lineitem)
SELECT s, CASE WHEN n % 3 = 0 THEN 'colName' || CAST(n AS VARCHAR) END AS name, 'SM' AS type, CASE WHEN n = 3 THEN 'HIGH' ELSE 'LOW' END AS severity FROM c WHERE n % 3 = 0
UNION ALL SELECT s, 'colName' || CAST(n AS VARCHAR), 'TM', 'HIGH' FROM c WHERE n % 3 <> 0 AND n % 2 = 0 UNION ALL SELECT s, 'EXTRA' || CAST(n AS VARCHAR), 'SM', 'LOW' FROM c WHERE n = 5
""")
def join_08_column_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each supplier's table in camel and in snake case; some lack, some differ in type, some are only documented."""
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("n")).distinct()
    number = F.col("n").cast("string")
    source = c.select("src", F.concat(F.lit("colName"), number).alias("column"), F.when(F.col("n") % 2 == 0, "LocalDate").otherwise("String").alias("java"), (F.col("n") == 3).alias("primary"))
    t = c.select((-F.col("src") - 1).alias("doc"), F.col("n"), F.col("n").alias("position"))
    shape = lambda df, name: df.select("doc", "position", F.concat(F.lit(name), number).alias("column"), F.lit("VARCHAR(9)").alias("sql"), F.lit(False).alias("primary"))
    document = shape(t.where("n % 3 <> 0"), "COL_NAME").unionByName(shape(t.where("n = 5"), "EXTRA"))
    pairs = c.select("src", (-F.col("src") - 1).alias("doc")).distinct()
    found = G.column_gaps(pairs, source, document, M.match_columns(pairs, source, document))
    return found.select(F.col("src").alias("s"), F.col("column").alias("name"), F.col("gap_type").alias("type"), "severity")


@query(f"""
WITH c AS (SELECT * FROM ({PARAMS_SQL}))
SELECT p_partkey AS api, name, 'doc' AS lacking, CASE WHEN p_partkey % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM c WHERE p_partkey % 2 = 0 AND NOT (contains(lower(note), 'requestheader') OR (name = 'Auth' AND type = 'String') OR contains(lower(note), 'pathvariable') OR contains(path, '{{' || name || '}}'))
UNION ALL SELECT p_partkey, 'extra', 'source', 'MEDIUM' FROM c WHERE p_partkey % 5 = 0
""")
def join_10_parameter_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parameters by name without case: even parts' are not documented, every fifth part documents one more."""
    s = params(spark, d).withColumnRenamed("note", "annotation").withColumn("required", F.col("p_partkey") % 3 == 0).withColumnRenamed("p_partkey", "src")
    doc = (-F.col("src") - 1).alias("doc")
    told = s.where("src % 2 = 1").select(doc, F.upper("name").alias("name"), F.lit(True).alias("required")).unionByName(s.where("src % 5 = 0").select(doc, F.lit("extra").alias("name"), F.lit(False).alias("required")))
    found = G.parameter_gaps(s.select("src", doc), s, told)
    return found.select(F.col("src").alias("api"), "name", "lacking", "severity")


@query("""
WITH s AS (SELECT ['GET', 'POST'][CAST(o_orderkey % 2 AS INTEGER) + 1] || ' /c/' || CAST(o_custkey AS VARCHAR) || '/:id' AS k, max_by(o_custkey % 4, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
t AS (SELECT ['GET', 'POST'][CAST(o_orderkey % 2 AS INTEGER) + 1] || ' /c/' || CAST(o_custkey + o_orderkey % 3 AS VARCHAR) || '/:id' AS k, max_by(o_custkey % 3, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(s.k, t.k) AS endpoint, CASE WHEN s.k IS NULL THEN 'DOC_ONLY' WHEN t.k IS NULL THEN 'SOURCE_MISSING' WHEN s.n <> t.n THEN 'DIVERGENCE' ELSE 'MATCH' END AS state FROM s FULL JOIN t ON s.k = t.k
""")
def join_11_reconciled_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """METHOD path on both sides, braces and trailing slashes made alike; the last of equal keys counts."""
    o = table(spark, d, "orders")
    method = nth(("GET", "POST"), F.col("o_orderkey"))
    path = lambda of, end: F.concat(F.lit("/c/"), of.cast("string"), F.lit(end))
    side = lambda df, of, end, m: df.select(method.alias("method"), path(of, end).alias("path"), (F.col("o_custkey") % m).alias("params"), F.col("o_orderkey").alias("position"))
    return P.reconcile(side(o.where("o_orderstatus <> 'P'"), F.col("o_custkey"), "/{id}/", 4), side(o.where("o_orderstatus <> 'F'"), F.col("o_custkey") + F.col("o_orderkey") % 3, "/:id", 3))


@query("""
WITH t AS (SELECT l_orderkey AS tab, l_linenumber AS n, min(l_quantity) > 10 AS nullable FROM lineitem GROUP BY 1, 2)
SELECT tab, 'c' || CAST(n AS VARCHAR) AS col, CASE WHEN n <= 3 AND tab % 4 <> 0 THEN 'T' || CAST(n AS VARCHAR) END AS java, CASE WHEN n <= 3 AND tab % 4 <> 0 THEN n = 2 ELSE nullable END AS nullable FROM t
""")
def join_12_vo_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Columns take type and nullability from the data class that their table names, by property."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity") > 10).alias("nullable"))
    n = F.col("l_linenumber").cast("string")
    columns = t.select(F.col("l_orderkey").alias("table"), F.concat(F.lit("c"), n).alias("column"), F.concat(F.lit("f"), n).alias("property"), F.when(F.col("l_orderkey") % 4 != 0, F.lit("com.x.PartVO")).otherwise("NoVO").alias("vo"), "nullable")
    fields = t.select("l_linenumber").distinct().where("l_linenumber <= 3").select(F.lit("PartVO").alias("class_name"), F.concat(F.lit("f"), n).alias("field"), F.concat(F.lit("T"), n).alias("type"), (F.col("l_linenumber") == 2).alias("nullable"))
    return P.enrich_columns(columns, fields).select(F.col("table").alias("tab"), F.col("column").alias("col"), "java", "nullable")


NAMES_SQL = "SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part"
UNITS_SQL = "SELECT DISTINCT split_part(p_name, ' ', 2) || 'Controller' AS unit FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer"
MAPS_SQL = "SELECT split_part(p_name, ' ', 1) AS document_name, substring(split_part(p_name, ' ', 2), 1, 3) AS source_name, max((p_size % 10) / 10.0::DOUBLE) AS score FROM part WHERE p_size % 4 = 0 GROUP BY 1, 2"


def term_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, d, "part")
    one, two = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    units = p.select(F.concat(two, F.lit("Controller")).alias("unit")).union(table(spark, d, "customer").select(F.lower("c_mktsegment"))).distinct()
    maps = p.where("p_size % 4 = 0").groupBy(one.alias("document_name"), F.substring(two, 1, 3).alias("source_name")).agg(F.max((F.col("p_size") % 10) / 10.0).alias("score"))
    return p.select(one.alias("name")).distinct(), units, maps


@query(f"""
WITH n AS ({NAMES_SQL}), u AS ({UNITS_SQL}), m AS ({MAPS_SQL}),
x AS (SELECT name, unit, score, source_name FROM n JOIN m ON contains(lower(document_name), lower(name)) OR contains(lower(name), lower(document_name)) JOIN u ON contains(lower(unit), lower(source_name)) OR contains(lower(source_name), lower(unit)))
SELECT name, unit, score AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, lower(source_name), unit) AS k FROM x) WHERE k = 1
""")
def join_14_term_mappings(spark: SparkSession, d: str) -> DataFrame:
    return C.best_terms(*term_tables(spark, d))


STEM = "regexp_replace(lower(regexp_replace(regexp_replace({}, '^.*\\.', ''), '(?i)(Controller|Service|Impl|VO|DTO|Mapper|Repository|Dao)$', '')), '[_\\s-]', '', 'g')"
ENTITIES_SQL = "SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '_VO' ELSE '' END AS name FROM customer UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part"
SPELT_SQL = "SELECT DISTINCT 'TB_' || split_part(p_name, ' ', 2) AS unit, 'TB_' || split_part(p_name, ' ', 2) AS spelling FROM part UNION SELECT DISTINCT 'TB_' || split_part(p_name, ' ', 2), 'com.x.' || split_part(p_name, ' ', 1) || 'VO' FROM part UNION SELECT DISTINCT c_mktsegment || '_log', c_mktsegment || '_log' FROM customer"


def spelt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities of documents, and tables with their names and the names of their data classes."""
    p, c = table(spark, d, "part"), table(spark, d, "customer")
    one, two = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    names = c.select(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "_VO").otherwise("")).alias("name")).union(p.select(two)).distinct()
    unit = F.concat(F.lit("TB_"), two)
    log = F.concat("c_mktsegment", F.lit("_log"))
    units = p.select(unit.alias("unit"), unit.alias("spelling")).union(p.select(unit, F.concat(F.lit("com.x."), one, F.lit("VO")))).union(c.select(log, log)).distinct()
    return names, units


@query(f"""
WITH a AS (SELECT name, {STEM.format("name")} AS a FROM ({ENTITIES_SQL})), b AS (SELECT unit, {STEM.format("spelling")} AS b FROM ({SPELT_SQL}))
SELECT DISTINCT name, unit FROM a JOIN b ON a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a))
""")
def join_15_entity_tables(spark: SparkSession, d: str) -> DataFrame:
    return C.stem_pairs(*spelt(spark, d))


@query(f"""
WITH a AS (SELECT name, {STEM.format("name")} AS a FROM ({ENTITIES_SQL})), b AS (SELECT unit, {STEM.format("spelling")} AS b FROM ({SPELT_SQL})), j AS (SELECT name, min(unit) AS unit FROM a JOIN b ON a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) GROUP BY 1),
m AS (SELECT count(*) AS n FROM (SELECT DISTINCT name FROM a) x), k AS (SELECT count(*) AS matched FROM j), u AS (SELECT count(*) AS rest FROM (SELECT DISTINCT unit FROM b) y WHERE unit NOT IN (SELECT unit FROM j))
SELECT n + rest AS items, matched, n + rest - matched AS gaps, floor(matched * 1000.0::DOUBLE / (n + rest) + 0.5) / 10 AS coverage FROM m, k, u
""")
def mod_16_architecture(spark: SparkSession, d: str) -> DataFrame:
    """Documented entities against tables; no term mappings, so that names decide."""
    names, units = spelt(spark, d)
    none = spark.createDataFrame([], "document_name string, source_name string, score double")
    level = F.when(F.length("name") > 8, "HIGH").otherwise("LOW")
    return C.perspective(names, units.select("unit").distinct(), units, none, level, F.when(F.length("unit") > 8, "HIGH").otherwise("LOW"))[1]


@query()
def mod_16_process_items(spark: SparkSession, d: str) -> DataFrame:
    """Documented names against controllers, by stem and then by term mappings: the hundred weightiest items."""
    names, units, maps = term_tables(spark, d)
    level = F.when(F.length("name") > 5, "HIGH").otherwise("MEDIUM")
    return C.perspective(names, units, units.select("unit", F.col("unit").alias("spelling")), maps, level, F.when(F.length("unit") > 12, "HIGH").otherwise("LOW"))[0]


WORDS_SQL = r"SELECT conv_id * 1000 + turn AS id, turn AS created, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) >= 2)) AS t, text, role AS outcome FROM conversations"


@query(f"""
WITH l AS (SELECT * FROM ({WORDS_SQL}) WHERE len(t) > 0) SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t))::DOUBLE / len(a.t) AS overlap FROM l a JOIN l b ON (a.created > b.created OR (a.created = b.created AND a.id < b.id)) AND a.outcome IS DISTINCT FROM b.outcome AND len(list_intersect(a.t, b.t)) >= 0.5 * len(a.t)
""")
def join_16_policy_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return C.conflicts(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("created"), F.col("text").alias("condition"), F.col("role").alias("outcome")))


@query(r"""
WITH l AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS t FROM part)
SELECT a.id AS candidate, b.id AS existing FROM l a JOIN l b ON a.id % 2 = 0 AND b.id % 2 = 1 AND len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) > 0.8
""")
def join_18_candidate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("tokens"))
    side = lambda k, name: p.where(F.col("p_partkey") % 2 == k).select(F.col("p_partkey").alias(name), "tokens")
    return P.duplicate_policies(side(0, "candidate"), side(1, "existing"), 0.8)


@query(f"""
WITH r AS (SELECT p_partkey AS doc, unnest(m) AS name, generate_subscripts(m, 1) AS i FROM (SELECT p_partkey, regexp_extract_all(t, '([가-힣]+(?:\\s[가-힣]+)?)\\s(?:시|경우|때|후|전)', 1) AS m FROM ({KOREAN_SQL}))),
p AS (SELECT DISTINCT p_partkey AS doc, substring(t, 1, 2) AS pname FROM ({KOREAN_SQL})),
o AS (SELECT * FROM r WHERE length(name) >= 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc = r.doc AND (contains(pname, name) OR contains(name, pname))))
SELECT doc, name FROM o WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc = o.doc AND b.i < o.i AND contains('규칙 조건에서 참조하는 ''' || b.name || '''에 대응하는 프로세스가 정의되어 있지 않습니다.', o.name))
""")
def join_20_orphan_conditions(spark: SparkSession, d: str) -> DataFrame:
    k = korean(spark, d).withColumnRenamed("p_partkey", "doc")
    return D.orphan_conditions(k.select("doc", F.lit(0).alias("position"), F.col("t").alias("condition"), F.lit("done").alias("outcome")), k.select("doc", F.substring("t", 1, 2).alias("name"))).select("doc", "name")


@query("""
WITH i AS (SELECT s_suppkey AS id, '/s/' || CAST(s_nationkey AS VARCHAR) AS path FROM supplier), g AS (SELECT c_custkey AS gap, CASE c_custkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'api' ELSE 'text' END AS form, '/s/' || CAST(c_nationkey AS VARCHAR) AS path FROM customer)
SELECT DISTINCT id, gap FROM i JOIN g ON CASE WHEN form = 'text' THEN contains('broken ' || g.path || ' here', i.path) ELSE g.path = i.path END
""")
def join_26_spec_gaps(spark: SparkSession, d: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("/s/"), F.col(c).cast("string"))
    k = F.col("c_custkey") % 3
    item = F.when(k == 0, F.to_json(F.struct(path("c_nationkey").alias("path")))).when(k == 1, F.to_json(F.struct(path("c_nationkey").alias("api")))).otherwise(F.concat(F.lit("broken "), path("c_nationkey"), F.lit(" here")))
    return C.spec_gaps(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), path("s_nationkey").alias("path")), table(spark, d, "customer").select(F.col("c_custkey").alias("gap"), item.alias("source_item")))


# ---- aggregates


@query("""
WITH g AS (SELECT user_id, event_type, CASE WHEN value >= 80 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS s, CASE WHEN event_id % 7 = 0 THEN 'sql_alias' WHEN event_id % 7 = 1 THEN 'health_check' END AS noise FROM events),
a AS (SELECT user_id, string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS by_type FROM (SELECT user_id, event_type, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1), b AS (SELECT user_id, string_agg(s || '=' || CAST(n AS VARCHAR), ',' ORDER BY s) AS by_severity FROM (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT user_id, string_agg(noise || '=' || CAST(n AS VARCHAR), ',' ORDER BY noise) AS by_noise FROM (SELECT user_id, noise, count(*) AS n FROM g WHERE noise IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, by_type, by_severity, coalesce(by_noise, '') AS by_noise FROM a JOIN b USING (user_id) LEFT JOIN c USING (user_id)
""")
def agg_26_gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id") % 7
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("gap_type"), F.when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 40, "MEDIUM").otherwise("LOW").alias("severity"), F.when(key == 0, "sql_alias").when(key == 1, "health_check").alias("noise"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    g = C.statistics(e, "user_id")
    return g.select("user_id", text("by_gap_type").alias("by_type"), text("by_severity").alias("by_severity"), text("by_noise").alias("by_noise"))


@query("""
WITH r AS (SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS missing, o_custkey % 6 AS a, o_custkey % 4 AS t, o_orderkey % 13 AS matched, 20 AS sources, 9 AS ua, o_custkey % 8 AS ut FROM orders),
s AS (SELECT id, CASE WHEN missing THEN matched ELSE a END AS a, CASE WHEN missing THEN 0 ELSE t END AS t, CASE WHEN missing THEN greatest(0, sources - matched) ELSE ua END AS ua, CASE WHEN missing THEN 0 ELSE ut END AS ut, CASE WHEN missing THEN 0 ELSE greatest(0, matched - a - t) END AS more FROM r),
q AS (SELECT *, CASE WHEN t = 0 THEN more ELSE CAST(floor(more * (a::DOUBLE / (a + t)) + 0.5) AS BIGINT) END AS ma FROM s)
SELECT id, a + ma AS api_matched, t + more - ma AS table_matched, greatest(0, ua - ma) AS api_unmatched, greatest(0, ut - (more - ma)) AS table_unmatched FROM q
""")
def agg_30_kpi_split(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = lambda kind: F.struct(F.struct(F.lit(kind).alias("type")).alias("sourceRef"))
    items = F.concat(F.array_repeat(item("api"), (c % 6).cast("int")), F.array_repeat(item("table"), (c % 4).cast("int")))
    json = F.to_json(F.struct(items.alias("matchedItems"), F.lit(9).alias("unmatchedSourceApis"), (c % 8).alias("unmatchedSourceTables")))
    r = table(spark, d, "orders").select(k.alias("id"), F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, "{not json").otherwise(json).alias("json"), (k % 13).alias("matched"), F.lit(20).cast("long").alias("sources"))
    return C.kpi_split(r)


@query("""
WITH r AS (SELECT p_type AS category, p_partkey, p_brand, p_size FROM part UNION ALL SELECT 'other', p_partkey, p_brand, p_size FROM part WHERE p_partkey < 2), t AS (SELECT category, p_brand, min(p_partkey) AS p FROM r GROUP BY 1, 2),
k AS (SELECT category, string_agg(p_brand, ',' ORDER BY p) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p) AS n FROM t) WHERE n <= 20 GROUP BY 1)
SELECT category, count(*) AS policies, tags, count(DISTINCT p_size) AS documents FROM r JOIN k USING (category) GROUP BY category, tags HAVING category <> 'other' OR count(*) >= 3
""")
def agg_34_bundles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    row = lambda df, c: df.select(c.alias("category"), F.col("p_partkey").alias("position"), F.array("p_brand").alias("tags"), F.col("p_size").alias("document"))
    return P.bundles(row(p, F.col("p_type")).unionByName(row(p.where("p_partkey < 2"), F.lit("other")))).withColumn("tags", F.array_join("tags", ","))


@query("""
SELECT s_nationkey AS org, count(*) AS skills, string_agg('a' || CAST(s_suppkey AS VARCHAR) || ',b', ',' ORDER BY s_suppkey) AS apis, string_agg(CASE WHEN s_suppkey % 2 = 0 THEN 't' || CAST(s_suppkey AS VARCHAR) END, ',' ORDER BY s_suppkey) AS tables FROM supplier GROUP BY 1
""")
def agg_35_merged_specs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    apis = F.array(F.concat(F.lit("a"), key), F.lit("b"))
    tables = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat(F.lit("t"), key))).otherwise(F.array().cast("array<string>"))
    g = P.merged_specs(table(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), F.col("s_suppkey").alias("position"), apis.alias("apis"), tables.alias("tables")), "org", ["apis", "tables"])
    join = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return g.select("org", "skills", join("apis"), join("tables"))


GROUPS = ("중도인출", "해지", "이전", "수급", "가입", "한도", "세액공제")


@query(f"""
WITH k AS (SELECT unnest({list(GROUPS)}) AS keyword), h AS (SELECT keyword, p_partkey, row_number() OVER (PARTITION BY keyword ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY keyword) AS c FROM k JOIN ({KOREAN_SQL}) ON contains(t, keyword))
SELECT keyword, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY n) AS policies FROM h WHERE n <= 5 AND c >= 2 GROUP BY 1
""")
def agg_36_keyword_groups(spark: SparkSession, d: str) -> DataFrame:
    k = korean(spark, d).select(F.col("p_partkey").alias("id"), F.col("t").alias("text"))
    return P.keyword_groups(k, GROUPS, 2, 5).select("keyword", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("policies"))


@query(f"""
SELECT area FROM (SELECT unnest(['중도인출', '해지', '이전', '수급', '가입']) AS area, unnest([['중도인출', '중도'], ['해지', '해약'], ['이전', '이관'], ['수급', '연금수령'], ['가입', '신규']]) AS words) WHERE NOT EXISTS (SELECT 1 FROM ({KOREAN_SQL}) WHERE len(list_filter(words, lambda w: contains(t, w))) > 0)
""")
def agg_37_uncovered_areas(spark: SparkSession, d: str) -> DataFrame:
    return P.uncovered_areas(korean(spark, d).select(F.col("t").alias("text")), P.AREAS)


@query("""
WITH r AS (SELECT p_brand AS domain, count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS applicable FROM part GROUP BY 1) SELECT domain, total, applicable, floor(applicable * 1000.0::DOUBLE / total + 0.5) / 10 AS coverage FROM r
""")
def agg_44_detector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return P.detector_coverage(table(spark, d, "part").select(F.col("p_brand").alias("domain"), (F.col("p_size") % 3 == 0).alias("supported")))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS org, s_suppkey % 3 AS loaded, s_suppkey % 7 AS domain FROM supplier), n AS (SELECT org, domain, count(*) AS c, min(s_suppkey) AS f FROM s GROUP BY 1, 2), t AS (SELECT org, domain FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY c DESC, f) AS k FROM n) WHERE k = 1)
SELECT org, count(*) AS skills, coalesce(sum(CASE WHEN loaded > 0 THEN s_suppkey % 101 END) / count(CASE WHEN loaded > 0 THEN 1 END)::DOUBLE / 100, 0) AS trust, count(*) FILTER (loaded > 0 AND s_suppkey % 2 = 0) AS mcp, count(*) FILTER (loaded > 0 AND s_suppkey % 5 = 0) AS openapi, t.domain AS domain FROM s JOIN t USING (org) GROUP BY org, t.domain
""")
def agg_46_organisation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("org"), k.alias("position"), (k % 7).alias("domain"), F.when(k % 3 > 0, k % 101).alias("trust"), ((k % 3 > 0) & (k % 2 == 0)).alias("mcp"), ((k % 3 > 0) & (k % 5 == 0)).alias("openapi"))
    return P.organisation(s)


@query("""
WITH q AS (SELECT l_orderkey, CASE min(l_returnflag) WHEN 'A' THEN 'insert' ELSE 'select' END AS kind, list_distinct(list(l_suppkey)) AS ts FROM lineitem GROUP BY 1), t AS (SELECT kind, len(ts) AS n, unnest(ts) AS t FROM q),
g AS (SELECT t, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) >= 3 AS INTEGER) + CAST(sum(CASE WHEN kind = 'insert' THEN 1 ELSE 0 END) >= 2 AS INTEGER) AS k FROM t GROUP BY 1) SELECT t AS "table", CASE WHEN k >= 2 THEN 'core' WHEN k = 0 THEN 'non-core' ELSE 'unknown' END AS relevance FROM g
""")
def mod_12_relevance(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.min("l_returnflag") == "A", "insert").otherwise("select").alias("kind"), F.collect_set("l_suppkey").alias("tables"))
    return G.table_relevance(q).select("table", "relevance")


@query("""
WITH c AS (SELECT l_orderkey AS t, l_linenumber AS c, CASE WHEN l_tax > 0.07 THEN '' ELSE l_returnflag END AS sql, l_discount > 0.08 AS pk, CASE l_linestatus WHEN 'O' THEN 'ddl' ELSE 'mybatis' END AS o, (l_partkey, l_suppkey, l_quantity) AS p FROM lineitem)
SELECT t AS "table", c AS "column", coalesce(min_by(sql, p) FILTER (sql <> ''), '') AS sql, bool_or(pk) AS "primary", CASE WHEN bool_or(o = 'ddl') THEN 'ddl' ELSE 'mybatis' END AS origin FROM c GROUP BY 1, 2
""")
def agg_32_merged_origin(spark: SparkSession, d: str) -> DataFrame:
    """With the origin: DDL goes first; blank types do not count."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("column"), F.when(F.col("l_tax") > 0.07, "").otherwise(F.col("l_returnflag")).alias("sql"), (F.col("l_discount") > 0.08).alias("primary"), F.when(F.col("l_linestatus") == "O", "ddl").otherwise("mybatis").alias("origin"), F.struct("l_partkey", "l_suppkey", "l_quantity").alias("position"))
    return G.merge_table_columns(c).withColumn("sql", F.coalesce("sql", F.lit("")))


@query("""
WITH p AS (SELECT l_partkey AS process, CAST(round(l_discount * 100) AS BIGINT) AS score, l_orderkey AS doc, CASE l_returnflag WHEN 'R' THEN 'mega' WHEN 'A' THEN 'core' ELSE 'supporting' END AS category FROM lineitem),
m AS (SELECT process, category FROM (SELECT process, category, row_number() OVER (PARTITION BY process ORDER BY count(*) DESC, min(doc), category) AS k FROM p GROUP BY 1, 2) WHERE k = 1)
SELECT process, floor(sum(score) / count(*)::DOUBLE + 0.5) / 100 AS score, m.category AS category, count(DISTINCT doc) AS documents, m.category IN ('mega', 'core') AS is_core FROM p JOIN m USING (process) GROUP BY process, m.category
""")
def agg_21_merged_processes(spark: SparkSession, d: str) -> DataFrame:
    """Processes over documents: mean score of whole hundredths, most frequent category, which decides what is core."""
    kind = F.when(F.col("l_returnflag") == "R", "mega").when(F.col("l_returnflag") == "A", "core").otherwise("supporting")
    p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("process"), F.round(F.col("l_discount") * 100).cast("long").alias("score"), F.col("l_orderkey").alias("doc"), kind.alias("category"))
    return P.merged_processes(p)


# ---- models


def extraction(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Conversations as extractions: processes, entities, rules and relations out of the first words of their turns.

    Every fourth turn names its process again with the words turned around; some rules have
    conditions in Hangul, and some processes are named so.
    """
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", ""), r"\s+").alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    named = c.where(F.size("w") > 9)
    name, turned = F.concat_ws(" ", word(0), word(1)), F.concat_ws("/", word(1), word(0))
    names = F.array_compact(F.array(name, F.when(F.col("turn") % 4 == 0, turned), F.when(F.col("turn") % 5 == 1, F.lit("중도 해지"))))
    processes = named.select("doc", F.posexplode(names).alias("i", "name"), (F.col("turn") * 4 + F.col("i")).alias("position"), F.concat_ws(" ", word(1), word(2)).alias("description"), F.slice("w", 3, 7).alias("steps")).drop("i")
    phrase = nth(("해지 신청 시 ", "연금 수급 때 ", "", "가입 후 "), F.col("doc") + F.col("turn"))
    rules = named.select("doc", F.col("turn").alias("position"), F.concat(phrase, F.concat_ws(" ", word(0), word(1), word(3))).alias("condition"), F.concat_ws(" ", word(4), word(1)).alias("outcome"))
    relations = named.select("doc", F.col("turn").alias("position"), F.when(F.col("turn") % 2 == 0, name).otherwise(word(6)).alias("src"), word(5).alias("dst"), nth(("uses", "owns"), F.col("turn")).alias("type"))
    return {"processes": processes, "entities": named.where("turn % 3 = 0").select("doc", word(5).alias("name")), "rules": rules, "relations": relations}


KEYWORDS = ("the", "de", "an", "er", "on")


@query()
def mod_01_importance(spark: SparkSession, d: str) -> DataFrame:
    x = extraction(spark, d)
    return D.process_importance(x["processes"], x["rules"], x["relations"], KEYWORDS)


@query()
def mod_02_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all four kinds, the weightiest first."""
    x = extraction(spark, d)
    return P.diagnosis(**x, importance=D.process_importance(x["processes"], x["rules"], x["relations"], KEYWORDS)).withColumn("related", F.array_join("related", "|"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 OR length(p_name) < 10 OR length(p_brand) < 10 OR length(p_type) < 10 THEN 'fail' ELSE 'pass' END AS verdict,
 array_to_string(list_filter([CASE WHEN length(p_name) < 10 THEN 'MECH_SHORT_CONDITION' END, CASE WHEN length(p_brand) < 10 THEN 'MECH_SHORT_CRITERIA' END, CASE WHEN length(p_type) < 10 THEN 'MECH_SHORT_OUTCOME' END, CASE WHEN p_partkey % 3 = 0 THEN 'MECH_INVALID_CODE' END], lambda x: x IS NOT NULL), ',') AS issues FROM part
""")
def mod_07_policy_checks(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 3 == 0, "POL-x").otherwise("POL-AB-CD-001")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), code.alias("code"), F.col("p_name").alias("condition"), F.col("p_brand").alias("criteria"), F.col("p_type").alias("outcome"), F.array("p_type").alias("tags"))
    return D.policy_checks(p).withColumn("issues", F.array_join("issues", ","))


def skill_packages(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as skills, the parts of lineitems they supplied as policies."""
    l = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct().join(table(spark, d, "part"), "p_partkey")
    k = F.col("p_partkey")
    policy = F.struct(
        F.when(k % 4 == 0, "x").otherwise(F.concat(F.lit("POL-"), F.when(k % 2 == 0, "A").otherwise("B"), F.lit("-AB-001"))).alias("code"), F.col("p_name").alias("title"), F.when(k % 5 == 0, F.repeat("p_name", 12)).alias("description"), F.concat("p_name", F.lit(" 금액 10% 이상")).alias("condition"),
        F.concat("p_brand", F.lit(" 응답시간")).alias("criteria"), F.concat("p_type", F.when(k % 3 == 0, " GET /api/x").otherwise("")).alias("outcome"), F.when(k % 2 == 0, F.col("p_brand")).alias("excerpt"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("document"), F.array("p_type").alias("tags"),
    )
    g = l.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct(k, policy.alias("p")))).alias("ps"))
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    j = s.join(g, key == F.col("l_suppkey"), "left")
    policies = F.slice(F.transform(F.coalesce("ps", F.expr("slice(ps, 1, 0)")), lambda x: x["p"]), F.lit(1), F.when(key % 9 == 0, 0).otherwise(F.coalesce(F.size("ps"), F.lit(0))))  # every ninth has none
    level = nth(("unreviewed", "reviewed", "validated"), key)
    return j.select(
        key.alias("key"), F.when(key % 2 == 0, "https://x").otherwise("http://x").alias("schema_uri"), (key % 3 != 0).alias("valid"), (key % 4).alias("term_uris"), F.when(key % 5 > 1, "s").alias("skos"), policies.alias("policies"), F.when(key % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d0"), F.lit("d1"))).alias("sources"),
        (key % 5).alias("stages"), level.alias("level"), (key % 2 / 2.0).alias("trust"), F.when(key % 7 > 0, "me").alias("author"), (key % 3).alias("apis"), F.when(key % 3 == 0, 0).otherwise(key % 4).alias("tables"), F.lit(0).alias("flows"), F.lit(0).alias("errors"), (key % 8 == 0).alias("mcp"), (key % 9 == 0).alias("openapi"),
    )


@query()
def mod_10_criteria(spark: SparkSession, d: str) -> DataFrame:
    return K.readiness(skill_packages(spark, d), ("ring", "widget"), D.READINESS)


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey <> o_orderkey), n AS (SELECT src AS k FROM e UNION SELECT dst FROM e)
SELECT k AS node, coalesce(a.n, 0) AS needs, a.l AS first_needs, coalesce(b.n, 0) AS needed_by FROM n LEFT JOIN (SELECT src, count(*) AS n, min(dst) AS l FROM e GROUP BY 1) a ON a.src = k LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) b ON b.dst = k
""")
def mod_23_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What each node needs, and what needs it: whole ids of customers and orders as nodes of one graph."""
    from ..operators import graph as N

    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).where("src <> dst")
    return N.dependency_list(e)


@query()
def mod_23_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on or before a cycle, over all orders and whole ids."""
    from ..operators import graph as N

    return N.cyclic_nodes(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).where("src <> dst"))


@query()
def mod_23_witness_cycles(spark: SparkSession, d: str) -> DataFrame:
    """A cycle for each part of the orders' graph that has one, edge by edge."""
    from ..operators import graph as N

    return N.witness_cycles(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).where("src <> dst"))


@query("""
WITH p AS (SELECT 'd' || p_brand AS doc, 'P' || p_name AS proc, p_type, p_size, p_partkey FROM part)
SELECT label, count(*) AS n FROM (SELECT DISTINCT 'Document' AS label, doc AS key FROM p UNION SELECT DISTINCT 'Process', proc FROM p UNION SELECT DISTINCT 'SubProcess', 'S' || CAST(p_size AS VARCHAR) FROM p WHERE p_size % 2 = 0 UNION SELECT DISTINCT 'Method', 'M' || CAST(p_size AS VARCHAR) FROM p
 UNION SELECT DISTINCT 'Entity', 'E' || p_type FROM p UNION SELECT DISTINCT 'Actor', 'A' || p_type FROM p WHERE p_size % 3 = 0 UNION SELECT DISTINCT 'Condition', 'C' || CAST(p_partkey AS VARCHAR) FROM p UNION SELECT DISTINCT 'Requirement', 'R' || CAST(p_partkey // 2 AS VARCHAR) FROM p) GROUP BY 1
""")
def grf_07_analysis_graph(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import graph as N

    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    lit = lambda a, c: F.concat(F.lit(a), c)
    e = table(spark, d, "part").select(
        lit("d", F.col("p_brand")).alias("document"),
        F.array(F.struct(lit("P", F.col("p_name")).alias("name"), F.array(lit("M", size)).alias("steps"), F.when(F.col("p_size") % 2 == 0, F.array(lit("S", size))).otherwise(F.array().cast("array<string>")).alias("parts"))).alias("processes"),
        F.array(F.struct(lit("E", F.col("p_type")).alias("name"))).alias("entities"),
        F.array(F.struct(lit("C", key.cast("string")).alias("condition"), F.lit("o").alias("outcome"))).alias("rules"),
        F.when(F.col("p_size") % 3 == 0, F.array(lit("A", F.col("p_type")))).otherwise(F.array().cast("array<string>")).alias("actors"),
        F.array(lit("R", F.expr("p_partkey div 2").cast("string"))).alias("requirements"),
    )
    return N.analysis_graph(e)[0].groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY event_id) AS n FROM (SELECT event_id, CASE WHEN value >= 80 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events)) SELECT event_id, severity FROM x WHERE n <= 10")
def srt_07_samples_by_severity(spark: SparkSession, d: str) -> DataFrame:
    """First ten of each severity."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", F.when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 40, "MEDIUM").otherwise("LOW").alias("severity"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy(severity.severity_rank(F.col("severity")), "severity").orderBy("event_id"))).where("n <= 10").drop("n")


@query("""
WITH e AS (SELECT l_orderkey AS src, l_suppkey AS dst, l_linenumber * 1000000 + l_partkey AS version, l_returnflag AS type, l_quantity AS weight FROM lineitem)
SELECT src, dst, type, max_by(weight, (version, weight)) AS weight FROM e GROUP BY 1, 2, 3
""")
def snk_10_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges merged by their ends and type; the last written properties count."""
    from ..operators import graph as N

    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), F.struct(F.col("l_linenumber") * 1000000 + F.col("l_partkey"), "l_quantity").alias("version"))
    return N.merge_nodes(e.where("weight <= 25"), e.where("weight > 25"), ["src", "dst", "type"]).select("src", "dst", "type", "weight")
