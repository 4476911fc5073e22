"""Scalar functions and rule tables applied to the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, severity
from ..functions import text as T
from .registry import query, table

SNAKE = "regexp_replace(p_name, ' ', '_')"


def names(spark: SparkSession, d: str) -> DataFrame:
    """Parts as named things: snake, camel and class names made of the words."""
    words = F.split("p_name", " ")
    camel = F.concat(words[0], F.initcap(words[1]))
    return table(spark, d, "part").select("p_partkey", F.concat_ws("_", words).alias("snake"), camel.alias("camel"), F.concat(F.lit("com.shop."), F.initcap(words[0]), F.lit("_"), F.initcap(words[1]), F.lit("Service")).alias("cls"), "p_size", "p_brand")


NAMES_SQL = """SELECT p_partkey, replace(p_name, ' ', '_') AS snake, w[1] || upper(w[2][1:1]) || w[2][2:] AS camel,
 'com.shop.' || upper(w[1][1:1]) || w[1][2:] || '_' || upper(w[2][1:1]) || w[2][2:] || 'Service' AS cls, p_size, p_brand FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)"""


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://[^/]+', ''), '^/+|/+$', '', 'g'),
  '/v(\d+\.\d+)(/|$)', '/\1\2', 'g'), '\{[^}]+\}', ':param', 'g'), ':[A-Za-z0-9_]+', ':param', 'g'), '/+', '/', 'g') AS path FROM pages
""")
def scl_01_normalize_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.normalize_path(F.col("url")).alias("path"))


@query(r"SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '\{([^}]+)\}', ':\1', 'g'), '/+$', '') AS p FROM pages)")
def scl_02_normalize_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.normalize_endpoint(F.col("url")).alias("path"))


@query(r"""
SELECT page_id, array_to_string(s[greatest(1, len(s) - 1):], '/') AS resource FROM (SELECT page_id, list_filter(string_split(regexp_replace(lower(url), '^https?://[^/]+', ''), '/'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(api|rest|v\d+|v?\d+\.\d+|internal|external)$') AND NOT regexp_matches(x, '^\{.*\}$') AND NOT starts_with(x, ':')) AS s FROM pages)
""")
def scl_03_resource_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.resource_path(F.col("url")).alias("resource"))


@query(rf"""
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(camel, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' '), lambda t: lower(t)),
  lambda t: length(t) > 1), ',') AS tokens FROM ({NAMES_SQL})
""")
def scl_04_path_tokens(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", F.array_join(T.path_tokens(F.col("camel")), ",").alias("tokens"))


@query(f"SELECT p_partkey, regexp_replace(lower('TB_' || snake), '^(tb_|t_|tbl_)', '') AS name FROM ({NAMES_SQL})")
def scl_05_normalize_table(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", T.normalize_table(F.concat(F.lit("TB_"), "snake")).alias("name"))


@query(rf"SELECT p_partkey, lower(regexp_replace(camel, '([a-z])([A-Z])', '\1_\2', 'g')) AS snake, true AS same FROM ({NAMES_SQL})")
def scl_06_camel_to_snake(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", T.camel_to_snake(F.col("camel")).alias("snake"), T.same_column(F.col("camel"), F.col("snake")).alias("same"))


@query("""
WITH a AS (SELECT conv_id, list_distinct(list(role)) AS r FROM conversations WHERE turn < 2 GROUP BY 1), b AS (SELECT conv_id, list_distinct(list(role)) AS r FROM conversations WHERE turn >= 2 GROUP BY 1)
SELECT a.conv_id, len(list_intersect(a.r, b.r))::DOUBLE / len(list_distinct(list_concat(a.r, b.r))) AS score FROM a JOIN b USING (conv_id)
""")
def scl_07_jaccard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") < 2, F.col("role"))).alias("a"), F.collect_set(F.when(F.col("turn") >= 2, F.col("role"))).alias("b"))
    return g.where((F.size("a") > 0) & (F.size("b") > 0)).select("conv_id", T.jaccard(F.col("a"), F.col("b")).alias("score"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS INTEGER) AS edits FROM part")
def scl_08_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_brand").alias("edits"))


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, ['MID','MC','TM','PM','SM'][CAST(l_linenumber % 5 AS INTEGER) + 1] AS kind, l_returnflag = 'R' AS pk, l_linestatus = 'O' AS req FROM lineitem)
SELECT kind, pk, req, count(*) AS n, CASE kind WHEN 'MID' THEN CASE WHEN pk OR req THEN 'HIGH' ELSE 'LOW' END WHEN 'MC' THEN CASE WHEN pk OR req THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN 'TM' THEN 'HIGH' WHEN 'PM' THEN CASE WHEN req THEN 'HIGH' ELSE 'MEDIUM' END ELSE CASE WHEN pk THEN 'HIGH' WHEN req THEN 'MEDIUM' ELSE 'LOW' END END AS severity
FROM k GROUP BY 1, 2, 3
""")
def scl_10_gap_severity(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("MID", "MC", "TM", "PM", "SM"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    k = table(spark, d, "lineitem").select(kind.alias("kind"), (F.col("l_returnflag") == "R").alias("pk"), (F.col("l_linestatus") == "O").alias("req"))
    return k.groupBy("kind", "pk", "req").agg(F.count("*").alias("n")).withColumn("severity", severity.gap_severity(F.col("kind"), F.col("pk"), F.col("req"), F.col("req")))


@query(f"SELECT p_partkey, replace(lower(regexp_replace(regexp_replace(cls, '^.*\\.', ''), '(?i)(Controller|Service|Impl|VO|DTO|Mapper|Repository|Dao)$', '')), '_', '') AS stem FROM ({NAMES_SQL})")
def scl_11_class_stem(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", T.class_stem(F.col("cls")).alias("stem"))


@query(r"SELECT item_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS name FROM benchmark")
def scl_12_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.collapsed(F.col("text")).alias("name"))


@query(f"SELECT p_partkey, '/shop/v1.2/' || snake || '/list' AS full_path, '/' || snake || '/list' AS short_path FROM ({NAMES_SQL})")
def scl_13_paths(spark: SparkSession, d: str) -> DataFrame:
    full = T.combine_path(F.concat(F.lit("shop/v1.2/"), "snake", F.lit("/")), F.lit("/list"))
    return names(spark, d).select("p_partkey", full.alias("full_path"), T.strip_app_prefix(full).alias("short_path"))


@query(f"""
SELECT p_partkey, '/shop/v1.2/' || snake || '/list|/' || snake || '|/' || snake || '/list' AS paths FROM ({NAMES_SQL})
""")
def scl_14_alternative_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/shop/v1.2/"), "snake")
    return names(spark, d).select("p_partkey", F.array_join(T.alternative_paths(path, F.lit("list"), path), "|").alias("paths"))


@query("""
SELECT o_orderkey, floor(greatest(0.0, least(1.0, (CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END)::DOUBLE - 0.15::DOUBLE * h - 0.05::DOUBLE * m)) * 100 + 0.5) / 100 AS confidence
FROM orders JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS h, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def scl_16_spec_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = lambda f: F.sum(F.when(F.col("l_returnflag") == f, 1).otherwise(0))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n("R").alias("h"), n("A").alias("m"))
    return table(spark, d, "orders").join(g, "o_orderkey").select("o_orderkey", T.spec_confidence(F.col("h"), F.col("m"), F.col("o_orderstatus") == "F").alias("confidence"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scl_18_safe_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json(T.strip_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k bigint")["k"].alias("k"))


@query("""
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, least(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / 10.0::DOUBLE, 1.0) * 0.35::DOUBLE + least(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / 15.0::DOUBLE, 1.0) * 0.25::DOUBLE
  + least(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / 25.0::DOUBLE, 1.0) * 0.25::DOUBLE + least(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) / 15.0::DOUBLE, 1.0) * 0.15::DOUBLE AS s FROM events GROUP BY 1, 2)
SELECT user_id, day, floor(s * 10000 + 0.5) / 10000 AS score, CASE WHEN s >= 0.6 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS rank FROM g
""")
def scl_19_triage(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0))
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(n("click").alias("a"), n("view").alias("b"), n("error").alias("c"), n("signup").alias("e"))
    s = T.triage_score(F.col("a"), F.col("b"), F.col("c"), F.col("e"))
    return g.select("user_id", "day", T.rounded(s, 4).alias("score"), T.triage_rank(s).alias("rank"))


@query("SELECT doc_id, floor((CASE WHEN n_chars >= 200 THEN 1.0 WHEN n_chars >= 50 THEN 0.7::DOUBLE + 0.3::DOUBLE * (n_chars - 50) / 150 ELSE 0.5::DOUBLE + 0.2::DOUBLE * n_chars / 50 END) * 1000 + 0.5) / 1000 AS factor FROM documents")
def scl_21_quality_factor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.rounded(T.quality_factor(F.col("n_chars")), 3).alias("factor"))


@query("SELECT doc_id, CAST(n_chars // 60 AS VARCHAR) || '분 ' || CAST(n_chars % 60 AS VARCHAR) || '초' AS label FROM documents")
def scl_22_duration_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.duration_label(F.col("n_chars").cast("double")).alias("label"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\b\d{6}-\d{7}\b', '[SSN]', 'g'), '\b01[016789]-\d{3,4}-\d{4}\b', '[PHONE]', 'g'),
  '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g'), '\b[A-Z]{2,4}-\d{4,8}\b', '[EMPID]', 'g')) AS masked FROM documents
""")
def scl_23_pii_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.mask_pii(F.coalesce("text", F.lit(""))).cast("binary")).alias("masked"))


@query(r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS words FROM conversations")
def scl_24_word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("words"))


POLICIES_SQL = "SELECT p_partkey, 'POL-' || upper(split_part(p_name, ' ', 1)) || '-' || p_type || '-' || lpad(CAST(p_size AS VARCHAR), CASE WHEN p_size % 7 = 0 THEN 2 ELSE 3 END, '0') AS code FROM part"


@query(rf"SELECT p_partkey, regexp_matches(code, '^POL-[A-Z]+-[A-Z-]+-\d{{3}}$') AS valid, regexp_extract(code, '^POL-([A-Z]+)-', 1) AS domain FROM ({POLICIES_SQL})")
def scl_25_policy_code(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") % 7 == 0, F.lpad(F.col("p_size").cast("string"), 2, "0")).otherwise(F.lpad(F.col("p_size").cast("string"), 3, "0"))
    code = F.concat(F.lit("POL-"), F.upper(F.split("p_name", " ")[0]), F.lit("-"), "p_type", F.lit("-"), size)
    return table(spark, d, "part").select("p_partkey", code.rlike(r"^POL-[A-Z]+-[A-Z-]+-\d{3}$").alias("valid"), F.regexp_extract(code, "^POL-([A-Z]+)-", 1).alias("domain"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(v, '[,"\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ', "' || p_brand || '"' ELSE p_name END AS v FROM part)""")
def snk_11_csv_cells(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.csv_cell(v).alias("cell"))


@query("""
SELECT p_partkey, CASE WHEN lower(nm) IN ('dual','sysibm','information_schema','all_tables','user_tables') THEN 'system_table' WHEN regexp_matches(nm, '^[a-zA-Z]$') THEN 'sql_alias'
  WHEN lower(nm) IN ('set','select','from','where','insert','update','delete','values','into','table','create','alter','drop','index') THEN 'sql_keyword'
  WHEN regexp_matches(nm, '^[a-z]+[A-Z]') AND n = 0 THEN 'variable_name' END AS noise
FROM (SELECT p_partkey, p_size % 2 AS n, CASE p_partkey % 5 WHEN 0 THEN 'DUAL' WHEN 1 THEN 't' WHEN 2 THEN 'Index' WHEN 3 THEN split_part(p_name, ' ', 1) || 'No' ELSE p_name END AS nm FROM part)
""")
def flt_08_noise_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "DUAL").when(k == 1, "t").when(k == 2, "Index").when(k == 3, F.concat(F.split("p_name", " ")[0], F.lit("No"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", rules.table_noise(name, F.col("p_size") % 2).alias("noise"))


@query("""
WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), s AS (SELECT doc_id, CASE WHEN regexp_matches(t, '\\berd\\b') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'entity') THEN 1 ELSE 0 END AS erd,
 CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])ui($|[^a-z0-9_])') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])ux($|[^a-z0-9_])') THEN 1 ELSE 0 END AS screen,
 CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])api($|[^a-z0-9_])') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'endpoint') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'swagger') THEN 1 ELSE 0 END AS api,
 CASE WHEN contains(t, 'requirement') THEN 1 ELSE 0 END AS req FROM x)
SELECT doc_id, CASE WHEN greatest(erd, screen, api, req) = 0 THEN 'general' WHEN erd = greatest(erd, screen, api, req) THEN 'erd' WHEN screen = greatest(erd, screen, api, req) THEN 'screen_design' WHEN api = greatest(erd, screen, api, req) THEN 'api_spec' ELSE 'requirements' END AS class FROM s
""")
def mod_03_document_class(spark: SparkSession, d: str) -> DataFrame:
    name, _ = rules.document_class(F.coalesce("text", F.lit("")), F.lit("pdf"))
    return table(spark, d, "documents").select("doc_id", name.alias("class"))


@query(r"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, least(1.0, (CASE WHEN contains(lower(t), 'purpose') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'objective') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'goal') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'overview') THEN 1 ELSE 0 END) / 5.0::DOUBLE) AS goal,
 least(1.0, (len(regexp_extract_all(t, '(?i)\bif\b')) + len(regexp_extract_all(t, '(?i)\bwhen\b'))) / 8.0::DOUBLE) AS constraint_, least(1.0, len(regexp_extract_all(t, '\d+\s*(%)')) / 5.0::DOUBLE) AS criteria FROM c)
SELECT doc_id, floor((1 - (goal * 0.4::DOUBLE + constraint_ * 0.3::DOUBLE + criteria * 0.3::DOUBLE)) * 10000 + 0.5) / 10000 AS ambiguity FROM m
""")
def mod_06_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.ambiguity(F.coalesce("text", F.lit("")))["ambiguity"].alias("ambiguity"))


@query("""
SELECT user_id, s, CASE WHEN s < 0.5 THEN 'fail' WHEN s < 0.7 THEN 'review' ELSE 'pass' END AS verdict FROM (
 SELECT user_id, floor((least(1.0, avg(CASE WHEN event_type = 'view' THEN value END) / 60) * 0.25::DOUBLE + least(1.0, avg(CASE WHEN event_type = 'click' THEN value END) / 60) * 0.25::DOUBLE
  + least(1.0, avg(CASE WHEN event_type = 'error' THEN value END) / 60) * 0.2::DOUBLE + least(1.0, avg(CASE WHEN event_type = 'signup' THEN value END) / 60) * 0.2::DOUBLE + least(1.0, avg(CASE WHEN event_type = 'purchase' THEN value END) / 60) * 0.1::DOUBLE) * 1000 + 0.5) / 1000 AS s FROM events GROUP BY 1)
""")
def mod_08_weighted_verdict(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k, w: F.least(F.lit(1.0), F.avg(F.when(F.col("event_type") == k, F.col("value"))) / 60) * w
    s = part("view", 0.25) + part("click", 0.25) + part("error", 0.2) + part("signup", 0.2) + part("purchase", 0.1)
    g = table(spark, d, "events").groupBy("user_id").agg(T.rounded(s, 3).alias("s"))
    return g.withColumn("verdict", F.when(F.col("s") < 0.5, "fail").when(F.col("s") < 0.7, "review").otherwise("pass"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(n, '(?i)charg') THEN 'charge' WHEN regexp_matches(n, '(?i)cpn_|gift|coupon|voucher') THEN 'gift' WHEN regexp_matches(n, '(?i)pay|approval') THEN 'payment' WHEN regexp_matches(n, '(?i)wallet|balance') THEN 'wallet'
  WHEN regexp_matches(n, '(?i)event|notice') THEN 'common' WHEN regexp_matches(n, '(?i)card|account') THEN 'data' ELSE 'unknown' END AS domain
FROM (SELECT p_partkey, ['tb_charge','cpn_mst','pay_log','tb_wallet','event_hist','card_info','zzz'][CAST(p_partkey % 7 AS INTEGER) + 1] || '_' || CAST(p_size AS VARCHAR) AS n FROM part)
""")
def mod_13_gap_domain(spark: SparkSession, d: str) -> DataFrame:
    base = F.element_at(F.array(*map(F.lit, ("tb_charge", "cpn_mst", "pay_log", "tb_wallet", "event_hist", "card_info", "zzz"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.concat_ws("_", base, F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", rules.gap_domain(F.lit(""), F.lit(""), name).alias("domain"))
