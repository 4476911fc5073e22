"""Rules of specifications, source files and skills over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, severity
from ..functions import specs as S
from ..functions import text as T
from ..operators import skills as K
from .registry import query, table


def nth(values: tuple[str, ...], at: Column) -> Column:
    """The value at ``at`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def nth_sql(values: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(({at}) % {len(values)} AS INTEGER) + 1]"


# ---- endpoints of pages

ENDINGS = ("", "/test", "/example/a", "/metrics/b", "/error", "/health", "/debugger", "/internal/w", "/rsa/key", "", "/actuator", "/getIPAddr")
CONTROLLERS = ("OrderController", "HealthCheckController", "PayController", "SandboxController", "GiftController")
PATHS_SQL = f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/' WHEN page_id % 7 = 1 THEN p || p ELSE p || {nth_sql(ENDINGS, "page_id")} END AS path, {nth_sql(CONTROLLERS, "page_id")} AS controller
 FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages)"""


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the pages, some doubled, some of them the root, most with an ending."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("p"))
    path = F.when(F.col("page_id") % 7 == 0, "/").when(F.col("page_id") % 7 == 1, F.concat("p", "p")).otherwise(F.concat("p", nth(ENDINGS, F.col("page_id"))))
    return p.select("page_id", path.alias("path"), nth(CONTROLLERS, F.col("page_id")).alias("controller"))


@query(rf"""
SELECT page_id, path, CASE WHEN lower(controller) IN ('exceptionhandlingcontroller', 'healthcheckcontroller', 'sandboxcontroller', 'examplecontroller') THEN 'noise_controller'
 WHEN regexp_matches(path, '(?i)/test($|/)') THEN 'test_endpoint' WHEN regexp_matches(path, '(?i)/example/') THEN 'example_endpoint' WHEN regexp_matches(path, '(?i)/metrics/') THEN 'metrics_endpoint'
 WHEN regexp_matches(path, '(?i)/error$') THEN 'error_handler' WHEN regexp_matches(path, '(?i)/health') THEN 'health_check' WHEN regexp_matches(path, '(?i)/debug') THEN 'debug_endpoint'
 WHEN regexp_matches(path, '(?i)/internal/') THEN 'internal_endpoint' WHEN regexp_matches(path, '(?i)/getCSRFToken$') THEN 'utility_endpoint' WHEN regexp_matches(path, '(?i)/rsa/') THEN 'utility_endpoint'
 WHEN regexp_matches(path, '(?i)/getIPAddr$') THEN 'utility_endpoint' WHEN regexp_matches(path, '(?i)/raon/') THEN 'security_utility' WHEN len(s) >= 4 AND s[1:len(s) // 2] = s[len(s) // 2 + 1:] THEN 'duplicate_path' END AS noise
FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM ({PATHS_SQL}))
""")
def flt_09_noise_api(spark: SparkSession, d: str) -> DataFrame:
    return endpoints(spark, d).select("page_id", "path", rules.api_noise(F.col("path"), F.col("controller")).alias("noise"))


@query(rf"""
SELECT page_id, regexp_matches(lower(path), '/internal/|/health|/debug|/test') AS internal, NOT regexp_matches(lower(path), '/internal/|/health|/debug|/test|/actuator') AS external_ FROM ({PATHS_SQL})
""")
def flt_10_internal_api(spark: SparkSession, d: str) -> DataFrame:
    return endpoints(spark, d).select("page_id", rules.is_internal(F.col("path")).alias("internal"), rules.is_external(F.col("path")).alias("external_"))


NOTES = ("@RequestParam", "@RequestHeader", "@PathVariable", "@RequestBody", "", "@ModelAttribute")
JAVA = ("String", "Integer?", "Long", "Boolean", "BigDecimal", "LocalDate", "List<String>", "char", "double", "OrderVO", "LocalDateTime", "byte[]")
PARAMS_SQL = f"""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Auth' ELSE split_part(p_name, ' ', 2) END AS name, {nth_sql(JAVA, "p_partkey // 11")} AS type, {nth_sql(NOTES, "p_size")} AS note,
 '/' || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 5 = 0 THEN '/{{' || split_part(p_name, ' ', 2) || '}}' ELSE '' END AS path FROM part"""


def params(spark: SparkSession, d: str) -> DataFrame:
    """Parts as parameters of endpoints: name, Java type, annotation and path."""
    second, key = F.split("p_name", " ")[1], F.col("p_partkey")
    path = F.concat(F.lit("/"), F.split("p_name", " ")[0], F.when(key % 5 == 0, F.concat(F.lit("/{"), second, F.lit("}"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.when(key % 11 == 0, "Auth").otherwise(second).alias("name"), nth(JAVA, F.floor(key / 11)).alias("type"), nth(NOTES, F.col("p_size")).alias("note"), path.alias("path"))


@query(f"SELECT p_partkey, contains(lower(note), 'requestheader') OR (name = 'Auth' AND type = 'String') OR contains(lower(note), 'pathvariable') OR contains(path, '{{' || name || '}}') AS skipped FROM ({PARAMS_SQL})")
def flt_11_skipped_parameter(spark: SparkSession, d: str) -> DataFrame:
    return params(spark, d).select("p_partkey", rules.skip_parameter(F.col("name"), F.col("type"), F.col("note"), F.col("path")).alias("skipped"))


@query(f"SELECT page_id, path FROM ({PATHS_SQL}) WHERE regexp_replace(path, '^[/ ]+|[/ ]+$', '', 'g') <> ''")
def flt_12_root_path(spark: SparkSession, d: str) -> DataFrame:
    return endpoints(spark, d).where(F.regexp_replace("path", r"^[/ ]+|[/ ]+$", "") != "").select("page_id", "path")


SQL_TYPES = ("VARCHAR(100)", "NUMBER", "CHAR(1)", "DECIMAL(10,2)", "DATE", "LIST", "BIGINT", "TIMESTAMP", "TINYINT?", "BLOB", "varchar(20)", "INT4", "CLOB")
FITS_SQL = " OR ".join(f"(j = '{k.lower()}' AND s IN ({', '.join(repr(v) for v in vs)}))" for k, vs in severity.SQL_TYPES.items())
TYPED_SQL = f"""SELECT *, upper(j) = s OR {FITS_SQL} AS fits FROM (SELECT *, lower(regexp_replace(regexp_replace(java, '\\?$', ''), '<.*>$', '')) AS j, CASE WHEN upper(regexp_replace(sql, '\\?$', '')) = 'CHAR(1)' THEN 'CHAR(1)' ELSE regexp_replace(upper(regexp_replace(sql, '\\?$', '')), '\\(.*\\)$', '') END AS s
 FROM (SELECT p_partkey, {nth_sql(JAVA, "p_partkey")} AS java, {nth_sql(SQL_TYPES, "p_partkey // 12")} AS sql FROM part))"""


def typed(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", nth(JAVA, key).alias("java"), nth(SQL_TYPES, F.floor(key / 12)).alias("sql"))


@query(f"SELECT p_partkey, java, sql, fits FROM ({TYPED_SQL})")
def scl_09_type_compatibility(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).withColumn("fits", severity.type_compatible(F.col("java"), F.col("sql")))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'HIGH' WHEN fits THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM ({TYPED_SQL})")
def scl_10_type_mismatch_severity(spark: SparkSession, d: str) -> DataFrame:
    """The TM branch: a wrong type of a key, or one that cannot hold the value, weighs more."""
    none = F.lit(None).cast("boolean")
    return typed(spark, d).select("p_partkey", severity.gap_severity(F.lit("TM"), F.col("p_partkey") % 17 == 0, none, none, F.col("java"), F.col("sql")).alias("severity"))


@query(f"""
SELECT p_partkey, CASE WHEN contains(lower(note), 'path') THEN 'path' WHEN contains(lower(note), 'body') THEN 'body' WHEN contains(lower(note), 'header') THEN 'header' ELSE 'query' END AS source_,
 CASE WHEN contains(lower(type), 'string') OR type = 'char' THEN 'string' WHEN regexp_matches(lower(type), 'int|long|short') THEN 'integer' WHEN regexp_matches(lower(type), 'double|float|decimal|number') THEN 'number'
  WHEN contains(lower(type), 'bool') THEN 'boolean' WHEN regexp_matches(lower(type), 'list|array|set') THEN 'array' ELSE 'object' END AS json FROM ({PARAMS_SQL})
""")
def scl_15_parameter_source(spark: SparkSession, d: str) -> DataFrame:
    return params(spark, d).select("p_partkey", S.parameter_source(F.col("note")).alias("source_"), S.json_type(F.col("type")).alias("json"))


@query()
def scl_17_repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs - fenced JSON of each conversation turn, cut off at some place - as valid JSON again."""
    turn = F.to_json(F.struct("role", F.array("text", "role").alias("parts"), F.struct("conv_id", "turn").alias("at")))
    whole = F.concat(F.lit("```json\n"), turn)
    cut = F.substring(whole, F.lit(1), F.greatest(F.lit(12), F.length(whole) - (F.col("conv_id") % 60).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", S.repaired_json(cut).alias("json"))


@query("""
SELECT event_id, try_cast(json_extract_string(CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END, '$.k') AS INTEGER) AS k, event_id % 3 = 0 AS broken FROM events
""")
def scl_18_malformed_json(spark: SparkSession, d: str) -> DataFrame:
    """A third of the JSON is cut off: it parses to null, never to an error."""
    raw = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 2)")).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k int, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return table(spark, d, "events").select("event_id", parsed.alias("j")).select("event_id", F.when(F.col("j._corrupt").isNull(), F.col("j.k")).alias("k"), F.col("j._corrupt").isNotNull().alias("broken"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey % 3 AS c, o_custkey % 2 AS m, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_custkey % 101) / 100.0::DOUBLE END AS rate, o_orderkey % 5 AS o, o_orderkey % 7 = 0 AS capped FROM orders)
SELECT o_orderkey, c + m = 0 AS library, CASE WHEN NOT capped AND o = 0 AND coalesce(rate, 1) >= 0.95 THEN NULL WHEN capped OR coalesce(rate, 1) < 0.5 THEN 'HIGH' WHEN coalesce(rate, 1) < 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CAST(capped AS INTEGER) + CAST(o > 0 AS INTEGER) + CAST(coalesce(rate, 1) < 0.95 AS INTEGER) AS reasons FROM s
""")
def scl_20_extraction_flags(spark: SparkSession, d: str) -> DataFrame:
    key, rate = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_custkey") % 101) / 100.0)
    level, reasons = S.partial_extraction(rate, key % 5, key % 7 == 0)
    return table(spark, d, "orders").select("o_orderkey", S.library_only(key % 3, F.col("o_custkey") % 2, F.lit(0), F.lit(0)).alias("library"), level.alias("severity"), reasons.alias("reasons"))


# ---- Hangul texts of parts

WORDS = ("고객 정보 확인", "중도인출 한도 초과 시", "해지 요청 경우", "충전 금액 10 TPS 처리", "응답시간 300 ms 이내", "가용성 99 퍼센트 이상", "가입 기준 필요", "이전 수량 점수", "암호화 저장 후", "비율 계산")
KOREAN_SQL = f"SELECT p_partkey, {nth_sql(WORDS, 'p_partkey')} || ' ' || {nth_sql(WORDS, 'p_partkey // 10')} || ' ' || {nth_sql(WORDS, 'p_size')} AS t FROM part"


def korean(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", nth(WORDS, key), nth(WORDS, F.floor(key / 10)), nth(WORDS, F.col("p_size"))).alias("t"))


STOPS_SQL = ", ".join(f"'{w}'" for w in T.TERM_STOPWORDS)


@query(f"""
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10], '|') AS terms FROM (SELECT p_partkey, list_filter(regexp_extract_all(t, '[가-힣]{{2,}}(?:\\s[가-힣]{{2,}})?'), lambda x: x NOT IN ({STOPS_SQL})) AS l FROM ({KOREAN_SQL}))
""")
def scl_26_terms(spark: SparkSession, d: str) -> DataFrame:
    return korean(spark, d).select("p_partkey", F.array_join(T.terms(F.col("t")), "|").alias("terms"))


PHRASES_SQL = ", ".join("regexp_extract_all(t, '" + p + "')" for p in T.PERFORMANCE)


@query(f"""
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS phrases FROM (SELECT p_partkey, list_transform(flatten([{PHRASES_SQL}]), lambda x: trim(x)) AS l FROM ({KOREAN_SQL}))
""")
def scl_27_performance_phrases(spark: SparkSession, d: str) -> DataFrame:
    return korean(spark, d).select("p_partkey", F.array_join(T.performance_phrases(F.col("t")), "|").alias("phrases"))


@query(f"SELECT p_partkey, trim(substring(t, greatest(1, instr(t, '암호화') - 30), instr(t, '암호화') + 53 - greatest(1, instr(t, '암호화') - 30))) AS context FROM ({KOREAN_SQL}) WHERE instr(t, '암호화') > 0")
def scl_28_keyword_context(spark: SparkSession, d: str) -> DataFrame:
    return korean(spark, d).select("p_partkey", T.keyword_context(F.col("t"), "암호화").alias("context")).where("context is not null")


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(t, '금액|수량|건수|횟수') THEN 'INTEGER' WHEN regexp_matches(t, '비율|점수|확률') THEN 'REAL' ELSE 'TEXT' END AS type FROM ({KOREAN_SQL})")
def scl_29_column_type(spark: SparkSession, d: str) -> DataFrame:
    return korean(spark, d).select("p_partkey", S.column_type(F.col("t")).alias("type"))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || chr(10) || chr(10) || '... [truncated ' || CAST(length(text) - 500 AS VARCHAR) || ' chars to fit context]' ELSE text END AS t, length(text) AS n FROM conversations),
s AS (SELECT conv_id, sum(n) AS before, sum(length(t)) AS after FROM c GROUP BY 1), r AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c)
SELECT r.conv_id, turn, md5(t) AS digest FROM r JOIN s ON s.conv_id = r.conv_id WHERE after <= 1500 OR k <= 3
""")
def scl_30_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Entries of at most 500 characters; conversations that are still over 1500 keep their first three."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return K.fit_entries(c, "conv_id", "turn", "text", 500, 1500, 3).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM conversations""")
def scl_31_csv_cell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.csv_cell(F.col("text")).alias("cell"))


HEADERS, CELLS = ("NULL", "필수", "NOT NULL", "Nullable", "not  null 여부"), ("Y", "n", " yes ", "O", "x", "true", "1", "")


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(h, '(?i)필수|NOT\\s*NULL') THEN NOT y ELSE y END AS nullable FROM (SELECT p_partkey, {nth_sql(HEADERS, "p_partkey")} AS h, upper(trim({nth_sql(CELLS, "p_partkey // 5")})) IN ('Y', 'YES', 'O', 'TRUE', '1') AS y FROM part)
""")
def scl_32_nullable_header(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", S.nullable(nth(CELLS, F.floor(key / 5)), nth(HEADERS, key)).alias("nullable"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE substring(CAST(p_partkey AS VARCHAR), 1, 1) WHEN '1' THEN '발행' WHEN '2' THEN '구매' WHEN '3' THEN '결제' WHEN '4' THEN '환불' WHEN '5' THEN '선물' END,
 CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END], lambda x: coalesce(x, '') <> ''), ' > ') AS condition FROM part
""")
def scl_33_policy_condition(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("PP"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", S.policy_condition(code, F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 4 != 0, F.col("p_type"))).alias("condition"))


MAPPINGS = ("GetMapping", "PostMapping", "RequestMapping", "DeleteMapping", "RequestMapping")
ARGUMENTS = ('"/a"', 'value = "/b", method = RequestMethod.PUT', 'path = {"/c", "/d"}, method = {RequestMethod.GET, RequestMethod.POST}', "", 'consumes = "x", value = "/e"')


@query(f"""
SELECT p_partkey, CASE WHEN a <> 'RequestMapping' THEN upper(replace(a, 'Mapping', '')) WHEN len(m) > 0 THEN array_to_string(m, ',') ELSE 'GET' END AS methods, CASE WHEN v <> '' THEN v WHEN f <> '' THEN f END AS path
FROM (SELECT p_partkey, a, regexp_extract_all(g, 'RequestMethod\\.([A-Z]+)', 1) AS m, regexp_extract(g, '(?:value|path)\\s*=\\s*\\{{?\\s*"([^"]*)"', 1) AS v, regexp_extract(g, '"([^"]*)"', 1) AS f
 FROM (SELECT p_partkey, {nth_sql(MAPPINGS, "p_partkey")} AS a, {nth_sql(ARGUMENTS, "p_partkey // 5")} AS g FROM part))
""")
def scl_34_annotation(spark: SparkSession, d: str) -> DataFrame:
    a, g = nth(MAPPINGS, F.col("p_partkey")), nth(ARGUMENTS, F.floor(F.col("p_partkey") / 5))
    return table(spark, d, "part").select("p_partkey", F.array_join(S.annotation_methods(a, g), ",").alias("methods"), S.annotation_path(g).alias("path"))


# ---- sorts and sets


@query("""
SELECT event_id, row_number() OVER (ORDER BY CASE WHEN value >= 80 THEN 0 WHEN value >= 40 THEN 1 ELSE 2 END, ts, event_id) AS place FROM events ORDER BY 2 LIMIT 100
""")
def srt_03_severity_then_time(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 40, "MEDIUM").otherwise("LOW")
    page = table(spark, d, "events").orderBy(severity.severity_rank(kind), "ts", "event_id").limit(100)
    return K.numbered(page.select(severity.severity_rank(kind).alias("r"), "ts", "event_id"), ["r", "ts", "event_id"]).select("event_id", F.col("n").alias("place"))


@query("""
SELECT * FROM (SELECT 'name' AS sort, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part UNION ALL SELECT 'quality', p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) FROM part
 UNION ALL SELECT 'usage', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part) WHERE place <= 20
""")
def srt_08_catalog_sort(spark: SparkSession, d: str) -> DataFrame:
    """First page of the catalogue in each of its orders."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    out = None
    for name, order in (("name", [F.asc("p_name"), F.asc("p_partkey")]), ("quality", [F.desc("p_retailprice"), F.asc("p_partkey")]), ("usage", [F.desc("p_size"), F.asc("p_partkey")])):
        page = K.numbered(p.orderBy(*order).limit(20), order).select(F.lit(name).alias("sort"), "p_partkey", F.col("n").alias("place"))
        out = page if out is None else out.unionByName(page)
    return out


@query("""
SELECT l_partkey AS term, count(DISTINCT l_orderkey) AS weight FROM lineitem GROUP BY 1 ORDER BY weight DESC, term LIMIT 300
""")
def srt_09_top_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("term"), "l_orderkey").distinct()
    return t.groupBy("term").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "term").limit(300)


@query("""
WITH a AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R'), []) AS x, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N'), []) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_intersect(x, y)) AS both_, len(list_distinct(list_concat(x, y))) AS any_, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS only_x FROM a
""")
def set_02_set_operations(spark: SparkSession, d: str) -> DataFrame:
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(of("R").alias("x"), of("N").alias("y"))
    n = lambda c: F.size(c).cast("long")
    return a.select("l_orderkey", n(F.array_intersect("x", "y")).alias("both_"), n(F.array_union("x", "y")).alias("any_"), n(F.array_except("x", "y")).alias("only_x"))


@query("""
WITH f AS (SELECT l_orderkey, l_suppkey % 5 AS s, min(l_linenumber * 100000000 + l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(CAST(s AS VARCHAR), ',' ORDER BY p, s) AS suppliers FROM f GROUP BY 1
""")
def set_04_ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Values in order of first sight, each once."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("p"), (F.col("l_suppkey") % 5).alias("s"))))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    return g.select("l_orderkey", F.array_join(F.array_distinct(F.transform("r", lambda x: x["s"].cast("string"))), ",").alias("suppliers"))


# ---- classifiers of elements and files

ELEMENTS = ("XlSummary", "XlSheet:화면설계", "XlScreenMeta", "XlPolicy", "XlSheet:unknown", "Table", "XlSheet:테이블정의")
SUBTYPE_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SUBTYPE_CLASSES.items())


@query(f"""
WITH e AS (SELECT conv_id, turn, {nth_sql(ELEMENTS, "conv_id * 3 + turn")} AS t FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'XlSheet:') THEN CASE substring(t, 9) {SUBTYPE_SQL} ELSE 'general' END WHEN starts_with(t, 'XlScreen') OR t = 'XlProgramMeta' THEN 'screen_design' WHEN t IN ('XlPolicy', 'XlTerm', 'XlTransactionType') THEN 'requirements' END AS c,
  CASE WHEN starts_with(t, 'XlSheet:') THEN CASE WHEN t LIKE '%unknown' THEN 0.5 ELSE 0.9 END WHEN starts_with(t, 'XlScreen') THEN 0.9 ELSE 0.95 END AS k FROM e)
SELECT conv_id, coalesce(min_by(c, turn) FILTER (c IS NOT NULL), 'general') AS class, CAST(coalesce(min_by(k, turn) FILTER (c IS NOT NULL), 0.3) AS DOUBLE) AS confidence FROM c GROUP BY 1
""")
def mod_04_workbook_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select("conv_id", "turn", nth(ELEMENTS, F.col("conv_id") * 3 + F.col("turn")).alias("type"))
    return K.workbook_class(e, "conv_id", "turn")


SOURCES = ("CodeController", "CodeDataModel", "CodeDdl", "Text", "CodeMapper", "CodeTransaction")


@query(f"""
WITH e AS (SELECT conv_id, list(DISTINCT t) FILTER (t <> 'Text') AS l FROM (SELECT conv_id, {nth_sql(SOURCES, "conv_id + turn // 4")} AS t FROM conversations) GROUP BY 1)
SELECT conv_id, CASE WHEN len(l) > 1 THEN 'source_project' WHEN list_contains(l, 'CodeController') THEN 'source_controller' WHEN list_contains(l, 'CodeDataModel') THEN 'source_vo' WHEN list_contains(l, 'CodeTransaction') THEN 'source_service'
 WHEN list_contains(l, 'CodeDdl') THEN 'source_ddl' WHEN list_contains(l, 'CodeMapper') THEN 'source_mapper' ELSE 'source_config' END AS class FROM e
""")
def mod_04_source_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select("conv_id", nth(SOURCES, F.col("conv_id") + F.floor(F.col("turn") / 4)).alias("type"))
    return K.source_class(e, "conv_id").select("conv_id", "class")


FILES = ("OrderController.java", "OrderVO.java", "OrderServiceImpl.java", "schema.sql", "Util.java", "PayRequest.java")
BODIES = ("class X", "@RestController class X", "@Service class X", "@Entity class X", "@Component class X", "@ControllerAdvice class X", "plain")


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(b, '@RestController\\b|@Controller\\b') THEN 'source_controller' WHEN regexp_matches(b, '@Service\\b') THEN 'source_service' WHEN regexp_matches(b, '@Entity\\b') THEN 'source_vo' WHEN regexp_matches(b, '@Configuration\\b|@Component\\b') THEN 'source_config'
 WHEN f LIKE '%Controller.java' THEN 'source_controller' WHEN regexp_matches(f, '(VO|Dto|DTO|Entity|Req|Res|Request|Response)\\.java$') THEN 'source_vo' WHEN regexp_matches(f, '(Service|ServiceImpl)\\.java$') THEN 'source_service' WHEN f LIKE '%.sql' THEN 'source_ddl' ELSE 'source_config' END AS class
FROM (SELECT p_partkey, {nth_sql(FILES, "p_partkey")} AS f, {nth_sql(BODIES, "p_partkey // 6")} AS b FROM part)
""")
def mod_05_java_file_class(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", S.java_class(nth(FILES, key), nth(BODIES, F.floor(key / 6))).alias("class"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'approve' WHEN l_returnflag = 'R' THEN 'reject' WHEN l_linestatus = 'O' THEN 'approve' ELSE 'reject' END AS decision, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS rounds,
 CAST(CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'O') THEN 0.85 ELSE 0.2 END AS DOUBLE) AS score FROM lineitem
""")
def mod_09_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two rounds as JSON; a second split, like an unreadable answer, rejects."""
    answer = lambda c: F.concat(F.lit('I think {"decision": "'), c, F.lit('", "reasoning": "r"}'))
    first = F.when(F.col("l_returnflag") == "A", answer(F.lit("approve"))).when(F.col("l_returnflag") == "R", answer(F.lit("reject"))).otherwise(F.lit("no json"))
    second = F.when(F.col("l_linestatus") == "O", answer(F.lit("approve"))).otherwise(answer(F.lit("split")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.consensus(first, second).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""
WITH s AS (SELECT user_id, event_id % 6 AS criterion, CAST(round(avg(CAST(value AS DECIMAL(18,2))) * 10) AS BIGINT) AS t FROM events GROUP BY 1, 2), c AS (SELECT user_id, least(1.0, t / 600.0)::DOUBLE AS score FROM s)
SELECT user_id, floor(sum(CAST(floor(score * 1000 + 0.5) AS BIGINT)) / 6.0::DOUBLE + 0.5) / 1000 AS total, count(*) FILTER (score >= 0.75) AS passed, count(*) FILTER (score >= 0.75) >= 4 AS ok FROM c GROUP BY 1
""")
def mod_11_criteria_votes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 6).alias("criterion")).agg(F.round(F.avg(F.col("value").cast("decimal(18,2)")) * 10).cast("long").alias("t"))
    return K.criteria_votes(s.select(F.col("user_id").alias("key"), "criterion", F.least(F.lit(1.0), F.col("t") / 600.0).alias("score"))).withColumnRenamed("key", "user_id")


DOMAIN_SQL = "CASE " + " ".join(f"WHEN {c} <> '' AND regexp_matches({c}, '(?i){'|'.join(p)}') THEN '{name}'" for name, *all_ in rules.DOMAINS for c, p in zip(("path", "controller", "tab"), all_, strict=True) if p) + " ELSE 'unknown' END"
AREAS = ("/charge", "/gift/x", "/company/join", "/login", "/board", "/settleBank/y", "/v2/messages", "/nothing")
TABLES = ("TB_POINT_ACCML", "com_code", "xroshot_q", "zz", "TB_VRTL_ACNT", "card_list")


@query(f"""
SELECT page_id, {DOMAIN_SQL} AS domain FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {nth_sql(AREAS, "page_id")} ELSE '' END AS path, CASE WHEN page_id % 3 = 1 THEN {nth_sql(CONTROLLERS, "page_id")} ELSE '' END AS controller,
 CASE WHEN page_id % 3 = 2 OR page_id % 4 = 0 THEN {nth_sql(TABLES, "page_id")} ELSE '' END AS tab FROM pages)
""")
def mod_13_domain_by_all_parts(spark: SparkSession, d: str) -> DataFrame:
    """Paths, controllers and tables, each absent in some rows."""
    key = F.col("page_id")
    part = lambda test, values: F.when(test, nth(values, key)).otherwise("")
    return table(spark, d, "pages").select("page_id", rules.gap_domain(part(key % 3 == 0, AREAS), part(key % 3 == 1, CONTROLLERS), part((key % 3 == 2) | (key % 4 == 0), TABLES)).alias("domain"))


#: Keyword classes: parts of words, phrases, hyphens and Hangul; two classes tie on some items.
CLASSES = {"fastening": (("bolt", "NUT", "small bolt"), 1.0), "drive": (("gear", "rod", "large-gear", "구동"), 0.5), "goods": (("widget", "promo", "구동"), 0.5), "price": (("econ", "저가", "Brand#1"), 0.25)}
ITEM_SQL = "lower(p_name || ' ' || p_type || ' ' || CAST(p_partkey AS VARCHAR) || ' ' || p_brand || ' ' || CASE p_partkey % 3 WHEN 0 THEN '구동부' WHEN 1 THEN replace(p_name, ' ', '-') ELSE '최저가' END)"
SCORES_SQL = ", ".join(f"({' + '.join(f"CAST(contains(t, '{w.lower()}') AS INTEGER)" for w in words)}) * {weight}::DOUBLE AS {name}" for name, (words, weight) in CLASSES.items())


@query(f"""
WITH s AS (SELECT p_partkey, {SCORES_SQL} FROM (SELECT p_partkey, {ITEM_SQL} AS t FROM part)), b AS (SELECT *, greatest({", ".join(CLASSES)}) AS score FROM s),
c AS (SELECT *, CASE WHEN score = 0 THEN 'uncategorized' {" ".join(f"WHEN score = {n} THEN '{n}'" for n in CLASSES)} END AS class FROM b)
SELECT p_partkey, class, score, CASE class {" ".join(f"WHEN '{n}' THEN floor(least(1.0, score / ({len(w)} * 0.3::DOUBLE)) * 100 + 0.5) / 100" for n, (w, _) in CLASSES.items())} ELSE 0 END AS confidence FROM c
""")
def mod_17_keyword_class(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalogue items of name, description, id and tags; every third has a tag in Hangul, another a hyphenated one."""
    from ..operators import models as D

    key = F.col("p_partkey")
    tag = F.when(key % 3 == 0, "구동부").when(key % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise("최저가")
    text = F.concat_ws(" ", "p_name", "p_type", key.cast("string"), "p_brand", tag)
    return table(spark, d, "part").select("p_partkey", D.keyword_class(text, CLASSES).alias("x")).select("p_partkey", "x.*")


#: Assertions by line: their keys, with what is expected of them and what came out (ok: the run succeeded).
CONTRACT_KEYS = ("payment_completed", "cancel_completed", "deposit_requested", "refund_rejected", "balance_after", "balance_restored", "balance_unchanged", "error_code", "sms_sent", "card_approval_id", "refund_status", "rfndPsbltyYn", "reject_reason_recorded", "deposit_amount", "exclusion_amount", "responseStatus", "unheard_of")
CONTRACT_CODES = ("INSUFFICIENT_VOUCHER_BALANCE", "VOUCHER_NOT_FOUND", "E404-V", "FULL_REFUND_PERIOD_EXPIRED")
CONTRACT_ERRORS = ("E422-BAL", "E404-V", "PERIOD_EXPIRED", "UNSUPPORTED_WHEN: card")
CONTRACT_STATES = ("PENDING", "COMPLETED", "REJECTED", "REQUESTED")
CONTRACT_RESULTS = ("APPROVED", "REQUESTED", "DONE")


@query(f"""
WITH a AS (SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, {nth_sql(CONTRACT_KEYS, "l_partkey")} AS key, l_suppkey % 2 = 0 AS yes, l_orderkey % 3 <> 0 AS ok, l_suppkey % 5 AS w, l_orderkey % 4 AS n,
 {nth_sql(CONTRACT_CODES, "l_suppkey")} AS code, {nth_sql(CONTRACT_ERRORS, "l_orderkey")} AS error, {nth_sql(CONTRACT_STATES, "l_suppkey")} AS state, {nth_sql(CONTRACT_RESULTS, "l_orderkey")} AS status FROM lineitem),
f AS (SELECT *, CASE
  WHEN key IN ('payment_completed', 'cancel_completed', 'deposit_requested') THEN CASE WHEN yes <> ok THEN 'WRONG_OUTCOME' END
  WHEN key = 'refund_rejected' THEN CASE WHEN yes AND ok THEN 'WRONG_OUTCOME' END
  WHEN key = 'balance_unchanged' THEN CASE WHEN ok THEN 'WRONG_OUTCOME' END
  WHEN key = 'error_code' THEN CASE WHEN ok THEN 'EXPECTED_ERROR_MISSING' WHEN error <> (CASE code WHEN 'INSUFFICIENT_VOUCHER_BALANCE' THEN 'E422-BAL' WHEN 'VOUCHER_NOT_FOUND' THEN 'E404-V' WHEN 'FULL_REFUND_PERIOD_EXPIRED' THEN 'PERIOD_EXPIRED' ELSE code END) THEN 'WRONG_VALUE' END
  WHEN key = 'sms_sent' THEN CASE WHEN yes AND NOT (ok AND n > 1) THEN 'WRONG_VALUE' END
  WHEN key = 'refund_status' THEN CASE WHEN NOT ok AND state <> 'REJECTED' THEN 'UNEXPECTED_ERROR'
    WHEN (CASE WHEN NOT ok THEN 'REJECTED' WHEN status = 'APPROVED' THEN 'COMPLETED' ELSE status END) <> (CASE state WHEN 'PENDING' THEN 'REQUESTED' ELSE state END) THEN 'WRONG_VALUE' END
  WHEN key IN ('responseStatus', 'unheard_of') THEN NULL
  WHEN NOT ok THEN 'UNEXPECTED_ERROR'
  WHEN key = 'balance_after' THEN CASE WHEN w <> n THEN 'WRONG_VALUE' END
  WHEN key = 'balance_restored' THEN CASE WHEN w <> (CASE WHEN n = 1 THEN 7 ELSE n END) THEN 'WRONG_VALUE' END
  WHEN key = 'card_approval_id' THEN CASE WHEN yes AND n IN (0, 2) THEN 'WRONG_VALUE' END
  WHEN key = 'rfndPsbltyYn' THEN CASE WHEN yes <> (n = 3) THEN 'WRONG_VALUE' END
  WHEN key = 'reject_reason_recorded' THEN CASE WHEN yes AND n <> 2 THEN 'WRONG_VALUE' END
  ELSE CASE WHEN w <> n THEN 'WRONG_VALUE' END END AS fail FROM a)
SELECT l_orderkey, CASE WHEN bool_or(NOT ok AND starts_with(error, 'UNSUPPORTED_WHEN:')) THEN 'UNSUPPORTED_WHEN' ELSE min_by(fail, pos) FILTER (fail IS NOT NULL) END AS reason,
 count(fail) = 0 AND NOT bool_or(NOT ok AND starts_with(error, 'UNSUPPORTED_WHEN:')) AS passed FROM f GROUP BY 1
""")
def mod_21_contract(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as the assertions of a scenario, with all keys; the outcome is the order's."""
    yes, number, order = F.col("l_suppkey") % 2 == 0, (F.col("l_suppkey") % 5).cast("string"), F.col("l_orderkey")
    key, n = nth(CONTRACT_KEYS, F.col("l_partkey")), order % 4
    expected = (
        F.when(key == "error_code", nth(CONTRACT_CODES, F.col("l_suppkey")))
        .when(key == "refund_status", nth(CONTRACT_STATES, F.col("l_suppkey")))
        .when(key == "card_approval_id", F.when(yes, "non-null").otherwise("any"))
        .when(key == "rfndPsbltyYn", F.when(yes, "Y").otherwise("N"))
        .when(key.isin("balance_after", "balance_restored", "deposit_amount", "exclusion_amount"), number)
        .otherwise(yes.cast("string"))
    )
    text = n.cast("string")
    result = {
        "balanceAfter": text, "deposit_amount": text, "exclusion_amount": text, "amount": F.lit("7"), "balanceRestored": F.when(n != 1, text), "status": nth(CONTRACT_RESULTS, order),
        "cardApprovalId": F.when(n == 1, "c1").when(n == 2, ""), "approvalId": F.when(n == 3, "a3").when(n == 2, "a2"), "rfndPsbltyYn": F.when(n == 3, "Y").otherwise("N"), "reject_reason_recorded": F.when(n == 2, "true").when(n == 3, "false"),
    }
    a = table(spark, d, "lineitem").select(
        order.alias("scenario"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("position"), key.alias("key"), expected.alias("expected"), (order % 3 != 0).alias("ok"),
        F.create_map(*(x for k, v in result.items() for x in (F.lit(k), v))).alias("result"), (n > 1).alias("sms"), nth(CONTRACT_ERRORS, order).alias("error"),
    )
    return K.compare_contracts(a).withColumnRenamed("scenario", "l_orderkey")


@query("""
WITH p AS (SELECT DISTINCT r_name AS role, CASE n_nationkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'skill' ELSE 'audit' END AS resource, CASE WHEN n_nationkey % 2 = 0 THEN 'read' ELSE 'update' END AS action FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 7 <> 0),
q AS (SELECT s_suppkey, r_name AS role, CASE s_suppkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'skill' ELSE 'audit' END AS resource, CASE WHEN s_suppkey % 2 = 0 THEN 'read' ELSE 'update' END AS action FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT s_suppkey, p.role IS NOT NULL AS allowed FROM q LEFT JOIN p ON p.role = q.role AND p.resource = q.resource AND p.action = q.action
""")
def mod_24_permissions(spark: SparkSession, d: str) -> DataFrame:
    names = lambda key: (nth(("policy", "skill", "audit"), key).alias("resource"), nth(("read", "update"), key).alias("action"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    granted = nations.where("n_nationkey % 7 <> 0").select(F.col("r_name").alias("role"), *names(F.col("n_nationkey"))).distinct()
    asked = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("role"), *names(F.col("s_suppkey")))
    return K.allowed(asked, granted).select("s_suppkey", "allowed")


@query("""
SELECT p_brand AS domain, p_type AS type, count(*) AS policies, '## ' || p_brand || ' / ' || p_type || ' (' || CAST(count(*) AS VARCHAR) || ')' || string_agg(chr(10) || '- POL-' || CAST(p_partkey AS VARCHAR) || ': ' || p_name, '' ORDER BY p_partkey) AS section FROM part GROUP BY 1, 2
""")
def mod_25_business_sections(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("type"), F.col("p_partkey").alias("position"), F.concat(F.lit("POL-"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("title"))
    return K.business_sections(p)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'force-graph' WHEN o_orderkey % 7 = 0 THEN 'mermaid-flowchart' WHEN o_orderkey % 5 = 0 THEN 'mermaid-tree' WHEN o_orderkey % 3 = 0 THEN 'line-chart'
 WHEN o_orderkey % 2 = 0 AND o_custkey % 9 <= 5 THEN 'bar-chart' WHEN o_orderkey % 2 = 0 AND o_custkey % 9 > 5 THEN 'heatmap-table' WHEN o_custkey % 40 > 20 THEN 'data-table' ELSE 'text' END AS view_ FROM orders
""")
def mod_26_view_choice(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", S.view_of(k % 11 == 0, k % 7 == 0, k % 5 == 0, k % 3 == 0, k % 2 == 0, c % 9, c % 40).alias("view_"))


@query("""
WITH f AS (SELECT l_orderkey AS c, CASE l_linenumber % 4 WHEN 0 THEN 'rules' WHEN 1 THEN 'contract' WHEN 2 THEN 'provenance' ELSE 'test' END AS kind FROM lineitem)
SELECT c AS container, count(*) FILTER (kind = 'rules') AS rules_, count(*) FILTER (kind = 'test') AS tests, bool_or(kind = 'contract') AND bool_or(kind = 'provenance') AND bool_or(kind = 'rules') AND bool_or(kind = 'test') AS complete FROM f GROUP BY 1
""")
def mod_27_container_review(spark: SparkSession, d: str) -> DataFrame:
    names = ("rules/r{}.md", "contract.yaml", "provenance.yaml", "tests/t{}.yaml")
    path = F.element_at(F.array(*(F.concat(F.col("l_orderkey").cast("string"), F.lit("/" + n.replace("{}", "1"))) for n in names)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return K.review_containers(table(spark, d, "lineitem").select(path.alias("path"))).select(F.col("container").cast("long").alias("container"), F.col("rules").alias("rules_"), "tests", "complete")
