"""Source artefacts composed from the stand-in tables, and parsed again: the SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import specs as S
from ..operators import sources as A
from ..operators import stored as B
from ..sources import parsers as P
from .registry import query, table
from .specs import nth, nth_sql

# ---- files

MAGIC = ("504B0304", "D0CF11E0", "25504446", "89504E47", "FFD8FFE0", "5343445341303032", "00010203", "50")
KINDS = ("xlsx", "xls", "pdf", "png", "jpg", "docx", "txt", "pptx", "zip")


@query(f"""
WITH f AS (SELECT doc_id, {nth_sql(MAGIC, "doc_id")} || CASE WHEN doc_id % 8 = 7 THEN '' ELSE '00000000' END AS h, {nth_sql(KINDS, "doc_id // 8")} AS k FROM documents),
g AS (SELECT *, k <> 'txt' AS known, length(h) < 8 AS small, starts_with(h, '5343445341303032') AS locked, CASE WHEN k IN ('xlsx', 'docx', 'pptx', 'zip') AND starts_with(h, '504B0304') THEN 'ZIP/PK' WHEN k = 'xls' AND starts_with(h, 'D0CF11E0') THEN 'OLE2'
 WHEN k = 'pdf' AND starts_with(h, '25504446') THEN '%PDF' WHEN k = 'png' AND starts_with(h, '89504E47') THEN 'PNG' WHEN k = 'jpg' AND starts_with(h, 'FFD8FF') THEN 'JPEG' END AS label FROM f)
SELECT doc_id, NOT known OR (NOT small AND label IS NOT NULL) AS valid, CASE WHEN NOT known THEN NULL WHEN small THEN 'too_small' WHEN label IS NOT NULL THEN NULL WHEN locked THEN 'encrypted_scdsa002' ELSE 'wrong_header' END AS error FROM g
""")
def src_03_file_format(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    content = F.unhex(F.concat(nth(MAGIC, key), F.when(key % 8 == 7, "").otherwise("00000000")))
    valid, _, error = rules.file_format(content, nth(KINDS, F.floor(key / 8)))
    return table(spark, d, "documents").select("doc_id", valid.alias("valid"), error.alias("error"))


MESSAGES = ("Request timeout after 30s", "fetch failed", "The operation was ABORTED", "unexpected token", "ECONNREFUSED 127.0.0.1", "Network unreachable", "bad zip")


@query(f"""
SELECT event_id, CASE WHEN lower(n) = 'aborterror' OR contains(lower(m), 'abort') OR contains(lower(m), 'timeout') THEN 'timeout' WHEN regexp_matches(lower(m), 'network|fetch|econnrefused') THEN 'network_error' ELSE 'parse_error' END AS kind
FROM (SELECT event_id, {nth_sql(MESSAGES, "event_id")} AS m, CASE WHEN event_type = 'error' THEN 'AbortError' ELSE 'Error' END AS n FROM events)
""")
def src_04_parse_error(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "AbortError").otherwise("Error")
    return table(spark, d, "events").select("event_id", rules.parse_error(name, nth(MESSAGES, F.col("event_id"))).alias("kind"))


@query("""
WITH p AS (SELECT 'parts ' || CAST(p_partkey // 700 AS VARCHAR) AS sheet, p_partkey AS k, CASE WHEN p_partkey % 700 // 40 % 5 = 3 OR p_size = 7 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS a,
 CASE WHEN p_partkey % 700 // 40 % 5 = 3 OR p_size = 7 THEN '' WHEN p_size % 9 = 0 THEN repeat(p_name || '|' || chr(10), 300) ELSE p_name END AS b FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY k) AS n, count(*) OVER (PARTITION BY sheet) AS rows_ FROM p),
c AS (SELECT sheet, CAST((n - 1) // 40 AS INTEGER) AS chunk, (rows_ + 39) // 40 AS of_, string_agg(chr(10) || '| ' || a || ' | ' || replace(replace(substring(b, 1, 2000), '|', '\\|'), chr(10), ' ') || ' |', '' ORDER BY n) AS body FROM r GROUP BY ALL HAVING bool_or(a <> '' OR b <> ''))
SELECT sheet, chunk, '## ' || sheet || ' [' || CAST(chunk + 1 AS VARCHAR) || '/' || CAST(of_ AS VARCHAR) || ']' || chr(10) || chr(10) || '| key | a\\|b |' || chr(10) || '| --- | --- |' || body AS text FROM c
UNION ALL SELECT n_name, 0, '## ' || n_name || ' [1/1]' || chr(10) || chr(10) || '| only | header |' || chr(10) || '| --- | --- |' FROM nation WHERE n_nationkey % 3 > 0
""")
def src_05_sheet_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of sheets of 700; some rows and some chunks are blank, some cells long. Nations as sheets of a header alone, some of them blank."""
    key, blank = F.col("p_partkey"), F.expr("p_partkey % 700 div 40 % 5 = 3 or p_size = 7")
    cells = F.when(blank, F.array(F.lit(""), F.lit(""))).otherwise(F.array(key.cast("string"), F.when(F.col("p_size") % 9 == 0, F.repeat(F.concat("p_name", F.lit("|\n")), 300)).otherwise(F.col("p_name"))))
    p = table(spark, d, "part").select(F.concat(F.lit("parts "), F.expr("p_partkey div 700").cast("string")).alias("sheet"), key.alias("k"), cells.alias("cells"))
    rows = p.select("sheet", F.row_number().over(Window.partitionBy("sheet").orderBy("k")).alias("row_no"), "cells")
    head = lambda *names: F.array(*map(F.lit, names)).alias("cells")
    n = table(spark, d, "nation").select(F.col("n_name").alias("sheet"), F.lit(0).alias("row_no"), F.when(F.col("n_nationkey") % 3 > 0, head("only", "header")).otherwise(head("", " ")).alias("cells"))
    return P.sheet_chunks(rows.unionByName(p.select("sheet").distinct().select("sheet", F.lit(0).alias("row_no"), head("key", "a|b"))).unionByName(n), "sheet")


FILES = ("A 화면 설계서.xlsx", "PGM설계.xlsx", "테이블목록 v2.xlsx", "배치 정의.xlsx", "I/F 설계.xlsx", "통합 테스트.xlsx", "요구 사항.xlsx", "코드정의.xlsx", "정책 관리.xlsx", "공통모듈.xlsx", "other.xlsx", "업무 규칙.xls", "단위테스트.xlsx")


@query("""SELECT doc_id, """ + f"""{nth_sql(("화면설계", "프로그램설계", "테이블정의", "배치설계", "인터페이스설계", "통합테스트", "요구사항", "코드정의", "정책정의", "공통", "unknown", "업무규칙", "단위테스트"), "doc_id")} AS subtype FROM documents""")
def src_06_workbook_subtype(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.workbook_subtype(nth(FILES, F.col("doc_id"))).alias("subtype"))


SHEETS = ("표지", "목록", "제개정이력", "작성가이드(1)", "화면 1", "DB 명명규칙", "표지 2", "샘플")


@query(f"SELECT doc_id, s IN ('표지', '제개정이력') OR regexp_matches(s, '샘플|작성가이드|명명규칙') AS skipped FROM (SELECT doc_id, {nth_sql(SHEETS, 'doc_id')} AS s FROM documents)")
def src_07_skipped_sheet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.skip_sheet(nth(SHEETS, F.col("doc_id"))).alias("skipped"))


@query("""
WITH f AS (SELECT doc_id, CAST(n_chars // 100 + 1 AS INTEGER) AS pages, n_chars * 1000 AS size FROM documents), s AS (SELECT *, CASE WHEN pages > 20 OR size > 5242880 THEN 10 ELSE pages END AS step FROM f)
SELECT doc_id, CAST(x AS INTEGER) AS first_page, CAST(least(pages, x + step - 1) AS INTEGER) AS last_page FROM (SELECT *, unnest(range(1, pages + 1, step)) AS x FROM s)
""")
def src_11_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 100 + 1).cast("int").alias("pages"), (F.col("n_chars") * 1000).alias("size"))
    return P.page_chunks(f, "pages", "size").select("doc_id", "first_page", "last_page")


@query("""
WITH f AS (SELECT o_custkey AS project, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'sql' WHEN 2 THEN 'xml' ELSE 'java' END AS type FROM orders)
SELECT project, count(*) AS files, count(*) FILTER (type = 'java') AS java_files, count(*) FILTER (type = 'sql') AS sql_files, count(*) FILTER (o_orderkey % 5 = 0) AS controllers, count(*) FILTER (o_orderkey % 5 = 0) * 2 AS endpoints,
 count(*) FILTER (o_orderkey % 5 = 1) AS tables, count(*) FILTER (o_orderkey % 5 = 2) AS mappers, floor(count(*) * 100 / (count(*) + project % 4)::DOUBLE + 0.5) / 100 AS rate FROM f GROUP BY 1
""")
def src_14_project_summary(spark: SparkSession, d: str) -> DataFrame:
    """Order files of each customer's project, read by their types and summed up in a row."""
    key = F.col("o_orderkey")
    controller = F.concat(F.lit('@RestController public class C { @GetMapping("/a") void a() {} @PostMapping("/b'), key.cast("string"), F.lit('") void b(String x) {} }'))
    ddl = F.concat(F.lit("create table t"), key.cast("string"), F.lit(" (a int, b int)"))
    mapper = F.lit('<mapper namespace="m"><select id="f">select a from t</select></mapper>')
    content = F.when(key % 5 == 0, controller).when(key % 5 == 1, ddl).when(key % 5 == 2, mapper).otherwise("interface I {}")
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.when(key % 5 == 1, "sql").when(key % 5 == 2, "xml").otherwise("java").alias("type"), content.alias("content"))
    skipped = files.select("project").distinct().select("project", (F.col("project") % 4).alias("skipped"))
    return A.project_summary(files, skipped).select("project", "files", "java_files", "sql_files", "controllers", "endpoints", "tables", "mappers", "rate")


@query("""
SELECT event_id, CASE WHEN event_type IN ('error', 'view') AND event_id % 5 < 3 THEN 'retry' WHEN event_type = 'view' THEN 'fast' ELSE 'failed' END AS step, CASE WHEN event_type IN ('error', 'view') AND event_id % 5 < 3 THEN CAST(1000 * pow(2, event_id % 5) AS BIGINT) END AS wait_ms FROM events
""")
def src_15_parse_retry(spark: SparkSession, d: str) -> DataFrame:
    step, wait = S.parse_retry(F.col("event_id") % 5, F.col("event_type").isin("error", "view"), F.col("event_type") == "view")
    return table(spark, d, "events").select("event_id", step.alias("step"), wait.alias("wait_ms"))


# ---- Java


def controllers(spark: SparkSession, d: str) -> DataFrame:
    """A Java controller for each brand, a method for each of its parts."""
    key = F.col("p_partkey").cast("string")
    note = nth(('@GetMapping("/{}")', '@PostMapping(value = "/{}", consumes = "x")', '@RequestMapping(path = {"/{}", "/other"}, method = RequestMethod.PUT)', "@DeleteMapping"), F.col("p_partkey"))
    method = F.concat(F.replace(note, F.lit("{}"), key), F.lit("\n  public Result<List<Part>> m"), key, F.lit("(@RequestParam(required = false) String q, @PathVariable Long id"), F.when(F.col("p_size") % 2 == 0, ", @RequestBody Map<String, Integer> body").otherwise(""), F.lit(") {\n    return call(a, b);\n  }\n"))
    methods = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", method.alias("m")))), lambda x: x["m"]), "")
    g = table(spark, d, "part").groupBy("p_brand").agg(methods.alias("m"))
    name = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    return g.select("p_brand", F.concat(F.lit('package x;\n@RestController\n@RequestMapping("/api/'), name, F.lit('/")\npublic class '), name, F.lit("Controller {\n"), "m", F.lit("}\n")).alias("text"))


@query("""
SELECT p_brand, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || 'Controller' AS controller, ['GET', 'POST', 'PUT', 'DELETE'][CAST(p_partkey % 4 AS INTEGER) + 1] AS method, '/api/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE '/' || CAST(p_partkey AS VARCHAR) END AS path,
 'm' || CAST(p_partkey AS VARCHAR) AS name, 'Result<List<Part>>' AS returns, 'q:String:false:@RequestParam,id:Long:true:@PathVariable' || CASE WHEN p_size % 2 = 0 THEN ',body:Map<String, Integer>:false:@RequestBody' ELSE '' END AS params FROM part
""")
def src_16_controllers(spark: SparkSession, d: str) -> DataFrame:
    found = P.read_controllers(controllers(spark, d), "text", ["p_brand"])
    one = F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"), p["annotation"]))
    return found.select("p_brand", "controller", F.array_join("methods", ",").alias("method"), "path", F.col("method_name").alias("name"), F.col("return_type").alias("returns"), F.array_join(one, ",").alias("params"))


@query("""
SELECT p_brand, 'TB_' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS tab, 'f' || CAST(p_partkey AS VARCHAR) AS field, CASE WHEN p_size % 2 = 0 THEN 'Map<String, Long>' ELSE 'String' END AS type, CASE WHEN p_partkey % 3 = 1 THEN 'C' || CAST(p_partkey AS VARCHAR) END AS col,
 p_partkey % 3 = 0 AS primary_, p_partkey % 3 = 2 AS nullable FROM part
""")
def src_18_data_models(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    note = F.when(F.col("p_partkey") % 3 == 0, "@Id").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('@Column(name = "C'), key, F.lit('", nullable = false)'))).otherwise("")
    line = F.concat(F.lit("  "), note, F.lit(" private "), F.when(F.col("p_size") % 2 == 0, "Map<String, Long>").otherwise("String"), F.lit(" f"), key, F.when(F.col("p_size") % 5 == 0, ' = make("a;b");\n').otherwise(";\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("m")))), lambda x: x["m"]), "")
    g = table(spark, d, "part").groupBy("p_brand").agg(body.alias("m"))
    name = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    text = F.concat(F.lit('@Entity @Table(name = "TB_'), name, F.lit('")\npublic class '), name, F.lit("VO {\n  private static final long serial = 1L;\n"), "m", F.lit("  public String get() { return a; }\n}"))
    found = P.read_data_models(g.select("p_brand", text.alias("text")), "text", ["p_brand"])
    return found.select("p_brand", F.col("table").alias("tab"), "field", "type", F.col("column").alias("col"), F.col("primary").alias("primary_"), "nullable")


@query("""
SELECT p_brand, 'm' || CAST(p_partkey AS VARCHAR) AS method, p_partkey % 3 <> 2 OR p_brand LIKE '%1%' AS transactional, p_partkey % 3 = 1 AS read_only FROM part WHERE p_size % 4 <> 0
""")
def src_19_services(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    note = F.when(F.col("p_partkey") % 3 == 0, "@Transactional").when(F.col("p_partkey") % 3 == 1, '@Transactional(readOnly = true, timeout = 3) @Deprecated').otherwise("")
    line = F.concat(F.lit("  "), note, F.when(F.col("p_size") % 4 == 0, " private ").otherwise(" public "), F.lit("Order m"), key, F.lit("(Long id, Map<String, Long> x) throws E {\n    if (id > 0) { go(); }\n  }\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("m")))), lambda x: x["m"]), "")
    g = table(spark, d, "part").groupBy("p_brand").agg(body.alias("m"))
    text = F.concat(F.lit("@Service\n"), F.when(F.col("p_brand").contains("1"), "@Transactional\n").otherwise(""), F.lit("public class PartService {\n"), "m", F.lit("}"))
    found = P.read_services(g.select("p_brand", text.alias("text")), "text", ["p_brand"])
    return found.select("p_brand", F.col("method_name").alias("method"), "transactional", "read_only")


# ---- SQL texts


def schemas(spark: SparkSession, d: str) -> DataFrame:
    """A CREATE TABLE script for each brand: a column for each part, one key, a foreign key and an index."""
    key = F.col("p_partkey").cast("string")
    kind = nth(("DECIMAL(10,2)", "varchar(20)", "BIGINT", "date"), F.col("p_partkey"))
    rest = F.concat(F.when(F.col("p_size") % 3 == 0, " NOT NULL").otherwise(""), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" DEFAULT '"), "p_size", F.lit("'"))).otherwise(""), F.lit(" COMMENT '"), "p_name", F.lit(", (x)'"))
    line = F.concat(F.lit("  `c"), key, F.lit("` "), kind, rest, F.lit(",\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("m")))), lambda x: x["m"]), "")
    g = table(spark, d, "part").groupBy("p_brand").agg(body.alias("m"), F.min("p_partkey").cast("string").alias("low"), F.max("p_partkey").cast("string").alias("high"))
    name = F.concat(F.lit("tb_"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    return g.select("p_brand", F.concat(F.lit("-- a, b; (c)\nCREATE TABLE IF NOT EXISTS "), name, F.lit(" (\n"), "m", F.lit("  PRIMARY KEY (c"), "low", F.lit("),\n  CONSTRAINT k FOREIGN KEY (`c"), "high", F.lit("`) REFERENCES tb_all (id)\n);\ncreate index i on "), name, F.lit(" (c"), "low", F.lit(", c"), "high", F.lit(");")).alias("text"))


BRANDS_SQL = "SELECT *, 'tb_' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS tab, min(p_partkey) OVER (PARTITION BY p_brand) AS low, max(p_partkey) OVER (PARTITION BY p_brand) AS high FROM part"


@query(f"""
SELECT tab, 'c' || CAST(p_partkey AS VARCHAR) AS col, {nth_sql(("DECIMAL(10,2)", "varchar(20)", "BIGINT", "date"), "p_partkey")} AS type, p_size % 3 <> 0 AS nullable, p_partkey = low AS primary_, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) END AS default_, p_name || ', (x)' AS comment, CASE WHEN p_partkey = high THEN 'tb_all.id' END AS refs FROM ({BRANDS_SQL})
""")
def src_20_ddl(spark: SparkSession, d: str) -> DataFrame:
    found = P.read_ddl(schemas(spark, d), "text", ["p_brand"])
    return found.select(F.col("table").alias("tab"), F.col("column").alias("col"), "type", "nullable", F.col("primary").alias("primary_"), F.col("default_value").alias("default_"), "comment", F.col("references").alias("refs"))


@query(f"""
WITH b AS ({BRANDS_SQL}) SELECT 'entity' AS kind, tab AS name, string_agg('c' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey = low THEN '*' ELSE '' END, ',' ORDER BY p_partkey) AS detail FROM b GROUP BY tab
UNION ALL SELECT 'relation', tab || '.c' || CAST(p_partkey AS VARCHAR), 'tb_all.id' FROM b WHERE p_partkey = high UNION ALL SELECT DISTINCT 'index', tab, 'c' || CAST(low AS VARCHAR) || ',c' || CAST(high AS VARCHAR) FROM b
""")
def src_21_schema(spark: SparkSession, d: str) -> DataFrame:
    return P.read_schema(schemas(spark, d), "text", ["p_brand"]).select("kind", "name", "detail")


@query("""
SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'insert' WHEN p_partkey % 3 = 1 THEN 'select' ELSE 'resultMap' END AS kind, 'q' || CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 3 WHEN 0 THEN 'TB_P' WHEN 1 THEN 'TB_A,TB_B' ELSE '' END AS tables, CASE p_partkey % 3 WHEN 0 THEN 'x,y' WHEN 1 THEN 'C1,total' ELSE 'ID,NAME' END AS columns FROM part
""")
def src_22_mappers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    made = nth(
        (
            '<insert id="q{}">INSERT INTO `TB_P` (x, y) VALUES (#{a}, #{b})</insert>',
            '<select id="q{}" resultType="x">SELECT a.C1, sum(b.n) AS total FROM TB_A a LEFT JOIN TB_B b <![CDATA[ ON a.i = b.i WHERE a.i < 9 ]]> <if test="n > 1">AND 1 = 1</if></select>',
            '<resultMap id="q{}" type="PartVO"><id property="id" column="ID"/><result property="name" column="NAME"/></resultMap>',
        ),
        F.col("p_partkey"),
    )
    body = F.array_join(F.collect_list(F.replace(made, F.lit("{}"), key)), "\n")
    g = table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit('<?xml version="1.0"?><mapper namespace="n">'), body, F.lit("</mapper>")).alias("text"))
    return P.read_mapper(g, "text", ["p_brand"]).select("p_brand", "kind", "id", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"))


# ---- markdown, YAML, JSON lines


def documents(spark: SparkSession, d: str) -> DataFrame:
    """A specification for each brand: a heading and a table of endpoints, then a heading and a table of columns."""
    key = F.col("p_partkey").cast("string")
    api = F.concat(F.lit("| "), nth(("get", "post"), F.col("p_partkey")), F.lit(" | "), F.when(F.col("p_size") % 9 == 0, "n/a").otherwise(F.concat(F.lit("/p/"), key)), F.lit(" | q: String, id (Long), z | "), "p_name", F.lit(" |\n"))
    col = F.concat(F.lit("| C"), key, F.lit(" | NUMBER | "), F.when(F.col("p_size") % 2 == 0, "Y").otherwise("N"), F.lit(" | "), F.when(F.col("p_size") % 3 == 0, "O").otherwise("X"), F.lit(" |\n"))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("m")))), lambda x: x["m"]), "")
    g = table(spark, d, "part").groupBy("p_brand").agg(lines(api).alias("a"), lines(col).alias("c"))
    name = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    return g.select("p_brand", F.concat(F.lit("# API\n\n| Method | URL | 파라미터 | 설명 |\n|---|---|---|---|\n"), "a", F.lit("\ntext | no table\n\n## TB_"), name, F.lit("\n\n| 컬럼명 | 데이터타입 | 필수 | PK |\n| --- | :-: | --- | --- |\n"), "c", F.lit("end\n")).alias("text"))


@query("""
SELECT p_brand, 0 AS table_no, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS row_no, CASE WHEN p_partkey % 2 = 0 THEN 'get' ELSE 'post' END || ',' || CASE WHEN p_size % 9 = 0 THEN 'n/a' ELSE '/p/' || CAST(p_partkey AS VARCHAR) END || ',q: String, id (Long), z,' || p_name AS cells FROM part
UNION ALL SELECT p_brand, 1, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER), 'C' || CAST(p_partkey AS VARCHAR) || ',NUMBER,' || CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END || ',' || CASE WHEN p_size % 3 = 0 THEN 'O' ELSE 'X' END FROM part
""")
def src_23_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    found = P.read_markdown_tables(documents(spark, d), "text", ["p_brand"])
    return found.select("p_brand", "table_no", "row_no", F.array_join("cells", ",").alias("cells"))


@query("""SELECT p_brand, 'B-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS condition, CAST(p_size AS VARCHAR) AS criteria, p_type AS outcome, '-' AS exception_ FROM part WHERE p_partkey < 1000 AND p_size % 7 <> 0""")
def src_24_rule_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rule tables; ids of four digits are none."""
    line = F.concat(F.lit("| "), F.when(F.col("p_size") % 7 == 0, "note").otherwise(F.concat(F.lit("B-"), F.col("p_partkey").cast("string"))), F.lit(" | "), "p_name", F.lit(" | "), "p_size", F.lit(" | "), "p_type", F.lit(" | - |\n"))
    g = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "").alias("m"))
    text = F.concat(F.lit("x\n| ID | condition (When) | criteria (If) | outcome (Then) | exception (Else) |\n|----|---|---|---|---|\n"), "m", F.lit("\n| B-1 | late | 1 | 2 | 3 |\n"))
    found = P.read_rules(g.select("p_brand", text.alias("text")), "text", ["p_brand"])
    return found.select("p_brand", "id", "condition", "criteria", "outcome", F.col("exception").alias("exception_"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """A provenance file for each brand: a marker for each part; those of size divisible by 5 are notes of another kind."""
    key = F.col("p_partkey").cast("string")
    item = F.concat(
        F.lit("  - marker: "), F.when(F.col("p_size") % 5 == 0, "NOTE").otherwise("DIVERGENCE"), F.lit("\n    ruleId: BL-"), key, F.when(F.col("p_size") % 2 == 0, "\n    severity: HIGH").otherwise(""),
        F.lit("\n    status: "), F.when(F.col("p_size") % 3 == 0, "RESOLVED").otherwise("OPEN"), F.lit("\n"),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("m")))), lambda x: x["m"]), "")
    g = table(spark, d, "part").groupBy("p_brand").agg(lines.alias("m"))
    return g.select("p_brand", F.concat(F.lit("version: 1\ndivergenceMarkers:\n"), "m", F.lit("generated: x\n  - marker: DIVERGENCE\n    ruleId: BL-0\n    status: OPEN\n")).alias("text"))


MARKERS_SQL = "SELECT p_brand, p_partkey, 'BL-' || CAST(p_partkey AS VARCHAR) AS rule_id, CASE WHEN p_size % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN p_size % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM part WHERE p_size % 5 <> 0"


@query(f"SELECT p_brand, rule_id, status, severity FROM ({MARKERS_SQL})")
def src_25_markers(spark: SparkSession, d: str) -> DataFrame:
    return P.read_markers(provenance(spark, d), "text", ["p_brand"]).select("p_brand", "rule_id", "status", "severity")


@query("SELECT event_type AS skill, count(*) AS n, max(event_id) AS last_ FROM events GROUP BY 1")
def src_26_usage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Usage records as lines of JSON, with lines that cannot be read among them, written and read as files."""
    e = table(spark, d, "events")
    lines = e.select(F.to_json(F.struct(F.col("event_id").alias("ts"), F.col("event_type").alias("skill"))).alias("value")).union(e.where("event_id % 100 = 0").select(F.lit('{"ts": 1, "sk')))
    return A.read_json_lines(A.written_text(lines), "ts long, skill string").groupBy("skill").agg(F.count("*").alias("n"), F.max("ts").alias("last_"))


@query("""
SELECT coalesce('skill ' || CAST(p.p_partkey AS VARCHAR), 'skill ' || CAST(o.p_partkey AS VARCHAR)) AS name, CASE WHEN o.p_partkey IS NOT NULL AND o.p_size % 3 = 0 THEN 'manual' ELSE 'a,' || p.p_type END AS tags, p.p_partkey IS NOT NULL AS present
FROM (SELECT * FROM part WHERE p_size % 2 = 0) p FULL JOIN (SELECT * FROM part WHERE p_size % 3 = 0) o ON o.p_partkey = p.p_partkey
""")
def src_27_catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """Heads of scanned files merged with the known catalogue: its manual tags stay, files that are gone are marked."""
    p = table(spark, d, "part")
    head = F.concat(F.lit("---\nname: skill "), F.col("p_partkey").cast("string"), F.lit("\ndescription: \""), "p_name", F.lit('"\ntags: [a, "'), "p_type", F.lit('"]\n---\n# body\ntags: [no]\n'))
    scanned = P.read_front_matter(p.where("p_size % 2 = 0").select(head.alias("text"), "p_partkey"), "text", ["p_partkey"])
    known = p.where("p_size % 3 = 0").select(F.concat(F.lit("skill "), F.col("p_partkey").cast("string")).alias("name"), F.array(F.lit("manual")).alias("manual_tags"))
    return A.merge_catalog(scanned, known).select("name", F.array_join("tags", ",").alias("tags"), "present")


# ---- sinks of artefacts


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def snk_01_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to a table in two writes: nothing is dropped, repeated rows stay."""
    e = table(spark, d, "events").select("event_id", "user_id")
    return A.appended([e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0")])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'none' END AS exception_ FROM orders")
def snk_09_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A table rebuilt with a new column: old rows are copied, in the new columns' order."""
    old = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return A.rebuilt(old, {"o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "exception_": F.when(F.col("o_orderstatus") == "P", "none")})


@query("""
SELECT p_brand, '{"openapi":"3.0.0","info":{"title":"' || p_brand || '"},"paths":[' || string_agg('{"path":"/p/' || CAST(p_partkey AS VARCHAR) || '","summary":"' || p_name || '"}', ',' ORDER BY p_partkey) || ']}' AS doc FROM part GROUP BY 1
""")
def snk_12_json_wrapper(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("position"), F.struct(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("summary")).alias("entry"))
    return A.wrapped(p, "p_brand")


@query(f"""
WITH m AS ({MARKERS_SQL}), n AS (SELECT DISTINCT b.p_brand, 'BL-' || CAST(p_partkey AS VARCHAR) AS rule_id FROM part p JOIN (SELECT DISTINCT p_brand FROM part) b ON b.p_brand = p.p_brand OR p_partkey % 8 = 0 AND b.p_brand = 'Brand#1' WHERE p_partkey % 4 = 0),
u AS (SELECT m.p_brand, m.rule_id, m.severity, CASE WHEN n.rule_id IS NOT NULL THEN 'RESOLVED' ELSE status END AS status FROM m LEFT JOIN n USING (p_brand, rule_id)
 UNION ALL SELECT n.p_brand, n.rule_id, 'LOW', 'OPEN' FROM n LEFT JOIN m USING (p_brand, rule_id) WHERE m.rule_id IS NULL)
SELECT p_brand, count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (status = 'OPEN') AS open_, count(*) FILTER (status = 'RESOLVED') AS resolved FROM u GROUP BY 1
""")
def snk_15_marker_summary(spark: SparkSession, d: str) -> DataFrame:
    """Markers set to resolved where a rule is given, appended where it has none, and counted again."""
    old = P.read_markers(provenance(spark, d), "text", ["p_brand"])
    p = table(spark, d, "part").where("p_partkey % 4 = 0").select("p_partkey", "p_brand", F.concat(F.lit("BL-"), F.col("p_partkey").cast("string")).alias("rule_id"))
    new = p.select("p_brand", "rule_id").union(p.where("p_partkey % 8 = 0").select(F.lit("Brand#1"), "rule_id"))  # one brand is told of others' rules too
    return A.marker_summary(A.update_markers(old, new, "p_brand"), "p_brand")


# ---- specifications out of documents


@query("""
SELECT p_brand, '/p/' || CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, p_name AS description, 'q:String,id:Long,z:' AS params FROM part WHERE p_size % 9 <> 0
""")
def mod_19_api_specs(spark: SparkSession, d: str) -> DataFrame:
    rows = P.read_markdown_tables(documents(spark, d), "text", ["p_brand"])
    found = A.api_specs(rows, ["p_brand"])
    return found.select("p_brand", "path", "method", "description", F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type"], F.lit("")))), ",").alias("params"))


@query("""
SELECT p_brand, 'TB_' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS tab, 'C' || CAST(p_partkey AS VARCHAR) AS col, 'NUMBER' AS type, p_size % 2 <> 0 AS nullable, p_size % 3 = 0 AS primary_ FROM part
""")
def mod_19_table_specs(spark: SparkSession, d: str) -> DataFrame:
    rows = P.read_markdown_tables(documents(spark, d), "text", ["p_brand"])
    return A.table_specs(rows, ["p_brand"]).select("p_brand", F.col("table").alias("tab"), F.col("column").alias("col"), "type", "nullable", F.col("primary").alias("primary_"))


@query("""
WITH c AS (SELECT 'TB_' || CAST(l_suppkey AS VARCHAR) AS tab, 'C' || CAST(l_linenumber AS VARCHAR) AS col, l_returnflag AS flag, (l_orderkey, l_partkey, l_quantity) AS p FROM lineitem)
SELECT tab, col, coalesce(max(CASE WHEN flag = 'A' THEN 'NUMBER' END), '') AS sql, bool_or(flag = 'R') AS primary_, CASE WHEN bool_or(flag = 'A') THEN 'ddl' WHEN bool_or(flag = 'R') OR bool_or(flag = 'N') THEN CASE WHEN min_by(flag, p) = 'R' THEN 'entity' ELSE 'mybatis' END END AS origin FROM c GROUP BY 1, 2
""")
def mod_18_source_tables(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of three kinds - DDL, data models and mappers, as JSON - decoded and merged: first type wins, any key counts, DDL origin first."""
    tab, col = F.concat(F.lit("TB_"), F.col("l_suppkey").cast("string")), F.concat(F.lit("C"), F.col("l_linenumber").cast("string"))
    body = (
        F.when(F.col("l_returnflag") == "A", F.to_json(F.struct(tab.alias("tableName"), F.array(F.struct(col.alias("name"), F.lit("NUMBER").alias("sqlType"), F.lit(False).alias("isPrimaryKey"))).alias("columns"))))
        .when(F.col("l_returnflag") == "R", F.to_json(F.struct(tab.alias("table"), F.lit("PartVO").alias("className"), F.array(F.struct(col.alias("column"), F.lit("Long").alias("javaType"), F.lit(True).alias("isId"))).alias("fields"))))
        .otherwise(F.to_json(F.struct(F.lit("n").alias("namespace"), F.array(F.struct(F.array(tab).alias("tables"), F.array(col).alias("columnNames"))).alias("queries"))))
    )
    kind = F.when(F.col("l_returnflag") == "A", "CodeDdl").when(F.col("l_returnflag") == "R", "CodeDataModel").otherwise("CodeMapper")
    chunks = table(spark, d, "lineitem").select(kind.alias("type"), body.alias("text"), F.struct("l_orderkey", "l_partkey", "l_quantity").alias("position"))
    return A.source_tables(chunks).select(F.col("table").alias("tab"), F.col("column").alias("col"), F.coalesce("sql", F.lit("")).alias("sql"), F.col("primary").alias("primary_"), "origin")


# ---- stored tables: only the files that a change or a page needs


def stored_events(spark: SparkSession, d: str, keys: list[str]) -> B.BucketedTable:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return B.BucketedTable.create(e, A.new_path(spark, "events"), keys, buckets=16)


@query("""
SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE value END AS value FROM events WHERE event_id <> 21
UNION ALL SELECT -event_id, user_id, 'new', value FROM events WHERE event_id % 7 = 1
""")
def snk_03_stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh event replaced twice - the last counts -, some new ones put beside, one deleted."""
    t = stored_events(spark, d, ["event_id"])
    old = t.read()
    change = old.where("event_id % 7 = 0").withColumn("value", F.explode(F.array(F.lit(-9.0), F.lit(-1.0))))
    new = old.where("event_id % 7 = 1").select((-F.col("event_id")).alias("event_id"), "user_id", F.lit("new").alias("event_type"), "value")
    t = t.upsert(change.unionByName(new), F.col("value")).delete(spark.range(21, 22).select(F.col("id").alias("event_id")))
    return B.BucketedTable.open(spark, t.path).read()


@query("""
SELECT event_id, user_id, CASE WHEN event_id < 40 AND event_type = 'view' THEN 'seen' ELSE event_type END AS event_type, CASE WHEN event_id < 40 AND event_type = 'view' THEN value + event_id % 5 ELSE value END AS value FROM events
""")
def snk_06_stored_update(spark: SparkSession, d: str) -> DataFrame:
    """Events of a list of ids set and counted up, where they are views still."""
    ids = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("more"))
    t = stored_events(spark, d, ["event_id"]).update(ids, {"event_type": F.lit("seen"), "value": F.col("value") + F.col("more")}, F.col("event_type") == "view")
    return t.read()


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def snk_07_stored_dedup(spark: SparkSession, d: str) -> DataFrame:
    return stored_events(spark, d, ["user_id", "event_type"]).deduplicate(F.col("event_id")).read().select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 1000")
def srt_04_stored_page(spark: SparkSession, d: str) -> DataFrame:
    """A page by offset out of a sorted table: the files before it are counted, not read."""
    o = table(spark, d, "orders").select("o_totalprice", "o_orderkey")
    return B.SortedTable.create(o, A.new_path(spark, "orders"), ["o_totalprice", "o_orderkey"], files=12).page(50, 1000)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 31")
def srt_05_stored_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The page before a time, and one row more."""
    from datetime import datetime

    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderkey")
    return B.SortedTable.create(o, A.new_path(spark, "orders"), ["o_orderdate", "o_orderkey"], files=12).before((datetime(1997, 1, 1),), 30)
