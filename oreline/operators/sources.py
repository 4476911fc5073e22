"""Source projects, catalogues, markers and document specifications as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import specs as S
from ..functions.text import rounded
from ..sources import parsers as P
from .gaps import merge_table_columns
from .lineage import shared_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def project_summary(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """A row for each project: files by type, elements found in them, and the share of files that were read.

    ``files``: project, type (java, sql, xml), content; ``skipped``: project, skipped (files left out).
    """
    java, sql, xml = (files.where(F.col("type") == t).select("project", "content") for t in ("java", "sql", "xml"))
    key = ["project"]
    n = lambda df, what, name: df.groupBy("project").agg(what.alias(name))
    read = P.read_controllers(java, "content", key)
    parts = [
        n(files, F.count("*"), "files"),
        n(java, F.count("*"), "java_files"),
        n(sql, F.count("*"), "sql_files"),
        n(read, F.count("*"), "endpoints"),
        n(P.parsed(java, "content", key, lambda t: [{"c": 1}] if P.controller_endpoints(t) else [], "c int"), F.count("*"), "controllers"),
        n(P.read_ddl(sql, "content", key).select("project", "table").distinct(), F.count("*"), "tables"),
        n(P.parsed(xml, "content", key, lambda t: [{"c": 1}] if P.mapper_parts(t) else [], "c int"), F.count("*"), "mappers"),
        skipped,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "project", "left")
    out = out.fillna(0)
    return out.withColumn("rate", F.when(F.col("files") + F.col("skipped") > 0, rounded(F.col("files") / (F.col("files") + F.col("skipped")), 2)).otherwise(1.0))


def written_text(lines: DataFrame) -> DataFrame:
    """Lines (value) written as text files and read back."""
    path = new_path(lines.sparkSession, "lines")
    lines.write.text(path)
    return lines.sparkSession.read.text(path)


def read_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of JSON lines; lines that cannot be read are left out."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r")).where("r._bad is null and r is not null").select("r.*").drop("_bad")


def merge_catalog(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned entries (name, tags) with the catalogue's (name, manual_tags): manual tags go first, gone entries stay, marked."""
    j = scanned.withColumn("_here", F.lit(True)).join(known, "name", "full")
    return j.withColumn("tags", F.coalesce("manual_tags", "tags")).withColumn("present", F.col("_here").isNotNull()).drop("_here", "manual_tags")


def appended(parts: list[DataFrame]) -> DataFrame:
    """Tables of equal columns, appended one after the other to a table of files."""
    spark = parts[0].sparkSession
    path = new_path(spark, "table")
    for p in parts:
        p.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def rebuilt(old: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A table copied into one of the given columns."""
    path = new_path(old.sparkSession, "rebuilt")
    old.select(*(c.alias(n) for n, c in columns.items())).write.parquet(path)
    return old.sparkSession.read.parquet(path)


def wrapped(entries: DataFrame, key: str) -> DataFrame:
    """An OpenAPI document for each key as JSON. ``entries``: key, position, entry (struct)."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"])
    g = entries.groupBy(key).agg(paths.alias("paths"))
    return g.select(key, F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), F.struct(F.col(key).alias("title")).alias("info"), "paths")).alias("doc"))


def update_markers(markers: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Markers (key, rule_id, status, severity) with those of ``resolved`` (key, rule_id) set to RESOLVED; rules without one are appended as OPEN and LOW."""
    new = resolved.select(key, "rule_id", F.lit(True).alias("_new")).distinct()
    j = markers.withColumn("_had", F.lit(True)).join(new, [key, "rule_id"], "full")
    status = F.when(F.col("_had").isNull(), "OPEN").when(F.col("_new"), "RESOLVED").otherwise(F.col("status"))
    return j.select(key, "rule_id", status.alias("status"), F.when(F.col("_had"), F.col("severity")).otherwise("LOW").alias("severity"))


def marker_summary(markers: DataFrame, key: str) -> DataFrame:
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    return markers.groupBy(key).agg(F.count("*").alias("total"), n("severity", "HIGH").alias("high"), n("severity", "MEDIUM").alias("medium"), n("severity", "LOW").alias("low"), n("status", "OPEN").alias("open_"), n("status", "RESOLVED").alias("resolved"))


#: What the headers of specification tables hold, by keyword.
API_HEADERS = {
    "path": ("URL", "경로", "URI", "Path", "Endpoint", "엔드포인트"),
    "method": ("Method", "메소드", "HTTP", "방식"),
    "interface": ("인터페이스ID", "API ID", "IF-ID", "I/F ID"),
    "description": ("설명", "비고", "Description", "인터페이스명"),
    "parameters": ("파라미터", "Parameter", "입력", "Input"),
}
TABLE_HEADERS = {
    "column": ("컬럼명", "Column", "필드명", "Field", "영문명", "영문"),
    "type": ("데이터타입", "Type", "타입", "DataType", "자료형"),
    "nullable": ("NULL", "Nullable", "필수", "NOT NULL"),
    "primary": ("PK", "Primary", "기본키"),
    "description": ("설명", "비고", "한글명", "Description"),
    "table": ("테이블명", "Table Name", "TABLE", "테이블"),
}


def role_of(keywords: tuple[str, ...]) -> Column:
    """Number of the first header that holds a keyword, without case; 0 if none does."""
    holds = lambda h: F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.lower(h).contains(k))
    return F.coalesce(F.array_position(F.transform("headers", holds), True), F.lit(0)).cast("int")


def cell_of(role: Column) -> Column:
    """The row's cell in that column; null if it is blank or absent."""
    cell = F.when(role > 0, F.get("cells", role - 1))
    return F.when(F.trim(cell) != "", F.trim(cell))


def api_specs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Endpoints of markdown tables that have a path column. ``rows``: see read_markdown_tables."""
    c = {k: cell_of(role_of(v)) for k, v in API_HEADERS.items()}
    found = rows.where(role_of(API_HEADERS["path"]) > 0).select(*keys, c["path"].alias("path"), F.upper(c["method"]).alias("method"), c["interface"].alias("interface_id"), c["description"].alias("description"), c["parameters"].alias("p"))
    found = found.where(F.col("path").startswith("/") | F.col("path").startswith("http"))
    parts = F.filter(F.transform(F.split("p", r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    named, typed = r"^(\w+)\s*[:：]\s*(.+)$", r"^(\w+)\s*\(([^)]+)\)$"

    def parameter(x: Column) -> Column:
        pick = lambda g: F.when(x.rlike(named), F.regexp_extract(x, named, g)).when(x.rlike(typed), F.regexp_extract(x, typed, g))
        return F.struct(F.coalesce(pick(1), x).alias("name"), pick(2).alias("type"))

    return found.withColumn("params", F.transform(parts, parameter)).drop("p")


def table_specs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of markdown tables that define a database table, whose name a column or the last heading before it gives."""
    role = {k: role_of(v) for k, v in TABLE_HEADERS.items()}
    c = {k: cell_of(v) for k, v in role.items()}
    heading = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("context", F.lit(r"(?im)^#{1,6}[^\n]*?\b(TB?_\w+)"), F.lit(1))), -1)
    name = F.coalesce(c["table"], F.when(heading != "", heading), F.lit("UNKNOWN"))
    head = F.when(role["nullable"] > 0, F.get("headers", role["nullable"] - 1))
    found = rows.where(role["column"] > 0).select(*keys, "table_no", "row_no", name.alias("table"), c["column"].alias("column"), c["type"].alias("type"), S.nullable(c["nullable"], head).alias("nullable"), S.says_yes(c["primary"]).alias("primary"), c["description"].alias("description"))
    return found.where("column is not null")


def source_tables(chunks: DataFrame) -> DataFrame:
    """Tables of a source project's chunks, merged by table and column: see merge_table_columns.

    ``chunks``: type (CodeDdl, CodeDataModel, CodeMapper; others are left out), text (JSON), position.
    Data models tell which of their columns are keys; mappers only name tables and columns.
    """
    of = lambda kind, schema: chunks.where(F.col("type") == kind).select("position", F.from_json("text", schema).alias("j"))
    none = F.lit(None).cast("string")
    ddl = of("CodeDdl", "tableName string, columns array<struct<name:string,sqlType:string,isPrimaryKey:boolean>>").select("position", F.col("j.tableName").alias("table"), F.explode("j.columns").alias("c"))
    model = of("CodeDataModel", "table string, className string, fields array<struct<column:string,javaType:string,isId:boolean>>").select("position", F.col("j.table").alias("table"), F.explode("j.fields").alias("c"))
    mapper = of("CodeMapper", "namespace string, queries array<struct<tables:array<string>,columnNames:array<string>>>").select("position", F.explode("j.queries").alias("q"))
    columns = (
        ddl.select("position", "table", F.col("c.name").alias("column"), F.col("c.sqlType").alias("sql"), F.col("c.isPrimaryKey").alias("primary"), F.lit("ddl").alias("origin"))
        .unionByName(model.select("position", "table", F.col("c.column").alias("column"), none.alias("sql"), F.col("c.isId").alias("primary"), F.lit("entity").alias("origin")))
        .unionByName(mapper.select("position", F.get("q.tables", F.lit(0)).alias("table"), F.explode("q.columnNames").alias("column"), none.alias("sql"), F.lit(False).alias("primary"), F.lit("mybatis").alias("origin")))
    )
    return merge_table_columns(columns)
