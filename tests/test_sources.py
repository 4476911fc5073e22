"""Parsers of source artefacts on what files hold besides the plain cases."""

from __future__ import annotations

import pytest

from oreline.operators import sources as A
from oreline.sources import parsers as P

PARSERS = [P.markdown_tables, P.rule_table, P.markers, P.front_matter, P.ddl_columns, P.schema_parts, P.mapper_parts, P.controller_endpoints, P.model_fields, P.service_methods]


@pytest.mark.parametrize("parse", PARSERS)
@pytest.mark.parametrize("text", ["", " ", "\n\n", "|", "---", "CREATE TABLE", "create table t", "create table t (", "<select id='a'>", "@GetMapping", "@GetMapping(", "class A", "class A {", "@Service class A { public void", "divergenceMarkers:\n  -", "||||\n|--|\n|", "'", '"(', "@", "x" * 10_000])
def test_broken_texts_give_no_rows_or_few(parse, text):
    assert len(parse(text)) <= 1


def test_ddl():
    text = """-- CREATE TABLE no (a int);
    /* create table no2 (a int); */
    CREATE TABLE `shop`.t (
      id BIGINT(20) NOT NULL AUTO_INCREMENT COMMENT 'it''s, the (id)', amount DECIMAL(10,2) NOT NULL DEFAULT '0.0',
      owner INT REFERENCES people (pid), note varchar(20) DEFAULT NULL, UNIQUE KEY u (note), CHECK (amount > 0),
      PRIMARY KEY (`id`, owner), CONSTRAINT f FOREIGN KEY (note) REFERENCES notes(code)
    ); DROP TABLE x; create table "u" (a text primary key)"""
    got = [(c["table"], c["column"], c["type"], c["nullable"], c["primary"], c["default_value"], c["references"]) for c in P.ddl_columns(text)]
    assert got == [
        ("shop.t", "id", "BIGINT(20)", False, True, None, None), ("shop.t", "amount", "DECIMAL(10,2)", False, False, "0.0", None), ("shop.t", "owner", "INT", True, True, None, "people.pid"),
        ("shop.t", "note", "varchar(20)", True, False, "NULL", "notes.code"), ("u", "a", "text", True, True, None, None),
    ]
    assert {(p["kind"], p["name"]) for p in P.schema_parts("create table a (x int); create index i on a (x); create index j on b (y)")} == {("entity", "a"), ("index", "a"), ("warning", "b")}


def test_controller_details():
    text = '''import x; // @RestController in a comment
@RestController
@RequestMapping({"/a", "/b"})
public class C extends Base<T> {
  private final Map<String, List<Long>> m = new HashMap<>();
  @Operation(summary = "say ) it")
  @GetMapping
  public List<Map<String, Integer>> all() { return null; }
  @PatchMapping(value = "/{id}", produces = "x(y)")
  protected void one(@PathVariable("id") final Long id, @RequestParam(value = "q", required = false) Map<String, List<Long>> q, HttpServletRequest r) {}
  @RequestMapping(method = {RequestMethod.PUT, RequestMethod.POST}, path = "x") int two() { return 1; }
  public void none() {}
}'''
    got = P.controller_endpoints(text)
    assert [(e["methods"], e["path"], e["method_name"], e["return_type"]) for e in got] == [(["GET"], "/a", "all", "List<Map<String, Integer>>"), (["PATCH"], "/a/{id}", "one", "void"), (["PUT", "POST"], "/a/x", "two", "int")]
    assert got[0]["summary"] == "say ) it"
    assert [(p["name"], p["type"], p["required"], p["annotation"]) for p in got[1]["params"]] == [("id", "Long", True, "@PathVariable"), ("q", "Map<String, List<Long>>", False, "@RequestParam"), ("r", "HttpServletRequest", True, None)]
    assert P.controller_endpoints(text.replace("@RestController", "@Service")) == []


def test_models_and_services():
    model = '@Entity\n@Table(name = "T", schema = "s")\nclass V { @Id @GeneratedValue(strategy = X) private Long id; @Column(nullable = false) String b = "a;b"; static int n; void f(int a) { int c; } private final int d; }'
    assert [(f["table"], f["field"], f["primary"], f["nullable"]) for f in P.model_fields(model)] == [("T", "id", True, False), ("T", "b", False, False), ("T", "d", False, True)]
    service = "@Component @Transactional public class S { public S() {} public int a(int x) { if (x > 1) { b(); } return 1; } @Transactional(readOnly=true) public void b() {} private void c() {} }"
    assert [(m["method_name"], m["transactional"], m["read_only"]) for m in P.service_methods(service)] == [("a", True, False), ("b", True, True)]


def test_null_texts_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "create table t (a int)"), (2, "create table t (a int)"), (3, "")], "id int, text string")
    assert sorted(r["id"] for r in P.read_ddl(df, "text", ["id"]).collect()) == [2, 2]
    assert P.read_ddl(df.where("false"), "text", ["id"]).count() == 0


def test_specifications_without_their_columns(spark):
    text = "## TB_ONE\n\n| Name | Note |\n|---|---|\n| a | b |\n\n| 컬럼명 | NULL |\n|---|---|\n| C1 | Y |\n| | N |\n\n| URL |\n|---|\n| /a |\n| nothing |\n"
    rows = P.read_markdown_tables(spark.createDataFrame([(1, text)], "id int, text string"), "text", ["id"])
    assert [(r["path"], r["method"], r["params"]) for r in A.api_specs(rows, ["id"]).collect()] == [("/a", None, None)]
    assert [(r["table"], r["column"], r["type"], r["nullable"], r["primary"]) for r in A.table_specs(rows, ["id"]).collect()] == [("TB_ONE", "C1", None, True, None)]


def test_page_chunks_at_their_edges(spark):
    df = spark.createDataFrame([(1, 20, 10), (2, 21, 10), (3, 5, 6 * 2**20), (4, 0, 0)], "id int, pages int, size int")
    got = {}
    for r in P.page_chunks(df, "pages", "size").collect():
        got.setdefault(r["id"], []).append((r["first_page"], r["last_page"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 20)], 2: [(1, 10), (11, 20), (21, 21)], 3: [(1, 5)], 4: [(1, 0)]}
    assert [P.smaller_chunk(n) for n in (10, 5, 4, 3, 2)] == [5, 3, 3, None, None]


def test_markers_are_updated_and_counted(spark):
    old = spark.createDataFrame([("a", "r1", "OPEN", "HIGH"), ("a", "r2", "RESOLVED", "LOW")], "k string, rule_id string, status string, severity string")
    new = spark.createDataFrame([("a", "r1"), ("b", "r9")], "k string, rule_id string")
    found = A.update_markers(old, new, "k")
    assert {(r["k"], r["rule_id"], r["status"], r["severity"]) for r in found.collect()} == {("a", "r1", "RESOLVED", "HIGH"), ("a", "r2", "RESOLVED", "LOW"), ("b", "r9", "OPEN", "LOW")}
    assert {tuple(r) for r in A.marker_summary(found, "k").collect()} == {("a", 2, 1, 0, 1, 0, 2), ("b", 1, 0, 0, 1, 1, 0)}


def test_json_lines_with_bad_ones(spark):
    lines = spark.createDataFrame([('{"ts": 1, "skill": "a"}',), ("{",), ("",), ('{"skill": "b"}',)], "value string")
    assert sorted((r["ts"] or 0, r["skill"]) for r in A.read_json_lines(lines, "ts long, skill string").collect() if r["skill"]) == [(0, "b"), (1, "a")]


def test_catalog_keeps_what_is_gone(spark):
    scanned = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "name string, tags array<string>")
    known = spark.createDataFrame([("b", ["mine"]), ("c", ["old"])], "name string, manual_tags array<string>")
    got = {r["name"]: (r["tags"], r["present"]) for r in A.merge_catalog(scanned, known).collect()}
    assert got == {"a": (["x"], True), "b": (["mine"], True), "c": (["old"], False)}
