"""Parsers of source artefacts: markdown tables, rule tables, markers, DDL, mapper files, Java classes.

Texts come as rows; Spark spreads them over tasks. What regular expressions can say
is a Column expression; what needs a scan with state is a small pandas helper whose
results are exploded into rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SENT = 10_000  # rows that a parser sends on at once


def parsed(df: DataFrame, text: str, keys: list[str], parse: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """A row for each dict that ``parse`` gives for a text, after the key columns; null texts give none."""

    def framed(pdf: pd.DataFrame, found: list[tuple[int, dict]]) -> pd.DataFrame:
        out = pd.DataFrame([r for _, r in found], columns=names)
        for k in keys:
            out[k] = pdf[k].to_numpy()[[i for i, _ in found]] if found else pd.Series(dtype=pdf[k].dtype)
        return out[[*keys, *names]]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ((i, r) for i, t in enumerate(pdf[text]) if t is not None for r in parse(t))
            while True:
                some = list(islice(found, SENT))
                yield framed(pdf, some)
                if len(some) < SENT:
                    break

    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInPandas(rows, f"{kinds}, {schema}")


# ---- markdown


def cells_of(line: str) -> list[str]:
    return [c.strip() for c in line.strip().split("|")[1:-1]]


RULER = re.compile(r"^\s*\|[\s:|-]+\|\s*$")


def markdown_tables(text: str) -> list[dict]:
    """Rows of every markdown table: table number, row number, headers, cells, up to 500 characters before it."""
    out, lines, table, at = [], text.split("\n"), 0, 0
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    while at + 2 < len(lines):
        head = cells_of(lines[at])
        if head and RULER.match(lines[at + 1]):
            row = at + 2
            while row < len(lines) and lines[row].lstrip().startswith("|"):
                out.append({"table_no": table, "row_no": row - at - 2, "headers": head, "cells": cells_of(lines[row]), "context": text[max(0, starts[at] - 500) : starts[at]]})
                row += 1
            table += row > at + 2
            at = row
        else:
            at += 1
    return out


def read_markdown_tables(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, markdown_tables, "table_no int, row_no int, headers array<string>, cells array<string>, context string")


RULE_HEAD = re.compile(r"\|\s*ID\s*\|\s*condition[^|]*\|\s*criteria[^|]*\|\s*outcome[^|]*\|\s*exception[^|]*\|", re.I)


def rule_table(text: str, rule_id: str = r"^[A-Z]{1,2}-[A-Z]?\d{1,3}$") -> list[dict]:
    """Rules of the first five-column rule table; a blank or short line ends it, rows without a rule id are skipped."""
    lines = iter(re.split(r"\r?\n", text))
    for line in lines:
        if RULE_HEAD.search(line) and RULER.match(next(lines, "")):
            break
    else:
        return []
    out = []
    for line in lines:
        cells = cells_of(line) if line.strip().startswith("|") and line.strip().endswith("|") else []
        if len(cells) < 5:
            break
        if re.match(rule_id, cells[0]):
            out.append(dict(zip(("id", "condition", "criteria", "outcome", "exception"), cells, strict=False)))
    return out


def read_rules(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, rule_table, "id string, condition string, criteria string, outcome string, exception string")


def markers(text: str) -> list[dict]:
    """Divergence markers of a provenance file, line by line: position, rule_id, status, severity (MEDIUM if unstated).

    They stand as list items below the key divergenceMarkers, which the next key without
    indent ends; items without a rule or with another status than OPEN or RESOLVED are left out.
    """
    found: list[dict] = []
    inside = False
    for line in text.split("\n"):
        body = line.strip()
        if line[:1].isalpha():
            inside = body.startswith("divergenceMarkers:")
        elif inside and body.startswith("-"):
            found.append({"kind": body[1:].partition(":")[2].strip()} if body[1:].strip().startswith("marker:") else {})
        elif inside and found and ":" in body:
            key, _, value = body.partition(":")
            found[-1].setdefault(key.strip(), value.strip())
    kept = [m for m in found if m.get("kind") == "DIVERGENCE" and m.get("ruleId") and m.get("status", "").split()[:1] in (["OPEN"], ["RESOLVED"])]
    return [{"position": i, "rule_id": m["ruleId"].split()[0], "status": m["status"].split()[0], "severity": (m.get("severity") or "MEDIUM").split()[0]} for i, m in enumerate(kept)]


def read_markers(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Divergence markers of YAML texts, in order."""
    return parsed(df, text, keys, markers, "position int, rule_id string, status string, severity string")


def front_matter(text: str) -> list[dict]:
    """Head of a catalogue file - lines between two rulers - as name, description, category and tags."""
    lines = text.split("\n")
    if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        return []
    head = {}
    for line in lines[1:]:
        if line.strip() == "---":
            break
        key, colon, value = line.partition(":")
        if colon:
            head[key.strip()] = value.strip().strip("\"'")
    tags = [t.strip().strip("\"'") for t in head.get("tags", "").strip("[]").split(",")]
    return [{"name": head.get("name"), "description": head.get("description"), "category": head.get("category"), "tags": [t for t in tags if t]}]


def read_front_matter(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, front_matter, "name string, description string, category string, tags array<string>")


# ---- SQL

TOKEN = re.compile(r"`[^`]*`|\"[^\"]*\"|'(?:[^']|'')*'|[^\W]+(?:\.\w+)*|\S")
COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
#: First words of table parts that define no column.
TABLE_WORDS = ("PRIMARY", "FOREIGN", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "CHECK")


def sql_tokens(text: str) -> list[str]:
    """Names, strings, numbers and single signs of SQL without its comments."""
    return TOKEN.findall(COMMENT.sub(" ", text))


def bare(token: str) -> str:
    return token.strip("`\"'")


def bracketed(tokens: list[str], at: int) -> tuple[list[list[str]], int]:
    """Parts between commas of the bracket that opens at ``at``, and the place after its end."""
    parts: list[list[str]] = [[]]
    depth = 0
    for i in range(at, len(tokens)):
        t = tokens[i]
        depth += (t == "(") - (t == ")")
        if depth == 0:
            return [p for p in parts if p], i + 1
        if t == "," and depth == 1:
            parts.append([])
        elif i > at:
            parts[-1].append(t)
    return [p for p in parts if p], len(tokens)


def after(tokens: list[str], *words: str) -> int:
    """Place behind the first run of ``words`` (without case), or -1."""
    upper = [t.upper() for t in tokens]
    for i in range(len(tokens) - len(words) + 1):
        if upper[i : i + len(words)] == list(words):
            return i + len(words)
    return -1


def names_in(tokens: list[str], at: int) -> list[str]:
    parts, _ = bracketed(tokens, at)
    return [bare(p[0]) for p in parts]


def reference(tokens: list[str]) -> tuple[str, list[str]] | None:
    """Table and columns that a part refers to."""
    at = after(tokens, "REFERENCES")
    if at < 0 or at >= len(tokens):
        return None
    more = names_in(tokens, at + 1) if tokens[at + 1 : at + 2] == ["("] else []
    return bare(tokens[at]), more


def statements(text: str) -> Iterator[list[str]]:
    """Token lists of the statements of a script."""
    out: list[str] = []
    for t in sql_tokens(text):
        if t == ";":
            yield out
            out = []
        else:
            out.append(t)
    yield out


def one_column(part: list[str], keys: set[str], links: dict[str, str]) -> dict | None:
    """A column definition: name, type with its size, and what follows."""
    if len(part) < 2 or part[0].upper() in TABLE_WORDS:
        return None
    name, kind, rest = bare(part[0]), part[1], part[2:]
    if rest[:1] == ["("]:
        sizes, end = bracketed(rest, 0)
        kind += "(" + ",".join("".join(x) for x in sizes) + ")"
        rest = rest[end:]
    default, comment, link = after(rest, "DEFAULT"), after(rest, "COMMENT"), reference(rest)
    value = lambda at: bare(rest[at]) if 0 <= at < len(rest) else None
    primary = name in keys or after(rest, "PRIMARY", "KEY") >= 0
    return {
        "column": name, "type": kind, "nullable": after(rest, "NOT", "NULL") < 0, "primary": primary, "default_value": value(default), "comment": value(comment),
        "references": f"{link[0]}.{link[1][0] if link[1] else 'id'}" if link else links.get(name),
    }


def ddl_columns(text: str) -> list[dict]:
    """Columns of CREATE TABLE statements; parts are split at commas outside brackets."""
    out = []
    for tokens in statements(text):
        at = after(tokens, "CREATE", "TABLE")
        if at < 0:
            continue
        at = after(tokens, "IF", "NOT", "EXISTS") if tokens[at : at + 1] and tokens[at].upper() == "IF" else at
        open_ = next((i for i in range(max(at, 0), len(tokens)) if tokens[i] == "("), -1)
        if at < 0 or open_ <= at:
            continue
        name, (parts, _) = "".join(map(bare, tokens[at:open_])), bracketed(tokens, open_)
        keys, links = set(), {}
        for p in parts:
            if p[0].upper() in TABLE_WORDS:
                key, link = after(p, "PRIMARY", "KEY"), reference(p)
                keys |= set(names_in(p, key)) if key >= 0 else set()
                own = after(p, "FOREIGN", "KEY")
                if own >= 0 and link:
                    links |= {a: f"{link[0]}.{b}" for a, b in zip(names_in(p, own), link[1], strict=False)}
        out += [{"table": name, **c} for p in parts if (c := one_column(p, keys, links))]
    return out


def read_ddl(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, ddl_columns, "table string, column string, type string, nullable boolean, primary boolean, default_value string, comment string, references string")


def schema_parts(text: str) -> list[dict]:
    """Entities, relations and indexes of a script, and warnings of what could not be read.

    kind is entity (name: table, detail: its columns), relation (name: table.column,
    detail: what it refers to), index (name: table, detail: columns) or warning.
    """
    out = []
    columns = ddl_columns(text)
    for table in dict.fromkeys(c["table"] for c in columns):
        own = [c for c in columns if c["table"] == table]
        out.append({"kind": "entity", "name": table, "detail": ",".join(c["column"] + ("*" if c["primary"] else "") for c in own)})
        out += [{"kind": "relation", "name": f"{table}.{c['column']}", "detail": c["references"]} for c in own if c["references"]]
    known = {c["table"] for c in columns}
    for tokens in statements(text):
        at = after(tokens, "ON")
        upper = [t.upper() for t in tokens[:3]]
        if upper[:1] == ["CREATE"] and "INDEX" in upper and at > 0:
            name = bare(tokens[at])
            out.append({"kind": "index" if name in known else "warning", "name": name, "detail": ",".join(names_in(tokens, at + 1))})
    return out


def read_schema(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, schema_parts, "kind string, name string, detail string")


# ---- mapper files

TAG = re.compile(r"<(/?)([A-Za-z]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
STATEMENTS = ("select", "insert", "update", "delete")
NAMED_BEFORE = ("FROM", "INTO", "UPDATE", "JOIN")


def attributes(text: str) -> dict[str, str]:
    return {k: v for k, _, v in re.findall(r"(\w+)\s*=\s*([\"'])(.*?)\2", text)}


def sql_tables(sql: str) -> list[str]:
    """Names after FROM, INTO, UPDATE and JOIN, each once."""
    tokens = sql_tokens(sql)
    found = [bare(b) for a, b in zip(tokens, tokens[1:], strict=False) if a.upper() in NAMED_BEFORE and re.match(r"[`\"\w]", b)]
    return list(dict.fromkeys(found))


def sql_columns(sql: str, kind: str) -> list[str]:
    """Columns that a select names before FROM (its aliases, if any) or that an insert fills."""
    tokens = sql_tokens(sql)
    if kind == "insert":
        at = after(tokens, "INTO")
        return names_in(tokens, at + 1) if at >= 0 and tokens[at + 1 : at + 2] == ["("] else []
    if kind != "select":
        return []
    a, b = after(tokens, "SELECT"), after(tokens, "FROM")
    parts, _ = bracketed(["(", *tokens[a : b - 1 if b > 0 else None], ")"], 0)
    return [bare(p[-1]).split(".")[-1] for p in parts if re.match(r"[`\"\w]", p[-1])]


def mapper_parts(text: str) -> list[dict]:
    """Statements and result maps of a mapper file: kind, id, SQL without tags, tables and columns it names."""
    out: list[dict] = []
    plain = text.replace("<![CDATA[", "").replace("]]>", "")
    open_: tuple[str, dict, int] | None = None
    for m in TAG.finditer(plain):
        closing, name, rest = m[1], m[2], m[3]
        if open_ is None and not closing and name in (*STATEMENTS, "resultMap") and "id" in attributes(rest):
            open_ = name, attributes(rest), m.end()
        elif open_ and closing and name == open_[0]:
            body = plain[open_[2] : m.start()]
            if name == "resultMap":
                fields = [attributes(t[3]) for t in TAG.finditer(body)]
                out.append({"kind": "resultMap", "id": open_[1]["id"], "sql": open_[1].get("type"), "tables": [], "columns": [f["column"] for f in fields if "column" in f]})
            else:
                sql = TAG.sub("", body)
                out.append({"kind": name, "id": open_[1]["id"], "sql": sql.strip(), "tables": sql_tables(sql), "columns": sql_columns(sql, name)})
            open_ = None
    return out


def read_mapper(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, mapper_parts, "kind string, id string, sql string, tables array<string>, columns array<string>")


# ---- Java


def split_top(text: str, opening: str = "(<[", closing: str = ")>]") -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in opening) - (ch in closing)
        if ch == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def balanced(text: str, at: int) -> str:
    """What stands between the parenthesis at ``at`` and its partner, whatever strings hold."""
    depth, quoted = 0, ""
    for i in range(at, len(text)):
        ch = text[i]
        if quoted:
            quoted = "" if ch == quoted and text[i - 1] != "\\" else quoted
        elif ch in "\"'":
            quoted = ch
        else:
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                return text[at + 1 : i]
    return ""


def annotation_at(text: str, at: int) -> tuple[str, str, int] | None:
    """Name, arguments and end of the annotation that begins at ``at``."""
    name = re.compile(r"@(\w+)\s*").match(text, at)
    if not name:
        return None
    if text[name.end() : name.end() + 1] != "(":
        return name[1], "", name.end()
    inside = balanced(text, name.end())
    return name[1], inside, name.end() + len(inside) + 2


def annotations(text: str, at: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The annotations in a row from ``at`` on, and where they end."""
    out = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        found = annotation_at(text, at)
        if not found:
            return out, at
        out.append(found[:2])
        at = found[2]


#: Methods of mapping annotations.
VERBS = {"GetMapping": ["GET"], "PostMapping": ["POST"], "PutMapping": ["PUT"], "DeleteMapping": ["DELETE"], "PatchMapping": ["PATCH"], "RequestMapping": []}
#: Annotations that say where a parameter comes from.
PARAMETER_NOTES = ("RequestParam", "PathVariable", "RequestBody", "RequestHeader", "ModelAttribute")
MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized", "default")
CLASS = re.compile(r"\bclass\s+(\w+)")


def strings_in(text: str) -> list[str]:
    return [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", text)]


def mapping_path(arguments: str) -> str:
    """The first path of a mapping annotation: of value or path, a list, or the first string."""
    named = dict(p.split("=", 1) for p in split_top(arguments, "({[", ")}]") if re.match(r"\w+\s*=", p))
    chosen = next((v for k, v in named.items() if k.strip() in ("value", "path")), arguments if not named else "")
    return next(iter(strings_in(chosen)), "")


def parameters(text: str) -> list[dict]:
    out = []
    for part in split_top(text, "<({[", ">)}]"):
        notes, at = annotations(part)
        words = [w for w in part[at:].split() if w not in MODIFIERS]
        note = next(((n, a) for n, a in notes if n in PARAMETER_NOTES), None)
        if words:
            free = note is not None and (note[0] == "RequestBody" or "false" in [v.strip() for v in re.findall(r"required\s*=\s*(\w+)", note[1])])
            out.append({"name": words[-1], "type": " ".join(words[:-1]) or "Object", "required": not free, "annotation": note and "@" + note[0]})
    return out


def signature(text: str, at: int) -> tuple[str, str, int] | None:
    """Return type, name and place of the opening bracket of the method that begins at ``at``."""
    _, at = annotations(text, at)
    mark = re.compile(r"[({;]").search(text, at)  # the first of them: the others may be missing up to the text's end
    if not mark or mark[0] != "(":
        return None
    end = mark.start()
    words = [w for w in text[at:end].split() if w not in MODIFIERS]
    return (" ".join(words[:-1]), words[-1], end) if len(words) > 1 else None


def class_head(text: str) -> tuple[str, list[tuple[str, str]], int] | None:
    """Name, annotations and place of the first class."""
    cls = CLASS.search(text)
    if not cls:
        return None
    notes, at = [], text.find("@")
    while 0 <= at < cls.start():
        found, at = annotations(text, at)
        notes += found
        at = text.find("@", at)
    return cls[1], notes, cls.end()


def controller_endpoints(text: str) -> list[dict]:
    """Endpoints of a Java controller: methods, full path, parameters, return type, summary."""
    head = class_head(text)
    if not head or not {"RestController", "Controller"} & {n for n, _ in head[1]}:
        return []
    name, notes, at = head
    base = next((mapping_path(a) for n, a in notes if n in VERBS), "")
    out, line, counted = [], 1, 0
    while (at := text.find("@", at)) >= 0:
        line, counted = line + text.count("\n", counted, at), at
        found, end = annotations(text, at)
        mapping = next(((n, a) for n, a in found if n in VERBS), None)
        s = signature(text, end) if mapping else None
        if s:
            chosen = re.findall(r"RequestMethod\.(\w+)", mapping[1])
            path = "/" + "/".join(p.strip("/") for p in (base, mapping_path(mapping[1])) if p.strip("/"))
            summary = next((strings_in(a)[0] for n, a in found if n in ("ApiOperation", "Operation") and strings_in(a)), None)
            inside = balanced(text, s[2])
            out.append({"controller": name, "methods": VERBS[mapping[0]] or chosen or ["GET"], "path": path, "method_name": s[1], "return_type": s[0], "params": parameters(inside), "summary": summary, "line": line})
            end = s[2] + len(inside)
        at = max(end, at + 1)
    return out


def read_controllers(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    params = "array<struct<name:string,type:string,required:boolean,annotation:string>>"
    return parsed(df, text, keys, controller_endpoints, f"controller string, methods array<string>, path string, method_name string, return_type string, params {params}, summary string, line int")


def members(text: str, at: int) -> Iterator[tuple[list[tuple[str, str]], str]]:
    """Annotations and head - up to ; = ( or { - of each member of a class body."""
    while at < len(text):
        notes, at = annotations(text, at)
        end = next((i for i in range(at, len(text)) if text[i] in ";=({}"), len(text))
        yield notes, text[at : end + 1].strip()
        if text[end : end + 1] == "(":
            end += len(balanced(text, end)) + 1
            end = next((i for i in range(end, len(text)) if text[i] in ";{"), len(text))
        if text[end : end + 1] == "{":
            depth = 0
            while end < len(text):
                depth += (text[end] == "{") - (text[end] == "}")
                if depth == 0:
                    break
                end += 1
        elif text[end : end + 1] == "=":
            end = text.find(";", end) if text.find(";", end) >= 0 else len(text)
        at = end + 1


def model_fields(text: str) -> list[dict]:
    """Fields of a Java data class with what its persistence annotations say."""
    head = class_head(text)
    if not head:
        return []
    name, notes, at = head
    of = lambda notes, kind: next((dict((k, v.strip("\"' ")) for k, v in re.findall(r"(\w+)\s*=\s*([^,]+)", a)) for n, a in notes if n == kind), None)
    table = of(notes, "Table")
    out = []
    for found, line in members(text, text.find("{", at) + 1):
        words = line.rstrip(";=").split()
        if not line.endswith((";", "=")) or len(words) < 2 or "static" in words:
            continue
        words = [w for w in words if w not in MODIFIERS]
        column = of(found, "Column") or {}
        primary = any(n in ("Id", "EmbeddedId") for n, _ in found)
        out.append({"class_name": name, "table": (table or {}).get("name"), "field": words[-1], "type": " ".join(words[:-1]), "column": column.get("name"), "primary": primary, "nullable": not primary and column.get("nullable") != "false"})
    return out


def read_data_models(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, model_fields, "class_name string, table string, field string, type string, column string, primary boolean, nullable boolean")


def service_methods(text: str) -> list[dict]:
    """Public methods of a Java service, and whether they run in a transaction (own annotation or the class's)."""
    head = class_head(text)
    if not head or not {"Service", "Component"} & {n for n, _ in head[1]}:
        return []
    name, notes, at = head
    whole = any(n == "Transactional" for n, _ in notes)
    out = []
    for found, line in members(text, text.find("{", at) + 1):
        words = line.rstrip("(").split()
        if line.endswith("(") and words[:1] == ["public"] and len(words) > 2:
            own = [a for n, a in found if n == "Transactional"]
            out.append({"class_name": name, "method_name": words[-1], "transactional": whole or bool(own), "read_only": any("readOnly=true" in a.replace(" ", "") for a in own)})
    return out


def read_services(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return parsed(df, text, keys, service_methods, "class_name string, method_name string, transactional boolean, read_only boolean")


# ---- splits


def page_chunks(df: DataFrame, pages: str, size: str, most_pages: int = 20, most_bytes: int = 5 * 2**20, per_chunk: int = 10) -> DataFrame:
    """Page ranges of files: one chunk, or ``per_chunk`` pages each if the file is long or large."""
    split = (F.col(pages) > most_pages) | (F.col(size) > most_bytes)
    step = F.when(split, F.lit(per_chunk)).otherwise(F.greatest(F.col(pages), F.lit(1)))
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.col(pages), F.lit(1)), step.cast("int"))).alias("first_page")
    return df.select("*", step.alias("_step"), first).withColumn("last_page", F.least(F.col(pages), F.col("first_page") + F.col("_step") - 1)).drop("_step")


def smaller_chunk(pages: int) -> int | None:
    """Pages of a chunk after a timeout: half, three at least; None if it cannot shrink."""
    half = max(3, pages // 2)
    return half if half < pages else None


def sheet_chunks(rows: DataFrame, sheet: str, most: int = 40, cell: int = 2000) -> DataFrame:
    """Markdown chunks of sheets: ``most`` rows each under the sheet's name, the chunk's number of how many, and the header.

    ``rows``: sheet, row_no (0 for the header, then from 1), cells (array). Cells are cut to
    ``cell`` characters; rows are padded or cut to the header's length. Chunks of blank
    rows alone are left out but numbered; a header without rows is a chunk of its own,
    unless it is blank too.
    """
    escaped = lambda x: F.regexp_replace(F.regexp_replace(F.substring(F.coalesce(x, F.lit("")), 1, cell), r"\|", r"\\|"), "\n", " ")
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(c, escaped), " | "), F.lit(" |"))
    head = rows.where("row_no = 0").select(sheet, F.col("cells").alias("_h"))
    sizes = rows.where("row_no > 0").groupBy(sheet).agg(F.max("row_no").alias("_n"))
    heads = head.join(sizes, sheet, "left").select(sheet, "_h", F.coalesce("_n", F.lit(0)).alias("_n"))
    padded = F.transform("_h", lambda _, i: F.get("cells", i))
    data = rows.where("row_no > 0").join(heads, sheet).select(sheet, "row_no", "_h", "_n", line(padded).alias("_t"), F.exists("cells", lambda x: F.coalesce(x, F.lit("")) != "").alias("_full"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_t"))), lambda x: x["_t"]), "\n")
    chunk = F.floor((F.col("row_no") - 1) / most).cast("int").alias("chunk")
    full = data.groupBy(sheet, chunk, "_h", "_n").agg(body.alias("_b"), F.bool_or("_full").alias("_full")).where("_full").drop("_full")
    alone = heads.where((F.col("_n") == 0) & F.exists("_h", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).select(sheet, F.lit(0).alias("chunk"), "_h", "_n", F.lit(None).cast("string").alias("_b"))
    title = F.format_string("## %s [%d/%d]\n", F.col(sheet), F.col("chunk") + 1, F.greatest(F.lit(1), F.ceil(F.col("_n") / most)))
    ruler = F.concat(F.lit("| "), F.array_join(F.transform("_h", lambda _: F.lit("---")), " | "), F.lit(" |"))
    return full.unionByName(alone).select(sheet, "chunk", F.concat_ws("\n", title, line(F.col("_h")), ruler, "_b").alias("text"))
