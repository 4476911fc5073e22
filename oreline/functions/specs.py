"""Rules of source files, specifications and skills, as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_rule
from .text import rounded

#: Sheets that hold no data.
SKIPPED_SHEETS = ("표지", "제개정이력")
SKIPPED_SHEET_PARTS = ("샘플", "작성가이드", "명명규칙")


def skip_sheet(name: Column) -> Column:
    """Cover, history, sample, guide and naming sheets."""
    return name.isin(*SKIPPED_SHEETS) | name.rlike("|".join(SKIPPED_SHEET_PARTS))


def parameter_source(annotation: Column) -> Column:
    """Where a parameter comes from: path, body, header, else query."""
    low = F.lower(annotation)
    return first_rule([(low.contains("path"), "path"), (low.contains("body"), "body"), (low.contains("header"), "header")], "query")


def json_type(java: Column) -> Column:
    low = F.lower(java)
    has = lambda *parts: low.rlike("|".join(parts))
    return first_rule([
        (has("string") | (low == "char"), "string"),
        (has("int", "long", "short"), "integer"),
        (has("double", "float", "decimal", "number"), "number"),
        (has("bool"), "boolean"),
        (has("list", "array", "set"), "array"),
    ], "object")


def library_only(controllers: Column, models: Column, transactions: Column, mappers: Column) -> Column:
    """An archive without any element of an application."""
    return (controllers + models + transactions + mappers) == 0


def partial_extraction(rate: Column, oversized: Column, capped: Column) -> tuple[Column, Column]:
    """Severity (null: nothing lacks) and number of reasons why an archive was not read whole."""
    reasons = capped.cast("int") + (F.coalesce(oversized, F.lit(0)) > 0).cast("int") + F.coalesce((rate < 0.95).cast("int"), F.lit(0))
    severity = F.when(capped | F.coalesce(rate < 0.5, F.lit(False)), "HIGH").when(F.coalesce(rate < 0.8, F.lit(False)), "MEDIUM").otherwise("LOW")
    return F.when(reasons > 0, severity), reasons


def column_type(definition: Column) -> Column:
    """SQL type of a term by the words of its definition."""
    return F.when(definition.rlike("금액|수량|건수|횟수"), "INTEGER").when(definition.rlike("비율|점수|확률"), "REAL").otherwise("TEXT")


def truncated(text: Column, most: int) -> Column:
    """The text, or its first ``most`` characters and a note of how many were left out."""
    note = F.concat(F.lit("\n\n... [truncated "), (F.length(text) - most).cast("string"), F.lit(" chars to fit context]"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), note)).otherwise(text)


def says_yes(value: Column) -> Column:
    return F.upper(F.trim(value)).isin("Y", "YES", "O", "TRUE", "1")


def nullable(value: Column, header: Column) -> Column:
    """Whether a column may be null, by a cell and what its header asks for."""
    return F.when(header.rlike(r"(?i)필수|NOT\s*NULL"), ~says_yes(value)).otherwise(says_yes(value))


#: Domain words of policy codes by their first digit.
POLICY_DOMAINS = {"1": "발행", "2": "구매", "3": "결제", "4": "환불", "5": "선물"}


def policy_condition(code: Column, *classes: Column) -> Column:
    """Domain word of the code and the classes that are not blank, joined by >."""
    digit = F.substring(F.regexp_replace(code, "^PP", ""), 1, 1)
    word = first_rule([(digit == k, v) for k, v in POLICY_DOMAINS.items()])
    parts = F.filter(F.array(word, *classes), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.array_join(parts, " > ")


def annotation_methods(annotation: Column, arguments: Column) -> Column:
    """HTTP methods of a mapping annotation: by its name, else those it lists, else GET."""
    short = F.regexp_extract(annotation, "^(Get|Post|Put|Delete|Patch)Mapping$", 1)
    listed = F.regexp_extract_all(arguments, F.lit(r"RequestMethod\.([A-Z]+)"), F.lit(1))
    return F.when(short != "", F.array(F.upper(short))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))


def annotation_path(arguments: Column) -> Column:
    """First path of a mapping annotation: that of value or path, else the first string; null if there is none."""
    named = F.regexp_extract(arguments, r"""(?:value|path)\s*=\s*\{?\s*["']([^"']*)["']""", 1)
    first = F.regexp_extract(arguments, r"""["']([^"']*)["']""", 1)
    return F.when(named != "", named).when(first != "", first)


def java_class(name: Column, content: Column) -> Column:
    """Category of a source file: by annotation, then by file name."""
    return first_rule([
        (content.rlike(r"@RestController\b|@Controller\b"), "source_controller"),
        (content.rlike(r"@Service\b"), "source_service"),
        (content.rlike(r"@Entity\b"), "source_vo"),
        (content.rlike(r"@Configuration\b|@Component\b"), "source_config"),
        (name.endswith("Controller.java"), "source_controller"),
        (name.rlike(r"(VO|Dto|DTO|Entity|Req|Res|Request|Response)\.java$"), "source_vo"),
        (name.rlike(r"(Service|ServiceImpl)\.java$"), "source_service"),
        (name.endswith(".sql"), "source_ddl"),
    ], "source_config")


def view_of(relations: Column, flow: Column, hierarchy: Column, series: Column, compared: Column, columns: Column, rows: Column) -> Column:
    """How data are best shown: the first rule that holds."""
    return first_rule([
        (relations, "force-graph"), (flow, "mermaid-flowchart"), (hierarchy, "mermaid-tree"), (series, "line-chart"),
        (compared & (columns <= 5), "bar-chart"), (compared & (columns > 5), "heatmap-table"), (rows > 20, "data-table"),
    ], "text")


def parse_retry(attempt: Column, retryable: Column, timeout: Column, most: int = 3, base_ms: int = 1000) -> tuple[Column, Column]:
    """What follows a failed parse, and the wait before it in ms: retry, then after timeouts the fast way, else failure."""
    again = retryable & (attempt < most)
    step = F.when(again, "retry").when(timeout, "fast").otherwise("failed")
    return step, F.when(again, base_ms * F.pow(F.lit(2), attempt)).cast("long")


def close_json(text: str) -> str:
    """Truncated JSON with its half-written tail dropped and every open string, list and object closed."""
    cut = text.rstrip()
    tail = cut.rfind(",")
    if tail >= 0 and cut[tail + 1 :].lstrip()[:1] in ("", '"') and cut[tail + 1 :].count('"') < 2:
        cut = cut[:tail]
    closing, quoted, skip = [], False, False
    for ch in cut:
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{[":
            closing.append("}" if ch == "{" else "]")
        elif not quoted and ch in "}]" and closing:
            closing.pop()
    return cut + '"' * quoted + "".join(reversed(closing))


def valid_json(text: str | None) -> str | None:
    """The text's JSON without fences, closed if it was cut off; None where that fails."""
    if text is None:
        return None
    plain = text.replace("```json", "").replace("```", "").strip()
    for candidate in (plain, close_json(plain)):
        try:
            return json.dumps(json.loads(candidate), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            pass
    return None


def repaired_json(text: Column) -> Column:
    """Valid JSON of a model's output, or null."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(valid_json)

    return repair(text)


def criterion(score: Column) -> Column:
    """A readiness score in 0..1 with three digits."""
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
