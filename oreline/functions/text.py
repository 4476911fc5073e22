"""Text functions of specification mining, as Column expressions.

Names, paths and words are normalised before they are compared; every function is a
pure Column -> Column function, so plans stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that say nothing about a path, and segments that name no resource.
PATH_NOISE = ("api", "v1", "v2", "v3", "v4", "rest", "internal", "external", "param", "controller", "service", "impl")
RESOURCE_NOISE = r"^(api|rest|v\d+|v?\d+\.\d+|internal|external)$"

#: Personal data patterns, applied in this order.
PII = (
    (r"(?<![A-Za-z0-9_])\d{6}-\d{7}(?![A-Za-z0-9_])", "[SSN]"),
    (r"(?<![A-Za-z0-9_])01[016789]-\d{3,4}-\d{4}(?![A-Za-z0-9_])", "[PHONE]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"(?<![A-Za-z0-9_])[A-Z]{2,4}-\d{4,8}(?![A-Za-z0-9_])", "[EMPID]"),
)


def rounded(x: Column, digits: int) -> Column:
    """Half up on the scaled double: floor(x * 10^d + 0.5) / 10^d."""
    return F.floor(x * 10**digits + F.lit(0.5)) / F.lit(float(10**digits))


def exact_mean(x: Column, places: int = 4) -> Column:
    """Mean of a column of few decimal places; the sum is exact, so the order of rows does not matter."""
    return F.sum(x.cast(f"decimal(18,{places})")).cast("double") / F.count(x)


def percent(part: Column, whole: Column) -> Column:
    """Rounded whole per cent; 0 if ``whole`` is 0."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def strip_host(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)^https?://[^/]+", "")


def normalize_path(path: Column) -> Column:
    """Comparable form of an API path: no host, no outer slashes, versions without v, one name for all parameters."""
    p = F.regexp_replace(strip_host(F.lower(path)), r"^/+|/+$", "")
    p = F.regexp_replace(p, r"/v(\d+\.\d+)(?=/|$)", "/$1")
    p = F.regexp_replace(F.regexp_replace(p, r"\{[^}]+\}", ":param"), r":[A-Za-z0-9_]+", ":param")
    return F.regexp_replace(p, "/+", "/")


def normalize_endpoint(path: Column) -> Column:
    """The reconciliation form: braces to colons, no trailing slash, / if nothing is left."""
    p = F.regexp_replace(F.regexp_replace(path, r"\{([^}]+)\}", ":$1"), "/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def resource_path(path: Column, app_names: tuple[str, ...] = ()) -> Column:
    """Last two segments that name a resource."""
    parts = F.filter(F.split(strip_host(F.lower(path)), "/"), lambda s: (s != "") & ~s.rlike(RESOURCE_NOISE) & ~s.rlike(r"^\{.*\}$") & ~s.startswith(":") & ~s.isin(*app_names or ("",)))
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")


def split_camel(token: Column) -> Column:
    """Words of a camelCase token."""
    marked = F.regexp_replace(F.regexp_replace(token, "([a-z])([A-Z])", "$1\u0000$2"), "([A-Z]+)([A-Z][a-z])", "$1\u0000$2")
    return F.filter(F.split(marked, "\u0000"), lambda t: t != "")


def path_tokens(path: Column, app_names: tuple[str, ...] = ()) -> Column:
    """Lower-case words of a path, without noise, versions and single characters."""
    words = F.flatten(F.transform(F.filter(F.split(path, r"[/\-_.]"), lambda t: t != ""), split_camel))
    return F.filter(F.transform(words, F.lower), lambda t: (F.length(t) > 1) & ~t.isin(*PATH_NOISE, *app_names) & ~t.rlike(r"^\d+(\.\d+)?$"))


def normalize_table(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "^(tb_|t_|tbl_)", "")


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def same_column(a: Column, b: Column) -> Column:
    """Names of one column: equal without case, or one the snake form of the other."""
    return (F.lower(a) == F.lower(b)) | (camel_to_snake(a) == F.lower(b)) | (F.lower(a) == camel_to_snake(b))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def table_similarity(a: Column, b: Column) -> Column:
    """1 if equal after normalisation, 0.8 if within two edits, else Jaccard of their words."""
    x, y = normalize_table(a), normalize_table(b)
    words = lambda t: F.filter(F.split(t, "_"), lambda w: w != "")
    return F.when(x == y, F.lit(1.0)).when(F.levenshtein(x, y) < 3, F.lit(0.8)).otherwise(jaccard(words(x), words(y)))


def class_stem(name: Column) -> Column:
    """Last part of a class name without its role suffix, lower case, without separators."""
    last = F.regexp_replace(name, r"^.*\.", "")
    stem = F.regexp_replace(last, "(?i)(Controller|Service|Impl|VO|DTO|Mapper|Repository|Dao)$", "")
    return F.regexp_replace(F.lower(stem), r"[_\-\s]", "")


def collapsed(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def combine_path(base: Column, endpoint: Column) -> Column:
    b, e = F.regexp_replace(base, "/+$", ""), F.regexp_replace(endpoint, "^/+", "")
    rooted = F.when(b.startswith("/"), b).otherwise(F.concat(F.lit("/"), b))
    return F.when(b == "", F.concat(F.lit("/"), e)).when(e == "", rooted).otherwise(F.concat(rooted, F.lit("/"), e))


def strip_app_prefix(path: Column) -> Column:
    """The path without a leading /name/version/."""
    rest = F.regexp_extract(path, r"(?i)^/[a-z][a-z0-9]*/v?\d+\.\d+/(.*)", 1)
    return F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(path)


def alternative_paths(path: Column, method: Column, base: Column) -> Column:
    """Other spellings under which a document may list an endpoint, first spelling kept of equal ones."""
    norm = lambda p: F.regexp_replace(F.lower(p), "^/+|/+$", "")
    stripped = strip_app_prefix(path)
    parts = F.filter(F.split(base, "/"), lambda s: s != "")
    last = F.element_at(parts, -1)
    from_last = F.substr(path, F.greatest(F.lit(1), F.instr(F.lower(path), F.lower(last))))
    rooted = F.when(from_last.startswith("/"), from_last).otherwise(F.concat(F.lit("/"), from_last))
    nothing = F.lit(None).cast("string")
    found = F.array(
        combine_path(path, method),
        stripped,
        F.when(stripped != path, combine_path(stripped, method)).otherwise(nothing),
        F.when((F.size(parts) > 1) & (from_last != path), rooted).otherwise(nothing),
    )
    found = F.filter(found, lambda p: p.isNotNull() & (norm(p) != norm(path)))
    first = F.transform(found, lambda p, i: F.when(F.array_position(F.transform(found, norm), norm(p)) == i + 1, p))
    return F.filter(first, lambda p: p.isNotNull())


def mask_pii(text: Column) -> Column:
    for pattern, token in PII:
        text = F.regexp_replace(text, pattern, token)
    return text


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def like_ascii(text: Column, part: str) -> Column:
    """Substring test that ignores ASCII case."""
    return F.lower(text).contains(part.lower())


def csv_cell(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n]'), quoted).otherwise(value)


def quality_factor(depth: Column) -> Column:
    """Trust factor by text depth: linear to 50 characters, linear to 200, then 1."""
    return F.when(depth >= 200, F.lit(1.0)).when(depth >= 50, 0.7 + 0.3 * (depth - 50) / 150).otherwise(0.5 + 0.2 * depth / 50)


def triage_score(rules: Column, relations: Column, entities: Column, processes: Column) -> Column:
    capped = lambda x, most: F.least(x / most, F.lit(1.0))
    return capped(rules, 10) * 0.35 + capped(relations, 15) * 0.25 + capped(entities, 25) * 0.25 + capped(processes, 15) * 0.15


def triage_rank(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def spec_confidence(high: Column, medium: Column, has_doc: Column) -> Column:
    start = F.when(has_doc, F.lit(1.0)).otherwise(F.lit(0.5))
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), start - 0.15 * high - 0.05 * medium)), 2)


def duration_label(seconds: Column) -> Column:
    """Whole minutes and, rounded on their own, seconds (which may print 60)."""
    return F.format_string("%d분 %d초", F.floor(seconds / 60).cast("long"), F.floor(seconds - F.floor(seconds / 60) * 60 + 0.5).cast("long"))


def strip_fence(text: Column) -> Column:
    """Model output without its markdown fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


#: Words that name no domain term.
TERM_STOPWORDS = ("경우", "해당", "필요", "확인", "통해", "기반", "관련", "대한", "위한", "따른", "의한", "있는", "없는", "하는", "되는", "이상", "이하", "이내", "범위", "내에서", "여부")


def terms(text: Column, most: int = 10) -> Column:
    """Distinct Hangul terms of one or two words, first seen first, at most ``most``."""
    found = F.regexp_extract_all(text, F.lit(r"[가-힣]{2,}(?:\s[가-힣]{2,})?"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda t: ~t.isin(*TERM_STOPWORDS))), 1, most)


#: Phrases that state a performance requirement.
PERFORMANCE = (
    r"(?i)(\d+)\s*(TPS|RPS|QPS|건/초)",
    r"(?i)(\d+)\s*(ms|초|분|밀리초)\s*(이내|이하)",
    r"(?i)(응답시간|latency|처리시간|지연)[^.]*?(\d+)",
    r"(?i)(SLA|가용성|무중단|uptime)[^.]*?(\d+)",
    r"(?i)(\d+)\s*(%|퍼센트)[^.]*?(이상|이하|이내)",
)


def performance_phrases(text: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PERFORMANCE)), lambda x: F.trim(x)))


def keyword_context(text: Column, keyword: str, before: int = 30, after: int = 50) -> Column:
    """The keyword's first place with its surroundings; null if it is absent."""
    at = F.instr(text, keyword)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.trim(F.substr(text, start, at + len(keyword) + after - start)))
