"""Fact check: documented against implemented interfaces, end to end, and the figures drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, severity
from ..functions import text as T
from . import gaps as G
from . import matching as M
from .lineage import cut
from .similar import similar_sets


def fact_check(spec: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Matches (kind, src, doc, score, method) and gaps (kind, gap_type, severity, src, doc, name, noise).

    ``spec``: apis (src, path, method, alternatives, controller), tables (src, name, n_columns),
    columns (src, column, java, primary), params (src, path, name, type, annotation, required),
    and of the documents doc_apis (doc, path, required), doc_tables (doc, name), doc_columns
    (doc, column, sql, primary, position), doc_params (doc, name, required). Gaps of noise
    items are LOW and carry the reason.
    """
    apis, tables, docs, doc_tables = (spec[k] for k in ("apis", "tables", "doc_apis", "doc_tables"))
    api = cut(M.match_endpoints(apis, docs))
    tab = cut(M.match_tables(tables, doc_tables))
    none = lambda kind: F.lit(None).cast(kind)

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        have = lambda c, t: F.col(c).cast(t) if c in df.columns else none(t)
        return df.select(F.lit(kind).alias("kind"), "gap_type", "severity", have("src", "long").alias("src"), have("doc", "long").alias("doc"), have("name", "string").alias("name"), have("noise", "string").alias("noise"))

    undocumented = G.missing_in_document(apis.withColumn("primary", F.lit(False)), api)
    left = tables.join(tab.select("src").hint("merge"), "src", "left_anti")
    why = rules.table_noise(F.col("name"), F.col("n_columns"))
    level = severity.gap_severity(F.lit("MID"), F.lit(False), F.lit(False), none("boolean"))
    unknown = left.select("src", F.lit("MID").alias("gap_type"), F.when(why.isNotNull(), "LOW").otherwise(level).alias("severity"), why.alias("noise"))
    columns = G.column_gaps(tab, spec["columns"], spec["doc_columns"], M.match_columns(tab, spec["columns"], spec["doc_columns"])).withColumnRenamed("column", "name")
    gaps = (
        shaped(undocumented, "api")
        .unionByName(shaped(unknown, "table"))
        .unionByName(shaped(G.missing_in_source(docs, api), "api"))
        .unionByName(shaped(G.missing_in_source(doc_tables.withColumn("required", F.lit(False)), tab), "table"))
        .unionByName(shaped(columns, "table"))
        .unionByName(shaped(G.parameter_gaps(api, spec["params"], spec["doc_params"]), "api"))
    )
    matches = api.withColumn("kind", F.lit("api")).unionByName(tab.withColumn("kind", F.lit("table"))).select("kind", "src", "doc", "score", "method")
    return matches, cut(gaps)


def fact_check_summary(spec: dict[str, DataFrame], matches: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: items of both sides, matches, gaps without noise, coverage per cent without noise."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    real = gaps.where("noise is null")
    out = n(spec["apis"].select("src").union(spec["tables"].select("src")), "sources").join(n(spec["doc_apis"].select("doc").union(spec["doc_tables"].select("doc")), "documents"))
    out = out.join(n(matches, "matched")).join(n(real, "gaps")).join(n(gaps.where("noise is not null"), "noise"))  # one row each
    return out.withColumn("coverage", G.coverage(F.col("matched"), F.col("sources") - F.col("noise")))


def statistics(gaps: DataFrame, key: str) -> DataFrame:
    """Counts of gaps by type and by severity, and of noise by reason, as maps. ``gaps``: key, gap_type, severity, noise."""

    def counts(c: str) -> DataFrame:
        g = gaps.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("n"))
        return g.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))

    out = counts("gap_type").join(counts("severity"), key, "full").join(counts("noise"), key, "full")
    empty = F.create_map().cast("map<string,bigint>")
    return out.select(key, *(F.coalesce(c, empty).alias(c) for c in ("by_gap_type", "by_severity", "by_noise")))


RESULT = "matchedItems array<struct<sourceRef:struct<type:string>>>, unmatchedSourceApis long, unmatchedDocApis long, unmatchedSourceTables long, unmatchedDocTables long, _bad string"


def kpi_split(results: DataFrame) -> DataFrame:
    """Matches of endpoints and of tables out of a result's JSON, made to add up to what the result counts.

    ``results``: id, json (null or unreadable: all matches are endpoints), matched, sources. Matches that the
    JSON lacks are shared out by its parts - all to endpoints if it has no table - and taken from the unmatched.
    """
    j = results.withColumn("j", F.from_json("json", RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    known = F.col("json").isNotNull() & F.col("j").isNotNull() & F.col("j._bad").isNull()
    items = F.coalesce(F.when(known, F.col("j.matchedItems")), F.from_json(F.lit("[]"), "array<struct<sourceRef:struct<type:string>>>"))
    table = F.size(F.filter(items, lambda i: i["sourceRef"]["type"] == "table")).cast("long")
    zero = F.lit(0).cast("long")
    r = j.select(
        "id", "matched", "sources", F.when(known, F.size(items) - table).otherwise(F.col("matched")).alias("a"), F.when(known, table).otherwise(zero).alias("t"),
        F.when(known, F.coalesce("j.unmatchedSourceApis", zero)).otherwise(F.greatest(zero, F.col("sources") - F.col("matched"))).alias("ua"), F.when(known, F.coalesce("j.unmatchedSourceTables", zero)).otherwise(zero).alias("ut"),
    )
    r = r.withColumn("more", F.greatest(zero, F.col("matched") - F.col("a") - F.col("t")))
    share = F.when(F.col("t") == 0, F.col("more")).otherwise(F.floor(F.col("more") * (F.col("a") / (F.col("a") + F.col("t"))) + 0.5))
    r = r.withColumn("ma", share.cast("long")).withColumn("mt", F.col("more") - F.col("ma"))
    less = lambda u, m: F.greatest(zero, F.col(u) - F.col(m))
    return r.select("id", (F.col("a") + F.col("ma")).alias("api_matched"), (F.col("t") + F.col("mt")).alias("table_matched"), less("ua", "ma").alias("api_unmatched"), less("ut", "mt").alias("table_unmatched"))


def best_terms(names: DataFrame, units: DataFrame, mappings: DataFrame) -> DataFrame:
    """The source unit that each name's best term mapping leads to: name, unit, confidence.

    A mapping (document_name, source_name, score) applies to a name, and leads to a unit, where
    one contains the other without case. The highest score counts; ties go to the first
    mapping by name, then to the first unit.
    """
    low = lambda c: F.lower(F.trim(c))
    a = names.select("name", low(F.col("name")).alias("a")).distinct()
    m = mappings.select(low(F.col("document_name")).alias("b"), F.lower("source_name").alias("s"), "score").distinct()
    u = units.select("unit", F.lower("unit").alias("u")).distinct()
    first = M.contains_pairs(a.select(F.col("a").alias("src"), "a").distinct(), m.select(F.col("b").alias("doc"), "b").distinct())
    second = M.contains_pairs(m.select(F.col("s").alias("src"), F.col("s").alias("a")).distinct(), u.select(F.col("u").alias("doc"), F.col("u").alias("b")).distinct())
    led = first.select(F.col("src").alias("a"), F.col("doc").alias("b")).join(m, "b").groupBy("a", "s").agg(F.max("score").alias("score"))
    best = led.join(second.select(F.col("src").alias("s"), F.col("doc").alias("u")), "s").join(u, "u").groupBy("a").agg(F.min_by(F.struct("unit", "score"), F.struct(-F.col("score"), "s", "unit")).alias("x"))
    return a.join(best, "a").select("name", F.col("x.unit").alias("unit"), F.col("x.score").alias("confidence"))


def stem_pairs(names: DataFrame, units: DataFrame) -> DataFrame:
    """(name, unit) where one's stem contains the other's. ``units``: unit, spelling (several spellings may stand for a unit)."""
    a = names.select("name", T.class_stem(F.col("name")).alias("a")).where("a <> ''").distinct()
    b = units.select("unit", T.class_stem(F.col("spelling")).alias("b")).where("b <> ''").distinct()
    pairs = M.contains_pairs(a.select(F.col("a").alias("src"), "a").distinct(), b.select(F.col("b").alias("doc"), "b").distinct())
    return pairs.select(F.col("src").alias("a"), F.col("doc").alias("b")).join(a, "a").join(b, "b").select("name", "unit").distinct()


def perspective(names: DataFrame, units: DataFrame, spellings: DataFrame, mappings: DataFrame, name_level: Column, unit_level: Column, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Documented names against source units: items by severity (``most`` of them) and one row of totals.

    ``names``: name and what ``name_level`` needs; ``units``: unit and what ``unit_level`` needs; ``spellings``: unit,
    spelling. A name matches the first unit by stem, else the one its term mappings lead to. Units that no name
    matches are gaps of the documents.
    """
    direct = stem_pairs(names.select("name"), spellings).groupBy("name").agg(F.min("unit").alias("unit"))
    rest = names.select("name").join(direct, "name", "left_anti")
    found = cut(direct.unionByName(best_terms(rest, units.select("unit"), mappings).select("name", "unit")))
    told = names.join(found, "name", "left").select("name", F.when(F.col("unit").isNotNull(), "matched").otherwise("gap-in-code").alias("status"), name_level.alias("severity"))
    coded = units.join(found.select("unit").distinct(), "unit", "left_anti").select(F.col("unit").alias("name"), F.lit("gap-in-doc").alias("status"), unit_level.alias("severity"))
    items = cut(told.unionByName(coded))
    totals = items.agg(F.count("*").alias("items"), F.count(F.when(F.col("status") == "matched", 1)).alias("matched"))
    totals = totals.withColumn("gaps", F.col("items") - F.col("matched")).withColumn("coverage", G.coverage(F.col("matched"), F.col("items")))
    return items.orderBy(severity.severity_rank(F.col("severity")), "name", "status").limit(most), totals


def spec_gaps(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps of each specification item: id, gap. ``items``: id, path; ``gaps``: gap, source_item.

    A gap names its item by path or api in JSON; where its text is no JSON, by holding the path.
    """
    j = gaps.withColumn("j", F.from_json("source_item", "path string, api string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("j").isNotNull() & F.col("j._bad").isNull()
    named = j.where(good).select("gap", F.explode(F.array_distinct(F.array_compact(F.array("j.path", "j.api")))).alias("path"))
    plain = j.where(~good & F.col("source_item").isNotNull()).select("gap", "source_item")
    inside = M.contains_pairs(items.select(F.col("path").alias("src"), F.col("path").alias("a")).distinct(), plain.select(F.col("source_item").alias("doc"), F.col("source_item").alias("b")).distinct())
    inside = inside.select(F.col("src").alias("path"), F.col("doc").alias("source_item")).where(F.col("source_item").contains(F.col("path"))).join(plain.hint("merge"), "source_item")
    return path_pairs(items.select("id", "path"), named.unionByName(inside.select("gap", "path")))


def path_pairs(items: DataFrame, gaps: DataFrame, part: int = 512) -> DataFrame:
    """Distinct (id, gap) of items (id, path) and gaps (gap, path) of a path.

    Pairs are made after the last shuffle, from parts of each path's ids and gaps, so
    that only these are sent, however many pairs they make. A pair of several paths is
    made at the least of them.
    """

    def parts(df: DataFrame, key: str) -> DataFrame:
        known = df.where("path is not null").groupBy(key).agg(F.sort_array(F.collect_set("path")).alias("_all")).select(key, "_all", F.explode("_all").alias("path"))
        # Parts have ``part`` rows on average; a row with one path needs no list of them.
        dealt = known.withColumn("_all", F.when(F.size("_all") > 1, F.col("_all")))
        number = dealt.groupBy("path").agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"))
        dealt = dealt.join(number.hint("merge"), "path").withColumn("_part", F.pmod(F.hash(key), F.col("_parts")))
        return dealt.groupBy("path", "_part").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_all").alias("paths"))).alias(f"_{key}")).drop("_part")

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = parts(items, "id").hint("merge").join(parts(gaps, "gap"), "path").repartition(n)
    made = met.select("path", F.explode("_id").alias("a"), "_gap").select("path", "a", F.explode("_gap").alias("b"))
    first = F.array_min(F.array_intersect("a.paths", "b.paths"))
    return made.where(F.col("a.paths").isNull() | F.col("b.paths").isNull() | (first == F.col("path"))).select(F.col("a.k").alias("id"), F.col("b.k").alias("gap"))


def conflicts(policies: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of policies, the newer first, of whose first's words the second shares ``least`` or more, with other outcomes.

    ``policies``: id, created (a timestamp or number), condition, outcome. Words of two characters or more count.
    """
    words = F.array_distinct(F.filter(F.split("condition", r"\s+"), lambda w: F.length(w) >= 2))
    p = policies.where(F.coalesce("condition", F.lit("")) != "").select("id", "created", "outcome", words.alias("tokens")).where(F.size("tokens") > 0)
    a, b = (p.select(F.col("id").alias(f"id{i}"), F.col("created").alias(f"c{i}"), F.col("outcome").alias(f"o{i}"), "tokens") for i in "12")
    j = similar_sets(a, b, least, contained=True)
    newer = (F.col("c1") > F.col("c2")) | ((F.col("c1") == F.col("c2")) & (F.col("id1") < F.col("id2")))
    return j.where(newer & ~F.col("o1").eqNullSafe(F.col("o2"))).select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("score").alias("overlap"))
