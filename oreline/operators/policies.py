"""Reports over policies, processes and organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity
from ..functions import text as T
from . import matching as M
from . import models as D
from .gaps import coverage


def reconcile(source: DataFrame, document: DataFrame) -> DataFrame:
    """State of each METHOD path on either side: MATCH, DIVERGENCE of parameter counts, SOURCE_MISSING, DOC_ONLY.

    Both sides: method, path, params (their number), position; the last of equal keys counts.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        key = F.concat(F.upper("method"), F.lit(" "), T.normalize_endpoint(F.col("path")))
        return df.groupBy(key.alias("endpoint")).agg(F.max_by("params", "position").alias(name))

    j = side(source, "s").join(side(document, "d"), "endpoint", "full")
    state = F.when(F.col("s").isNull(), "DOC_ONLY").when(F.col("d").isNull(), "SOURCE_MISSING").when(F.col("s") != F.col("d"), "DIVERGENCE").otherwise("MATCH")
    return j.select("endpoint", state.alias("state"))


def enrich_columns(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Columns with Java type and nullability of the data class field of their property.

    ``columns``: table, column, property, vo (class name, maybe with its package), nullable; ``fields``: class_name, field, type, nullable.
    """
    short = F.regexp_replace("vo", r"^.*\.", "")
    f = fields.select(F.col("class_name").alias("_c"), F.col("field").alias("property"), F.col("type").alias("java"), F.col("nullable").alias("_n"))
    j = columns.withColumn("_c", short).join(f, ["_c", "property"], "left")
    return j.withColumn("nullable", F.coalesce("_n", "nullable")).drop("_c", "_n")


def duplicate_policies(candidates: DataFrame, existing: DataFrame, above: float) -> DataFrame:
    """Pairs of a candidate and an existing policy whose token sets have Jaccard similarity over ``above``.

    Equal token sets are compared once.
    """
    a, b = candidates.columns[0], existing.columns[0]
    pairs = M.token_pairs(candidates.withColumnRenamed(a, "src"), existing.withColumnRenamed(b, "doc"), above).where(F.col("score") > above)
    return pairs.select(F.col("src").alias(a), F.col("doc").alias(b))


def bundles(policies: DataFrame, most_tags: int = 20, least_other: int = 3) -> DataFrame:
    """Policies by category: how many, their first ``most_tags`` tags and how many documents they stem from.

    ``policies``: category, position, tags (array), document. The category other needs ``least_other`` policies.
    """
    first = policies.select("category", "position", F.posexplode("tags").alias("i", "tag")).groupBy("category", "tag").agg(F.min(F.struct("position", "i")).alias("p"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("p"))).where(F.col("k") <= most_tags)
    tags = kept.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda x: x["tag"]).alias("tags"))
    g = policies.groupBy("category").agg(F.count("*").alias("policies"), F.count_distinct("document").alias("documents"))
    return g.where((F.col("category") != "other") | (F.col("policies") >= least_other)).join(tags, "category", "left").select("category", "policies", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "documents")


def merged_specs(skills: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Technical parts (arrays) of an organisation's skills, one after the other. ``skills``: key, position, parts."""
    all_ = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])).alias(c)
    return skills.groupBy(key).agg(F.count("*").alias("skills"), *map(all_, parts))


def keyword_groups(policies: DataFrame, keywords: tuple[str, ...], least: int, most: int) -> DataFrame:
    """Keywords that ``least`` policies hold, with the first ``most`` of them. ``policies``: id, text."""
    hits = policies.select("id", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.col("text").contains(k))).alias("keyword"))
    n = hits.groupBy("keyword").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    few = hits.withColumn("k", F.row_number().over(Window.partitionBy("keyword").orderBy("id"))).where(F.col("k") <= most)
    return few.join(n, "keyword").groupBy("keyword").agg(F.array_sort(F.collect_list("id")).alias("ids"))


#: Areas that policies are expected to cover, with their words.
AREAS = {"중도인출": ("중도인출", "중도"), "해지": ("해지", "해약"), "이전": ("이전", "이관"), "수급": ("수급", "연금수령"), "가입": ("가입", "신규")}


def uncovered_areas(policies: DataFrame, areas: dict[str, tuple[str, ...]]) -> DataFrame:
    """Areas of which no policy's text holds a word."""
    hit = policies.agg(*(F.coalesce(F.bool_or(F.col("text").rlike("|".join(words))), F.lit(False)).alias(a) for a, words in areas.items()))
    found = hit.select(F.explode(F.array(*(F.struct(F.lit(a).alias("area"), F.col(a).alias("hit")) for a in areas))).alias("x"))
    return found.where("not x.hit").select("x.area")


def detector_coverage(rules: DataFrame) -> DataFrame:
    """Share of each domain's rules that a detector covers, per cent. ``rules``: domain, supported."""
    g = rules.groupBy("domain").agg(F.count("*").alias("total"), F.count(F.when(F.col("supported"), 1)).alias("applicable"))
    return g.withColumn("coverage", coverage(F.col("applicable"), F.col("total")))


def organisation(skills: DataFrame) -> DataFrame:
    """Organisations: skills, mean trust of the loaded ones (in hundredths; 0 if there are none), adapters, most frequent domain (the first of equals).

    ``skills``: org, position, domain, trust (whole hundredths, null: not loaded), mcp, openapi.
    """
    n = skills.groupBy("org", "domain").agg(F.count("*").alias("c"), F.min("position").alias("f"))
    top = n.groupBy("org").agg(F.max_by("domain", F.struct("c", -F.col("f"))).alias("domain"))
    yes = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    g = skills.groupBy("org").agg(F.count("*").alias("skills"), F.coalesce(F.sum("trust") / F.count("trust") / 100, F.lit(0.0)).alias("trust"), yes("mcp"), yes("openapi"))
    return g.join(top, "org")


def merged_processes(processes: DataFrame) -> DataFrame:
    """Processes over documents: mean score of two digits, documents, and the most frequent category (first document, then name, of equals), which decides what is core.

    ``processes``: process, score (whole hundredths, so that sums do not depend on their order), doc, category.
    """
    n = processes.groupBy("process", "category").agg(F.count("*").alias("c"), F.min("doc").alias("f"))
    top = n.groupBy("process").agg(F.min_by("category", F.struct(-F.col("c"), "f", "category")).alias("category"))
    g = processes.groupBy("process").agg((F.floor(F.sum("score") / F.count("*") + 0.5) / 100).alias("score"), F.count_distinct("doc").alias("documents"))
    return g.join(top, "process").withColumn("is_core", F.col("category").isin("mega", "core"))


def duplicate_processes(processes: DataFrame, above: float = 0.7) -> DataFrame:
    """Processes of a document whose names have Jaccard similarity over ``above``, the earlier one first.

    ``processes``: doc, position, name. Words have two characters at least, symbols count as blanks, case counts.
    """
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("name", r"[^A-Za-z0-9_가-힣]", " "), r"\s+"), lambda w: F.length(w) > 1))
    names = processes.groupBy("doc", "name").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    own = names.select(F.struct("doc", "name", "first", "last").alias("src"), F.transform(words, lambda w: F.concat(F.to_json(F.struct("doc")), F.lit("|"), w)).alias("tokens"))
    pairs = M.token_pairs(own, own.withColumnRenamed("src", "doc"), above).where(F.col("score") > above).where("src.first < doc.last")
    per_cent = F.floor(F.col("score") * 100 + 0.5)
    evidence = F.concat(F.lit("word overlap "), per_cent.cast("string"), F.lit("%"))
    return pairs.select("src.doc", "src.name", *D.finding("duplicate", "info", evidence, F.col("doc.name"), per_cent / 100, F.array("src.name", "doc.name")))


def diagnosis(processes: DataFrame, entities: DataFrame, rules: DataFrame, relations: DataFrame, importance: DataFrame) -> DataFrame:
    """Findings of all kinds: doc, name, other, type, severity, its rank, confidence, evidence and related processes.

    Missing references, duplicate names within a document, unimportant processes with many
    steps, and conditions that no process stands for. See the parts for their inputs.
    """
    found = (
        D.missing_references(relations, processes, entities)
        .unionByName(duplicate_processes(processes))
        .unionByName(D.overspecified(importance))
        .unionByName(D.orphan_conditions(rules, processes))
    )
    return found.withColumn("rank", severity.severity_rank(F.col("severity")))
