"""Gap detection between documented and implemented interfaces, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, severity



def missing_in_document(sources: DataFrame, matches: DataFrame) -> DataFrame:
    """MID gaps of unmatched source items (src, path, controller, primary): noise is resolved at once."""
    left = sources.join(matches.select("src").hint("merge"), "src", "left_anti")
    noise = rules.api_noise(F.col("path"), F.coalesce("controller", F.lit("")))
    kind = severity.gap_severity(F.lit("MID"), F.col("primary"), F.lit(False), ~rules.is_internal(F.col("path")))
    return left.select("src", F.lit("MID").alias("gap_type"), F.when(noise.isNotNull(), "LOW").otherwise(kind).alias("severity"), noise.alias("noise"), noise.isNotNull().alias("auto_resolved"))


def missing_in_source(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """MC gaps of unmatched document items (doc, required)."""
    kind = severity.gap_severity(F.lit("MC"), F.lit(False), F.col("required"), F.lit(None).cast("boolean"))
    return docs.join(matches.select("doc").hint("merge"), "doc", "left_anti").select("doc", F.lit("MC").alias("gap_type"), kind.alias("severity"))


def column_gaps(pairs: DataFrame, source_columns: DataFrame, doc_columns: DataFrame, matched: DataFrame) -> DataFrame:
    """SM gaps of columns on one side only, and TM gaps of columns whose types do not fit.

    ``source_columns``: src, column, java, primary; ``doc_columns``: doc, column, sql,
    primary; ``matched``: src, doc, column, doc_column.
    """
    # Columns and parameters are exploded, more than Spark takes them for: hints keep it from sending them to all.
    s = pairs.select("src", "doc").join(source_columns.hint("merge"), "src").join(matched.hint("merge"), ["src", "doc", "column"], "left")
    kind = lambda t, java=None, sql=None: severity.gap_severity(F.lit(t), F.col("primary"), F.lit(False), F.lit(None).cast("boolean"), java, sql)
    only_source = s.where(F.col("doc_column").isNull()).select("src", "doc", "column", F.lit("SM").alias("gap_type"), kind("SM").alias("severity"))
    types = doc_columns.select("doc", F.col("column").alias("doc_column"), "sql")
    typed = s.where(F.col("doc_column").isNotNull()).join(types.hint("merge"), ["doc", "doc_column"]).where(F.col("java").isNotNull() & F.col("sql").isNotNull())
    wrong = typed.where(~severity.type_compatible(F.col("java"), F.col("sql"))).select("src", "doc", "column", F.lit("TM").alias("gap_type"), kind("TM", F.col("java"), F.col("sql")).alias("severity"))
    t = pairs.select("src", "doc").join(doc_columns.hint("merge"), "doc")
    only_doc = t.join(matched.select("src", "doc", F.col("doc_column").alias("column")).hint("merge"), ["src", "doc", "column"], "left_anti").select("src", "doc", "column", F.lit("SM").alias("gap_type"), kind("SM").alias("severity"))
    return only_source.unionByName(wrong).unionByName(only_doc)


def parameter_gaps(pairs: DataFrame, source_params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """PM gaps of parameters that one side lacks, without case; source ones that need no mention are skipped.

    ``source_params``: src, path, name, type, annotation, required; ``doc_params``: doc, name, required.
    """
    low = lambda df: df.withColumn("k", F.lower("name"))
    kind = severity.gap_severity(F.lit("PM"), F.lit(False), F.col("required"), F.lit(None).cast("boolean"))
    s = pairs.select("src", "doc").join(low(source_params).hint("merge"), "src").where(~rules.skip_parameter(F.col("name"), F.col("type"), F.col("annotation"), F.col("path")))
    t = pairs.select("src", "doc").join(low(doc_params).hint("merge"), "doc")
    lacks = lambda a, b, side: a.join(b.select("src", "doc", "k").hint("merge"), ["src", "doc", "k"], "left_anti").select("src", "doc", "name", F.lit(side).alias("lacking"), F.lit("PM").alias("gap_type"), kind.alias("severity"))
    all_source = pairs.select("src", "doc").join(low(source_params).hint("merge"), "src")
    return lacks(s, t, "doc").unionByName(lacks(t, all_source, "source"))


def coverage(matched: Column, whole: Column) -> Column:
    """Per cent with one digit; 0 if there is nothing to match."""
    return F.when(whole > 0, F.floor(matched * 1000.0 / whole + 0.5) / F.lit(10.0)).otherwise(F.lit(0.0))


def domain_summary(gaps: DataFrame) -> DataFrame:
    """Totals by domain, most gaps first: severities without noise, noise, first three descriptions.

    ``gaps``: domain, severity, noise (boolean), gap_type, position, description.
    """
    real = lambda s: F.sum(F.when((F.col("severity") == s) & ~F.col("noise"), 1).otherwise(0))
    first = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("position", "description"))), lambda x: x["description"]), 1, 3)
    few = gaps.withColumn("_rn", F.expr("row_number() over (partition by domain order by position)"))
    samples = few.where("_rn <= 3").groupBy("domain").agg(first.alias("samples"))
    totals = gaps.groupBy("domain").agg(F.count("*").alias("total"), real("HIGH").alias("high"), real("MEDIUM").alias("medium"), real("LOW").alias("low"), F.sum(F.col("noise").cast("long")).alias("noise"))
    return totals.join(samples, "domain").orderBy(F.desc("total"), "domain")


def suggestions(gaps: DataFrame) -> DataFrame:
    """How urgent a document's revision is: HIGH from five HIGH gaps, MEDIUM from one. ``gaps``: document, severity."""
    high = F.sum(F.when(F.col("severity") == "HIGH", 1).otherwise(0))
    return gaps.groupBy("document").agg(F.count("*").alias("total"), high.alias("high")).withColumn("priority", F.when(F.col("high") >= 5, "HIGH").when(F.col("high") >= 1, "MEDIUM").otherwise("LOW"))


def merge_table_columns(columns: DataFrame) -> DataFrame:
    """Columns of tables known from several places: first type wins, any primary key counts, ddl origin first.

    ``columns``: table, column, sql, primary, origin, position.
    """
    first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("position")))
    return columns.groupBy("table", "column").agg(
        first(F.col("sql")).alias("sql"), F.bool_or("primary").alias("primary"), F.min_by("origin", F.struct(F.when(F.col("origin") == "ddl", 0).otherwise(1), F.col("position"))).alias("origin")
    )


def table_relevance(queries: DataFrame) -> DataFrame:
    """Relevance of tables by queries (kind, tables): in three joins an entity, in two writes a transaction."""
    t = queries.select("kind", F.size("tables").alias("n"), F.explode(F.array_distinct("tables")).alias("table"))
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    g = t.groupBy("table").agg((n(F.col("n") > 1) >= 3).alias("entity"), (n(F.col("kind").isin("insert", "update", "delete")) >= 2).alias("transaction"))
    return g.withColumn("relevance", rules.relevance(F.lit(False), F.col("entity"), F.col("transaction")))


def trace_matrix(sources: DataFrame, matches: DataFrame) -> DataFrame:
    """Every source item with its document, score and whether it counts as matched (score above 0)."""
    m = sources.select("src").join(matches.select("src", "doc", "score"), "src", "left")
    return m.select("src", "doc", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("doc").isNotNull() & (F.coalesce("score", F.lit(0.0)) > 0)).alias("matched"))


