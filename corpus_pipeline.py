"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage is written as Parquet and read again as the next one's documents. In every
stage a null text counts as an empty one, texts of any length are read whole, repeated
rows are rows like others, extra columns stay whatever their names, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import mixing, neardup, packing, queries, secrets, toxicity
from oreline.llm.common import new_path, quoted, remove, small_batches, stage, working_names

#: Words of a shingle, and per cent of common shingles from which documents are near-duplicates.
SHINGLE, NEAR_PERCENT = 5, 80
#: Per cent of the tokens that the mix may hold.
MIX_PERCENT = 90


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not flag; without labels of both classes, all of them."""
    labels = queries.table(spark, sf_dir, "labels")
    with small_batches(spark):
        return stage(toxicity.toxicity(docs, labels).where(~F.col("flagged")).select(*map(quoted, docs.columns)), "pipeline-clean")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id. Documents without words or id stay."""
    with small_batches(spark):
        return neardup.drop_near_duplicates(docs, size=SHINGLE, percent=NEAR_PERCENT).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text; n_chars follows the text. Documents without secrets are unchanged."""
    (spans,) = working_names(docs, "_found")
    found = secrets.scan_secrets(docs, out=spans)
    hit = F.size(spans) > 0
    masked = found.withColumn("text", F.when(hit, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-prefix of each source that its share of the budget allows, read once at most. Documents of one id stand or fall together."""
    domain, lang, source = working_names(docs, "_domain", "_lang", "_source")
    levels = {domain: F.expr(queries.DOMAIN), lang: F.col("lang"), source: F.col("source")}
    return mixing.mix_to_weights(docs, levels, queries.WEIGHTS, percent=MIX_PERCENT, epochs=1).where("copies > 0").select(*map(quoted, docs.columns))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    pieces = packing.tokenize_pieces(docs, queries.tokenizer_path())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    with small_batches(spark):  # pieces are staged inside
        return packing.pack_pieces(pieces, order=["doc_id", "piece"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: The fitted classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = queries.table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        made.append(new_path(spark, f"pipeline-{name}"))
        step(spark, docs, sf_dir).write.parquet(made[-1])
        docs = spark.read.parquet(made[-1])
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads its own staged pieces, no documents
    remove(spark, made)
    return out
