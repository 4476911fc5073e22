"""Queries of the training-data operators and their SQL where SQL expresses them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cleaning, divergence, hmm, knn, mining, mixing, neardup, ogg, packing, quality, secrets, sharding, toxicity
from .common import text_or_empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_insult", "p_contempt", "p_toxic", F.col("flagged").alias("toxic"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host is the document's source, path its language within the source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ids = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(quality.SAMPLE)
    weights = quality.fit_quality(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))  # at most SAMPLE ids
    out = quality.hierarchical_quality(docs, F.col("source"), F.col("lang"), weights, keep=["doc_id"])
    return out.select("doc_id", "evidence", "host_mean", "path_mean", "quality", "kept")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return hmm.hmm_scores(table(spark, sf_dir, "documents"), held)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = secrets.span_text(F.filter("spans", lambda x: x["kind"] != "random"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: of the sound stream as read back, its pages, packets and damage, end times of its first and last packet, and of its samples level, loudness, peak and crossings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ogg.padded_payload(F.col("text")).alias("payload"), F.octet_length(text_or_empty()).cast("string").alias("notes"))
    media = docs.select("doc_id", ogg.mux_ogg(F.col("payload"), F.col("notes").cast("binary")).alias("media"))
    read = ogg.demux_ogg(media)
    of = lambda serial: F.filter("streams", lambda x: x["serial"] == serial)[0]
    read = read.select("doc_id", "media", of(ogg.SERIAL_SOUND).alias("x"), of(ogg.SERIAL_NOTES)["data"].cast("string").alias("notes"))
    part = lambda name: F.col(f"x.{name}")
    fixed = lambda c: F.format_string("%.6f", c)
    damage = part("bad_pages") + part("lost_pages") + part("stray_pages")
    feature = F.concat_ws(
        ":", *(c.cast("string") for c in (part("codec"), part("rate"), part("pages"), part("packets"), damage, part("granule"))), fixed(part("times")[0]), fixed(F.element_at(part("times"), -1)),
        fixed(part("level")), fixed(part("loudness")), part("peak").cast("string"), part("crossings").cast("string"),
    )
    return read.select(
        "doc_id",
        F.col("notes").cast("long").alias("n_bytes"),
        F.octet_length("x.data").cast("long").alias("payload_bytes"),
        F.sha2("x.data", 256).alias("payload_sha256"),
        F.crc32(F.substring("x.data", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k_inner(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_contiguous(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(pieces, order=["doc_id", "piece"])


#: Stand-in for a domain, which the table lacks: sources dealt by digest.
DOMAIN = "CASE WHEN md5(coalesce(source, '')) < '5' THEN 'web' WHEN md5(coalesce(source, '')) < 'b' THEN 'books' ELSE 'code' END"
WEIGHTS: list[dict[str, int] | None] = [{"web": 5, "books": 3, "code": 2}, {"en": 4, "de": 2, "fr": 2, "es": 2}, None]


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix_to_weights(table(spark, sf_dir, "documents"), levels, WEIGHTS, percent=60, epochs=4, seed=17)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, label)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_lines: lines with a word; n_removed and lost_words: of the removed ones; clean_sha256: of the text without them."""
    out = cleaning.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "cleaned")
    part = lambda name: F.col(f"cleaned.{name}").alias(name)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "lost_words"]
    return out.select("doc_id", *map(part, counts), F.size("cleaned.removed").cast("long").alias("n_removed"), F.sha2(F.col("cleaned.clean").cast("binary"), 256).alias("clean_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality, op3_lm, op4_secrets, op5_ogg, op6_knn, op7_shards, op8_neardup, op9_packing, op10_mixing, op11_negatives, op12_divergence, op13_cleaning)
}

KNN_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT p.vec_id AS query_id, p.e, v.vec_id, CAST(list_sum(list_transform(range(1, len(p.e) + 1), lambda i: p.e[i] * v.e[i])) AS BIGINT) AS score
  FROM p JOIN v ON p.vec_id <> v.vec_id AND len(p.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(t) < 3 THEN array_to_string(t, ' ') ELSE t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] END AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(2, len(t) - 1))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.x, c.y FROM c JOIN n a ON a.doc_id = c.x JOIN n b ON b.doc_id = c.y WHERE 100 * c.m >= 85 * (a.n + b.n - c.m)),
r(x, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.root),
k AS (SELECT x, min(root) AS root FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, k.root AS component_id, w.doc_id = k.root AS kept
FROM w JOIN k ON k.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def mixing_sql(percent: int = 60, epochs: int = 4, seed: int = 17) -> str:
    """Hierarchical budgeting in SQL, level by level."""
    levels = ["domain", "lang", "source"]
    weight = []
    for level, weights in zip(levels, WEIGHTS, strict=True):
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in (weights or {}).items())
        weight.append(f"CASE {cases} ELSE 1 END" if cases else "1")
    parts = [
        f"d AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,"
        r" CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        "t AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
        f"b0 AS (SELECT least(coalesce(sum(tokens), 0) * {percent} // 100, coalesce(sum(tokens), 0) * {epochs}) AS pb FROM t)",
    ]
    for k, level in enumerate(levels):
        up = levels[:k]
        by = ", ".join(up)
        over = f"PARTITION BY {by}" if up else ""
        cols = ", ".join(levels[: k + 1])
        join = f"JOIN b{k} USING ({by})" if up else f"CROSS JOIN b{k}"
        order = f"ORDER BY CAST(supply AS DOUBLE) / w, {level}"
        parts += [
            f"n{k} AS (SELECT x.*, pb FROM (SELECT {cols}, CAST(sum(tokens) AS BIGINT) * {epochs} AS supply, {weight[k]} AS w FROM t GROUP BY {cols}) x {join})",
            f"f{k} AS (SELECT *, supply * (sum(w) OVER ({over}) - coalesce(sum(w) OVER ({over} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
            f" <= w * (pb - coalesce(sum(supply) OVER ({over} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM n{k})",
            f"g{k} AS (SELECT *, pb - coalesce(sum(CASE WHEN full_ THEN supply END) OVER ({over}), 0) AS bl, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({over}) AS wl FROM f{k})",
            f"b{k + 1} AS (SELECT {cols}, CASE WHEN full_ THEN supply ELSE least(supply, w * bl // wl) END AS pb FROM g{k})",
        ]
    parts += [
        f"q AS (SELECT t.*, CASE WHEN tokens > 0 THEN pb // tokens ELSE {epochs} END AS whole FROM t JOIN b3 USING (domain, lang, source)),"
        " q2 AS (SELECT q.*, pb - whole * tokens AS rest FROM q JOIN b3 USING (domain, lang, source))",
        f"e AS (SELECT d.*, whole, rest, md5('{seed}:' || CAST(CAST(whole AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM d JOIN q2 USING (domain, lang, source))",
        "o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, domain, lang, source, n_tokens, CAST(least({epochs}, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END) AS INTEGER) AS copies FROM o"


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, a.e, v.vec_id, v.label, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i])) AS BIGINT) AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
p AS (
  SELECT anchor_id, own, e, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id, own, e ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.own, p.e, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.e = p.e AND s.label <> p.own
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""



def cleaning_sql() -> str:
    """The line rules in SQL; the pattern parts are those of the operator."""
    word = r"[^\x20\x09-\x0D]+"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    number = lambda col, chars: f"len(regexp_replace({col}, '[^{chars}]', '', 'g'))"
    holds = lambda phrases: " OR ".join(f"contains(low, '{x}')" for x in phrases)
    marks, separators = re.escape(cleaning.MARKS).replace("\\&", "&").replace("\\#", "#"), cleaning.SEPARATORS
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, doc_id, text, regexp_extract_all(text, '{word}') AS t FROM d),
x AS (SELECT i, unnest(t) AS a, generate_subscripts(t, 1) AS k FROM w),
y AS (SELECT i, k, a, lead(a) OVER (PARTITION BY i ORDER BY k) AS b, lead(a, 2) OVER (PARTITION BY i ORDER BY k) AS c FROM x),
g AS (SELECT i, k, count(*) OVER (PARTITION BY i, a, b, c) AS n FROM y WHERE c IS NOT NULL),
h AS (SELECT i, count(DISTINCT k + o) AS repeated FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY i),
l AS (SELECT i, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
m AS (
  SELECT *, len(own) AS n, len(own) > 0 AND row_number() OVER (PARTITION BY i, line ORDER BY pos) > 1 AS again, translate(line, {letters}) AS low
  FROM (SELECT *, regexp_extract_all(line, '{word}') AS own FROM l)),
f AS (
  SELECT *, n > 0 AND (
    2 * {number("line", marks + "!")} > n OR NOT (regexp_matches(line, '{cleaning.ENDS}') OR regexp_matches(line, '{cleaning.INNER}'))
    OR ({number("line", separators)} >= 2 AND 4 * {number("line", separators)} >= n) OR (n <= {cleaning.SHORT} AND ({holds(cleaning.LINKS)}))
    OR (n <= {cleaning.NOTICE} AND ({holds(cleaning.NOTICES)})) OR (n >= 10 AND 10 * len(list_distinct(own)) < 3 * n) OR again) AS bad
  FROM m),
s AS (
  SELECT i, sum(CASE WHEN again THEN 1 ELSE 0 END) AS dups, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS filled, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS removed,
    coalesce(string_agg(CASE WHEN NOT bad THEN line END, chr(10) ORDER BY pos), '') AS clean
  FROM f GROUP BY i),
r AS (
  SELECT w.*, len(t) AS n, coalesce(repeated, 0) AS repeated, s.*, len(t) < {cleaning.MIN_WORDS} OR 100 * coalesce(repeated, 0) > {cleaning.MAX_REPEATED} * len(t) AS base
  FROM w JOIN s USING (i) LEFT JOIN h USING (i))
SELECT doc_id, n AS n_words, CAST(coalesce(list_sum(list_transform(t, lambda z: len(z))), 0) AS BIGINT) AS word_chars, CAST({number("text", marks)} AS BIGINT) AS n_symbols,
  CAST(dups AS BIGINT) AS n_dup_lines, repeated AS n_repeat_words, base AS base_failed, NOT base AND 100 * lost <= {cleaning.MAX_LOST} * n AS kept,
  CAST(filled AS BIGINT) AS n_lines, CAST(lost AS BIGINT) AS lost_words, CAST(removed AS BIGINT) AS n_removed, sha256(clean) AS clean_sha256
FROM r
"""


ORACLES = {"op6_knn": KNN_SQL, "op8_neardup": NEARDUP_SQL, "op10_mixing": mixing_sql(), "op11_negatives": NEGATIVES_SQL, "op12_divergence": DIVERGENCE_SQL, "op13_cleaning": cleaning_sql()}
