"""Quality by hierarchical empirical Bayes: document, path, host, corpus.

A linear classifier gives each document evidence p. Hosts and paths get Beta
posteriors from the sums of that evidence: a host's mean is shrunk to the corpus
mean, a path's to its host's, with prior strengths estimated from the spread of the
group means (method of moments). A document's posterior log-odds are its own
evidence plus its path's mean without it, relative to the corpus mean.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, quoted, stage
from .linear import Rows, fit_logistic, sigmoid

SAMPLE = 10_000  # labelled rows that the classifier is fitted on, at most
SYMBOL = re.compile(rb"[!-/:-@\[-`{-~]")
MEASURES = 9


def measures(text: bytes) -> list[float]:
    """Shape of a text: length, variety, repetition, symbols, digits, case, compressibility."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * (MEASURES - 1) + [1.0]
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    symbols = SYMBOL.findall(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n) / 10,
        len(counts) / n,
        same / n,
        max(counts.values()) / n,
        len(symbols) / n,
        (len(symbols) - sum(map(symbols.count, (b".", b",")))) / n,
        sum(map(text.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size,
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / size if size > 64 else 0.5,
    ]


def site_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and first path segment of a URL, for tables that have one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and scales from at most ``sample`` rows, those of least text hash.

    Rows without a label are left out; a null text is an empty one; ties in the hash go
    by text. No rows, or labels of one class: every document gets the prior.
    """

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["_h"], "m": [measures(bytes(t)) for t in pdf["_text"]], "y": pdf["_y"]})

    rows = labelled.where(F.col(label_col).isNotNull()).select(F.xxhash64(as_bytes(text_col)).alias("_h"), as_bytes(text_col).alias("_text"), F.col(label_col).cast("int").alias("_y"))
    got = rows.mapInPandas(shape, "h long, m array<double>, y int").orderBy("h", "y", "m").limit(sample).toPandas()
    x = np.array(got["m"].tolist()).reshape(-1, MEASURES)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(MEASURES), np.ones(MEASURES))
    dense = np.clip((x - mean) / scale, -8, 8)
    w = fit_logistic(Rows([np.empty(0, np.int32)] * len(x), 0, dense), got["y"].to_numpy(dtype=float), l2=1.0, steps=100)
    return w, mean, scale


def as_bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def strength(groups: DataFrame) -> float:
    """Prior strength of Beta group means by the method of moments, weighted by rows.

    ``groups`` has n, s (sum of evidence) and the prior ``mean`` that each is shrunk to.
    """
    gap, noise = F.pow(F.col("s") / F.col("n") - F.col("mean"), F.lit(2.0)), F.col("mean") * (1 - F.col("mean"))
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * gap).alias("v"), F.sum(noise).alias("e"), F.sum(F.col("n") * noise).alias("t")).collect()[0]
    if not row["n"] or not row["t"]:
        return 1.0
    spread = (row["v"] - row["e"]) / row["n"]  # between groups: the sampling noise of a mean is taken off
    return float(min(1e6, max(1.0, row["t"] / row["n"] / max(spread, 1e-9) - 1)))


def hierarchical_quality(docs: DataFrame, host: Column, path: Column, weights: tuple[np.ndarray, np.ndarray, np.ndarray], text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) plus evidence, host_mean, path_mean, quality (posterior) and kept.

    Null hosts and paths count as "". A null or empty text gets the classifier's
    evidence for an empty text. Sites are summed with partial aggregation; their
    sums are joined back as a small table, or with skew splitting if they are many.
    Columns of the result's names are replaced, all others stay whatever their names;
    repeated rows each count; no rows: no rows.
    """
    w, mean, scale = weights

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        x = np.array([measures(bytes(t)) for t in texts]).reshape(-1, MEASURES)
        return pd.Series(sigmoid(np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1]))

    added = ["evidence", "host_mean", "path_mean", "quality", "kept"]
    keys = [c for c in (keep or docs.columns) if c.lower() not in added]
    text = F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")
    scored = docs.select(
        F.struct(*(F.col(quoted(c)) for c in keys)).alias("doc"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        evidence(text).alias("evidence"),
    )
    scored = stage(scored, "quality-evidence")
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).collect()[0]
    corpus = (total[1] + 0.5) / (total[0] + 1.0)
    k_host = strength(hosts.withColumn("mean", F.lit(corpus)))
    host_means = hosts.select("host", ((F.lit(k_host * corpus) + F.col("s")) / (F.lit(k_host) + F.col("n"))).alias("host_mean"))
    means = stage(paths.join(host_means, "host"), "quality-means")
    k_path = strength(means.withColumnRenamed("host_mean", "mean"))
    out = lookup_join(scored, means, ["host", "path"], means.count(), "inner")
    alone = (F.lit(k_path) * F.col("host_mean") + F.col("s") - F.col("evidence")) / (F.lit(k_path) + F.col("n") - 1)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    quality = 1 / (1 + F.exp(-(odds(F.col("evidence")) + odds(alone) - odds(F.lit(corpus)))))
    path_mean = (F.lit(k_path) * F.col("host_mean") + F.col("s")) / (F.lit(k_path) + F.col("n"))
    return out.select(*(F.col("doc")[c].alias(c) for c in keys), "evidence", "host_mean", path_mean.alias("path_mean"), quality.alias("quality"), (quality >= threshold).alias("kept"))
