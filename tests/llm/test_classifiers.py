from __future__ import annotations

import math
import random

import numpy as np
from conftest import as_documents, edge_rows, sentence
from pyspark.sql import functions as F

from oreline.llm import quality as Q
from oreline.llm import toxicity as T
from oreline.llm.linear import Rows, fit_logistic, sigmoid


def test_logistic_regression_finds_the_optimum():
    rng = np.random.default_rng(1)
    lists = [np.flatnonzero(rng.random(6) < 0.4).astype(np.int32) for _ in range(300)]
    y = np.array([float(rng.random() < sigmoid(np.array([2.0 * (0 in set(x)) - 1.0]))[0]) for x in lists])
    rows = Rows(lists, 6, rng.normal(size=(300, 2)))
    w = fit_logistic(rows, y, l2=1.0, steps=200)
    gradient = rows.back(sigmoid(rows.dot(w)) - y) + np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 0.1
    assert fit_logistic(rows, np.zeros(300))[:-1].any() == False  # noqa: E712


def labelled(spark, n: int = 400):
    rng = random.Random(2)
    rows, toxic = [], {}
    for i in range(n):
        words = sentence(rng, 40).split()
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "scum,", "Fluxvenom", "fluxbane"])
        toxic[i] = int(i % 4 == 0)
        rows.append((i, " ".join(words)))
    return rows, toxic


def test_chain_on_held_out_rows(spark):
    rows, toxic = labelled(spark)
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items() if i < 300], "doc_id long, toxic int")
    docs = as_documents(spark, rows + [(1000 + (i or 0), t) for i, t in edge_rows()]).repartition(3)
    got = {r["doc_id"]: r for r in T.toxicity(docs, labels).collect()}
    hits = sum(got[i]["flagged"] == bool(toxic[i]) for i in range(300, 400))
    assert hits >= 95
    assert not any(got[1000 + i]["flagged"] for i in (100, 101, 102))
    assert set(docs.columns) - {"flagged"} <= set(T.toxicity(docs, labels).columns)


def test_out_of_fold_log_odds_feed_later_models():
    rng = np.random.default_rng(3)
    first = rng.random(400) < 0.5
    lists = [np.array([1 if f else 2, 10 + i % 7], np.int32) for i, f in enumerate(first)]
    chain = T.train_chain(lists, np.column_stack([first, first]).astype(int), ["a", "b"])
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 0
    known = [np.array([chain.known[x] for x in row.tolist()], np.int32) for row in lists]
    assert ((chain.score(known)[:, 1] > 0.5) == first).all()


def test_chain_without_labels_or_rows(spark, edges, nothing):
    """Nothing learnt, nothing flagged: no labels, null labels, or labels of one class."""
    for labels in ([], [(i, None) for i in range(60)], [(i, 0) for i in range(60)], [(i, 1) for i in range(60)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        for threshold in (None, 0.2):
            out = T.toxicity(edges, table, threshold).collect()
            assert len(out) == len(edge_rows())
            assert not any(r["flagged"] for r in out)
        assert T.toxicity(nothing, table).count() == 0


def test_chain_of_label_columns(spark):
    """Categories that the labels name, in their order, without seed words; clashing columns stay."""
    rows, toxic = labelled(spark)
    labels = spark.createDataFrame([(i, t, t) for i, t in toxic.items()], "doc_id long, rude int, toxic int")
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, _p int")
    out = T.toxicity(docs, labels, categories=("rude", "toxic"), seeds={}).collect()
    assert sum(r["flagged"] == bool(toxic[r["doc_id"]]) for r in out) > 390
    assert all(r["_p"] == r["doc_id"] and 0 < r["p_rude"] < 1 for r in out)


def junk(rng):
    return " ".join([rng.choice(["the", "a"])] * 60) if rng.random() < 0.5 else " ".join(w + "$$$" for w in sentence(rng, 40).split())


def test_quality(spark, nothing):
    rng = random.Random(4)
    rows = [(i, junk(rng) if i % 5 == 0 else sentence(rng, 80)) for i in range(500)]
    docs = as_documents(spark, rows + [(1000 + (i or 0), t) for i, t in edge_rows()]).repartition(3)
    weights = Q.fit_quality(docs.where("doc_id < 300").withColumn("quality", (F.col("doc_id") % 5 != 0).cast("int")))
    out = Q.hierarchical_quality(docs, F.col("source"), F.col("lang"), weights)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count()
    assert sum(got[i]["kept"] == (i % 5 != 0) for i in range(300, 500)) >= 190
    assert Q.hierarchical_quality(nothing, F.col("source"), F.col("lang"), weights).count() == 0


def test_shrinkage(spark):
    """Path and host means by hand: sums shrunk to the level above with the estimated strengths."""
    rng = random.Random(5)
    rows = [(i, junk(rng) if i % 3 == 0 else sentence(rng, 80)) for i in range(240)]
    docs = as_documents(spark, rows)
    weights = Q.fit_quality(docs.withColumn("quality", (F.col("doc_id") % 3 != 0).cast("int")))
    got = Q.hierarchical_quality(docs, F.col("source"), (F.col("doc_id") % 2).cast("string"), weights).collect()
    total = sum(r["evidence"] for r in got)
    corpus = (total + 0.5) / (len(got) + 1)

    def strength(groups, means):
        n = sum(len(g) for g in groups)
        noise = [m * (1 - m) for m in means]
        v = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means))
        return min(1e6, max(1.0, sum(len(g) * e for g, e in zip(groups, noise)) / n / max((v - sum(noise)) / n, 1e-9) - 1))

    hosts, paths = {}, {}
    for r in got:
        hosts.setdefault(r["source"], []).append(r["evidence"])
        paths.setdefault((r["source"], r["doc_id"] % 2), []).append(r["evidence"])
    kh = strength(list(hosts.values()), [corpus] * len(hosts))
    mean_of = {k: (kh * corpus + sum(h)) / (kh + len(h)) for k, h in hosts.items()}
    kp = strength(list(paths.values()), [mean_of[h] for h, _ in paths])
    odds = lambda x: math.log(x / (1 - x))
    for r in got:
        p, host = paths[r["source"], r["doc_id"] % 2], mean_of[r["source"]]
        alone = (kp * host + sum(p) - r["evidence"]) / (kp + len(p) - 1)
        quality = 1 / (1 + math.exp(-(odds(r["evidence"]) + odds(alone) - odds(corpus))))
        assert abs(r["quality"] - quality) < 1e-6 and r["kept"] == (r["quality"] >= 0.5)
        assert abs(r["host_mean"] - host) < 1e-6
        assert abs(r["path_mean"] - (kp * host + sum(p)) / (kp + len(p))) < 1e-6


def test_quality_keeps_columns_of_working_names(spark):
    df = spark.createDataFrame([(1, "a b", 2, 3, 4, 5), (None, None, 6, 7, 8, 9)], "doc_id long, text string, n int, s int, host int, mean int")
    out = Q.hierarchical_quality(df, F.lit("h"), F.lit(None).cast("string"), Q.fit_quality(df.withColumn("quality", F.lit(None).cast("int"))))
    assert out.columns == [*df.columns, "evidence", "host_mean", "path_mean", "quality", "kept"]
    assert sorted((r["n"], r["s"], r["host"], r["mean"], r["text"]) for r in out.collect()) == [(2, 3, 4, 5, "a b"), (6, 7, 8, 9, None)]


def test_site_parts(spark):
    df = spark.createDataFrame([("HTTPS://u:p@Blog.Example.com:80/en/7#x",), ("http://a.org",), ("none",)], "u string")
    host, path = Q.site_parts(F.col("u"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [("blog.example.com", "en"), ("a.org", ""), ("", "")]
