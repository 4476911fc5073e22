from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from oreline.llm import knn as K


def brute(rows, k: int = 5, scale: int = 256) -> list[tuple]:
    use = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and v]
    out = []
    for q, v in sorted({r for r in use if r[0] % 5 == 0}):
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in use if j != q and len(v) == len(w))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_exact(spark, seed, monkeypatch):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(4)]
    rows = [(i, hot if r.random() < 0.3 else [r.gauss(0, 1) * r.choice([0.1, 1, 30]) for _ in range(4)]) for i in range(160)]
    rows += [(500, None), (505, [1.0, None, 2.0, 3.0]), (510, [float("nan"), 1.0, 1.0, 1.0]), (515, [float("inf"), 1.0, 1.0, 1.0]), (520, [0.0] * 4), (521, []), (None, [1.0] * 4)]
    rows += [(530 + i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(12)]  # vectors of another length
    if seed == 3:  # repeated rows, and query rows of one id with vectors of their own
        rows += [(7, rows[7][1]), (10, rows[10][1]), (10, [0.5, 0.5, 0.5, 0.5])] + [(11, rows[11][1])] * 40
    df = spark.createDataFrame([(v, i, 1, 0) for i, v in rows], "embedding array<double>, vec_id long, _cell int, score int").repartition(3)
    monkeypatch.setattr(K, "BLOCK", 20)
    monkeypatch.setattr(K, "PART", 4)
    got = K.top_k_inner(df, F.col("_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_bounds_spare_most_pairs_of_clustered_vectors(spark, monkeypatch):
    r = random.Random(9)
    centres = [[r.gauss(0, 10) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in centres[i % 12]]) for i in range(1200)] + [(3, [0.0] * 6), (3, [0.1] * 6)]  # one id twice
    monkeypatch.setattr(K, "BLOCK", 50)
    figures = {}
    got = K.top_k_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("_id") % 5 == 0, figures=figures).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    sent = sum(n for n, _ in figures.values()) / figures["found-own"][1]
    print(f"share of (query, block) pairs sent: {sent:.3f}")
    assert sent < 0.25


def test_few_or_no_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert K.top_k_inner(df([]), F.col("_id") % 5 == 0).count() == 0
    assert K.top_k_inner(df([(5, [1.0, 2.0])]), F.col("_id") % 5 == 0).count() == 0
    assert len(K.top_k_inner(df([(5, [1.0, 2.0]), (6, [1.0, 1.0]), (7, [0.0, 1.0])]), F.col("_id") % 5 == 0).collect()) == 2
