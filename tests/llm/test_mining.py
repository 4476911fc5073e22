"""Hard negatives against a plain search over all rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from oreline.llm import mining as M


def brute(rows, positives: int = 5, negatives: int = 5, scale: int = 256) -> list[tuple]:
    use = [(i, lab, tuple(math.floor(scale * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, v in sorted({r for r in use if r[0] % 5 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, lab) for j, lab, w in use if j != a and len(w) == len(v))
        for p, i, _ in [r for r in scored if r[2] == own][:positives]:
            found = [(s, j) for s, j, lab in scored if lab != own and 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(v, i, lab, 1, 2) for i, lab, v in rows], "embedding array<double>, vec_id long, label int, _cell int, score int").repartition(3)
    return sorted(map(tuple, M.hard_negatives(df, F.col("_id") % 5 == 0, F.col("label"), **options).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_exact(spark, seed, monkeypatch):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) + 1 for _ in range(4)]
    rows = [(i, r.randrange(3), hot if r.random() < 0.3 else [(r.gauss(0, 1) + 1) * r.choice([0.1, 1, 30]) for _ in range(4)]) for i in range(160)]
    rows += [(500, 1, None), (505, 1, [1.0, None, 2.0, 3.0]), (510, 1, [float("nan"), 1.0, 1.0, 1.0]), (515, 2, [float("inf"), 1.0, 1.0, 1.0]), (520, 0, [0.0] * 4), (521, 1, []), (None, 1, [1.0] * 4), (525, None, [1.0] * 4)]
    rows += [(530 + i, i % 2, [r.gauss(0, 1) + 1, r.gauss(0, 1)]) for i in range(12)]  # vectors of another length
    if seed == 1:  # repeated candidates
        rows += [(7, *rows[7][1:])] * 3
    monkeypatch.setattr(M, "LEAF", 12)
    monkeypatch.setattr(M, "PARTITION", 40)
    monkeypatch.setattr(M, "PART", 4)
    monkeypatch.setattr(M, "FIRST", 8)
    monkeypatch.setattr(M, "GROWTH", 3)
    assert mined(spark, rows) == brute(rows)


def test_annuli_spare_most_leaves_of_clustered_vectors(spark, monkeypatch):
    r = random.Random(5)
    centres = [[r.gauss(0, 10) for _ in range(6)] for _ in range(12)]
    rows = [(i, i % 24 // 12, [c + r.gauss(0, 0.3) for c in centres[i % 12]]) for i in range(1200)]
    monkeypatch.setattr(M, "LEAF", 25)
    monkeypatch.setattr(M, "FIRST", 50)
    figures: dict = {}
    assert mined(spark, rows, figures=figures) == brute(rows)
    sent, all_pairs = sum(n for n, _ in figures["sent"]), figures["sent"][0][1]
    print(f"rounds: {len(figures['sent'])}, (anchor, leaf) pairs sent: {sent / all_pairs:.3f} of all")
    assert sent < all_pairs


def test_large_components_and_few_rows(spark):
    big = [(0, 1, [1e7, 1.0]), (1, 1, [1e7, 2.0]), (2, 2, [9.7e6, 1.0]), (5, 2, [9.6e6, 3.0])]
    assert mined(spark, big) == brute(big) != []
    assert mined(spark, []) == []
    assert mined(spark, [(5, 1, [1.0, 2.0])]) == []
    assert mined(spark, [(1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0])]) == []  # no anchors
    assert mined(spark, [(5, 1, [-1.0, 0.0]), (6, 1, [1.0, 0.0]), (7, 2, [1.0, 0.0])]) == []  # a positive below 0
