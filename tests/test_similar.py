"""Similar token sets: joined by rare tokens and counted in blocks, against plain Python, and no candidates in a shuffle."""

from __future__ import annotations

import random

import numpy as np
import pytest

from oreline.operators import factcheck as C
from oreline.operators import matching as M
from oreline.operators import similar as S


def sets(n: int, seed: int) -> list[tuple[int, list[str]]]:
    """Sets over a skewed vocabulary, some empty, some twice, some with the separators of keys in their tokens."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["a\u0001b", "a", "b", "1:a"]
    out = [(i, sorted({words[min(len(words) - 1, int(draw.expovariate(0.12)))] for _ in range(draw.randrange(14))})) for i in range(n)]
    return out + [(n, ["a\u0001b"]), (n + 1, ["a", "b"]), (n + 2, out[1][1]), (n + 3, out[2][1])]


def score(a: list[str], b: list[str], contained: bool) -> float:
    both = len(set(a) & set(b))
    return both / (len(a) if contained else len(set(a) | set(b))) if a and b else 0.0


@pytest.mark.parametrize("few", [-1, 10**12], ids=["blocks", "joined"])
@pytest.mark.parametrize(("threshold", "contained"), [(0.3, False), (0.7, False), (0.5, True)])
def test_all_pairs(spark, monkeypatch, few, threshold, contained):
    for name, value in (("FEW", few), ("LEAST_BLOCK", 25), ("BLOCK_TOKENS", 300)):
        monkeypatch.setattr(S, name, value)
    left, right = sets(70, 1), sets(60, 2)
    found = S.similar_sets(spark.createDataFrame(left, "x long, tokens array<string>"), spark.createDataFrame(right, "y long, tokens array<string>"), threshold, contained)
    want = {(i, j): score(a, b, contained) for i, a in left for j, b in right}
    assert {(r["x"], r["y"]): r["score"] for r in found.collect()} == {k: v for k, v in want.items() if v >= threshold}
    assert found.count() == sum(v >= threshold for v in want.values())


@pytest.mark.parametrize("often", [1e-9, 0.05, 2.0])
def test_kernel(monkeypatch, often):
    """Whatever is counted by product and whatever by postings, and however small the arrays are."""
    monkeypatch.setattr(S, "OFTEN", often)
    monkeypatch.setattr(S, "CELLS", 37)
    draw = np.random.default_rng(3)
    side = lambda n: sorted((np.unique(np.minimum(draw.geometric(0.1, draw.integers(1, 20)), 30)) for _ in range(n)), key=len)
    a, b = side(40), side(30)
    flat = lambda x: (np.array([len(y) for y in x]), np.concatenate(x))
    for threshold, contained in ((0.3, False), (0.5, True), (1.0, False)):
        got = {(int(i), int(j)): s for x, y, z in S.counted(*flat(a), *flat(b), threshold, contained) for i, j, s in zip(x, y, z, strict=True)}
        want = {(i, j): score(list(p), list(q), contained) for i, p in enumerate(a) for j, q in enumerate(b)}
        assert got == {k: v for k, v in want.items() if v >= threshold}


def crowded(spark, *more: str):
    """Rows of which any two share a rare word, though hardly any two are alike."""
    rows = [(i, i % 7, f"o{i % 3}", [f"{x}-{(i * (x + 1)) // (3 + x) % 4}" for x in range(9)]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, created long, outcome string, tokens array<string>").select("id", *more, "tokens")


def assert_uncrowded(df) -> None:
    """Pairs are made within tasks: nothing that grows with the number of candidates is joined or shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
    assert "BroadcastExchange" not in plan


def test_overlaps_are_counted_in_blocks(spark):
    assert_uncrowded(M.overlap_pairs(crowded(spark), 0.5))


def test_jaccard_pairs_are_counted_in_blocks(spark):
    rows = crowded(spark)
    assert_uncrowded(M.token_pairs(rows.withColumnRenamed("id", "src"), rows.withColumnRenamed("id", "doc"), 0.3))


def test_conflicts_are_counted_in_blocks(spark):
    rows = crowded(spark, "created", "outcome").selectExpr("id", "created", "outcome", "array_join(tokens, ' ') as condition")
    found = C.conflicts(rows)
    assert_uncrowded(found)
    r = [(x["id"], x["created"], x["outcome"], x["condition"].split()) for x in rows.collect()]
    want = {(a[0], b[0], score(a[3], b[3], True)) for a in r for b in r if (a[1] > b[1] or (a[1] == b[1] and a[0] < b[0])) and a[2] != b[2]}
    assert {tuple(x) for x in found.collect()} == {w for w in want if w[2] >= 0.5}


def test_names_are_kept_once_at_the_threshold(spark, monkeypatch):
    """0.7 itself is found by token_pairs and left out by a query that wants more, in blocks as well."""
    monkeypatch.setattr(S, "FEW", -1)
    ten = [f"w{i}" for i in range(10)]
    rows = spark.createDataFrame([(1, ten), (2, ten[:7]), (3, ten), (4, ten[:8])], "id long, tokens array<string>")
    found = M.token_pairs(rows.withColumnRenamed("id", "src"), rows.withColumnRenamed("id", "doc"), 0.7).where("src < doc")
    assert_uncrowded(found)
    assert {tuple(r) for r in found.collect()} == {(1, 2, 0.7), (1, 3, 1.0), (1, 4, 0.8), (2, 3, 0.7), (2, 4, 0.875), (3, 4, 0.8)}
