from __future__ import annotations

import math
import random
import re

from conftest import as_documents, edge_rows, sentence

from oreline.llm import neardup as N


def shingles(text: str | None) -> frozenset:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows) -> dict:
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, rows, df=None):
    got = N.near_duplicates(df if df is not None else as_documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(t)) for _, t in rows)


def test_edges(spark, edges):
    check(spark, edge_rows(), edges)


def test_copies_of_one_original_and_chains(spark):
    rng = random.Random(5)
    base = sentence(rng, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 260):  # copies at most of which are linked with the original only
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(150)] = f"new{rng.random()}"
        rows.append((i, " ".join(words)))
    chain = list(base)
    for i in range(40):  # each is linked with the one before
        chain = [*chain[4:], *(f"c{i}_{k}" for k in range(4))]
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, "the same text again and again") for i in range(100)]
    rng.shuffle(rows)
    check(spark, rows)


def test_small_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows, n = [], 0
    for _ in range(12):
        base = sentence(rng, 60).split()
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = f"n{rng.random()}"
            rows.append((n, " ".join(words)))
            n += 1
    for name, value in (("BLOCK", 3), ("DENSE", 4), ("BROADCAST_ROWS", 0), ("SALT", 2)):
        monkeypatch.setattr(N, name, value)
    check(spark, rows)


def test_neighbours_of_a_sorted_order(spark):
    """Adjacent rows by longest prefix, over partition edges too; a dense region asks for longer ones."""
    rng = random.Random(11)
    rows = []
    for region in range(60):
        m = rng.choice([2, 3, 40])
        for i in range(m):
            tail = [rng.randrange(2) for _ in range(N.TAIL)]
            rows.append((region, b"".join(x.to_bytes(2, "little") for x in tail), region * 100 + i, m))
    df = spark.createDataFrame(rows, "_region long, _tail binary, _rep long, m long")
    got = {tuple(r) for r in N.neighbours(df, 5, []).collect()}
    best = {}
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    for lag in range(1, N.REACH + 1):
        for x, y in zip(ordered, ordered[lag:], strict=False):
            lcp = next((i for i in range(N.TAIL) if x[1][2 * i : 2 * i + 2] != y[1][2 * i : 2 * i + 2]), N.TAIL)
            if x[0] == y[0] and lcp >= (5 if x[3] > 31 else 0):
                for side in (("after", x[2]), ("before", y[2])):
                    best[side] = max(best.get(side, (-1, -1)), (lcp, y[2] if side[0] == "after" else x[2]))
    want = {(max(k[1], v[1]), min(k[1], v[1])) for k, v in best.items()}
    assert len(want - got) <= 2 * 8  # edges of partitions know no prefix and may hide a longer one
    assert all(a // 100 == b // 100 for a, b in got)


def test_recall_of_planted_pairs(spark):
    """Pairs at or little above the threshold, each with one partner only, are found."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        words = [f"w{rng.random()}" for _ in range(202)]  # 200 shingles
        rows += [(i, " ".join(words)), (1000 + i, " ".join([*words, *(f"x{rng.random()}" for _ in range(34 if i % 2 else 37))]))]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(as_documents(spark, rows)).collect()}
    linked = sum(got[1000 + i] == i for i in range(1, 300, 2))
    print(f"recall at 200 of 234 shingles: {linked} of 150")
    assert linked == 150 and not any(got[1000 + i] == i for i in range(0, 300, 2))


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_dropping(spark, edges):
    left = N.drop_near_duplicates(edges)
    assert left.columns == edges.columns
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] in (105, 106, 107, 103, 104, 108, 109)} == {103, 105, 107, 108}  # 107: only A-Z are folded, and Ü and É differ


def test_nothing(nothing):
    assert N.near_duplicates(nothing).count() == 0


def test_forest_fits_the_threshold():
    assert sum(math.comb(120, k) * 0.85**k * 0.15 ** (120 - k) for k in range(N.least_agreement(85, 120))) <= N.MISS_AGREE
    assert N.forest_shape(85) == (24, 5)
    for percent in range(30, 100):
        trees, step = N.forest_shape(percent)
        assert (1 - (percent / 100) ** step) ** trees <= N.MISS
