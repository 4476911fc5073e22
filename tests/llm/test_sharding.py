from __future__ import annotations

import random
import zlib

import numpy as np
from conftest import as_documents, edge_rows

from oreline.llm import sharding as S


def brute_capacity(sizes: list[int], n: int) -> int:
    """Least capacity by trying every sum of consecutive sizes."""
    best = sum(sizes) or 1
    sums = {sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}
    for c in sorted(sums):
        k, at = 1, 0
        for s in sizes:
            if s > c:
                k = n + 1
                break
            if at + s > c:
                k, at = k + 1, 0
            at += s
        if k <= n:
            return c
    return best


def test_capacity_and_refinement_are_exact():
    for seed in range(60):
        r = random.Random(seed)
        groups = sorted((f"{r.getrandbits(12):03x}{i:029x}", r.choice([1, 2, 5, 30, 400]), r.randint(1, 3)) for i in range(r.randint(1, 40)))

        def exact(length, within, groups=groups):
            out = {}
            for key, size, rows in groups:
                if within is None or key[: len(within[0])] in within:
                    a = out.setdefault(key[:length], [key, key, 0, 0])
                    a[0], a[1], a[2], a[3] = min(a[0], key), max(a[1], key), a[2] + size, a[3] + rows
            return [(p, *v) for p, v in out.items()]

        n = r.randint(1, 6)
        coarse = S.PREFIX
        try:
            S.PREFIX = 1  # few summaries, so that refinement is needed
            capacity, marks, _ = S.minimax_cuts(exact, n)
        finally:
            S.PREFIX = coarse
        sizes = [g[1] for g in groups]
        assert capacity == brute_capacity(sizes, n)
        got = np.zeros(n, dtype=int)
        for key, size, _ in groups:
            got[sum(key >= m for m, _ in marks)] += size
        assert got.max() <= capacity


def test_edges(spark, edges):
    rows = S.shard_contiguous(edges, n_shards=4).collect()
    assert len(rows) == len(edge_rows())
    by_text, slots = {}, {}
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == want
    for r in rows:
        by_text.setdefault(r["text_digest"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(4))


def test_one_group_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "PARTS", 1)
    monkeypatch.setattr(S, "PART", 20)  # the group is numbered in parts
    docs = as_documents(spark, [(i, "same text") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(50)])
    rows = S.shard_contiguous(docs, n_shards=16).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 550
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_nothing(nothing):
    assert S.shard_contiguous(nothing).count() == 0
