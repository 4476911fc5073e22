from __future__ import annotations

import hashlib
import re

from conftest import as_documents, edge_rows
from pyspark.sql import functions as F

from oreline.llm import mixing as X

WEIGHTS = [{"a": 3, "b": 1}, None, {"src1": 2}]


def fill(nodes: list[tuple[str, int, int]], budget: int) -> dict[str, int]:
    """Water-filling by repetition: full children leave, the rest share again."""
    out, open_ = {}, dict((n, (s, w)) for n, s, w in nodes if w > 0)
    out.update({n: 0 for n, _, w in nodes if w <= 0})
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (s, w) in open_.items() if s * total <= w * budget]
        if not full:
            return out | {n: min(s, w * budget // total) for n, (s, w) in open_.items()}
        first = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[first] = open_[first][0]
        budget -= open_.pop(first)[0]
    return out


def expected(rows, percent: int, epochs: int, seed: int) -> list[tuple]:
    docs = []
    for i, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        docs.append((i, "a" if (i or 0) % 2 else "b", "" if i == 3 else "en", "" if i == 4 else f"src{(i or 0) % 3}", n))
    supply = {}
    for d in docs:
        supply[d[1:4]] = supply.get(d[1:4], 0) + d[4]
    total = sum(supply.values())
    budgets = {(): min(total * percent // 100, total * epochs)}
    for k in range(3):
        new = {}
        for up, b in budgets.items():
            kids = sorted({leaf[k] for leaf in supply if leaf[:k] == up})
            nodes = [(c, epochs * sum(v for leaf, v in supply.items() if leaf[: k + 1] == (*up, c)), (WEIGHTS[k] or {}).get(c, 1)) for c in kids]
            new |= {(*up, c): v for c, v in fill(nodes, b).items()}
        budgets = new
    out = []
    for leaf, n in supply.items():
        whole = budgets[leaf] // n if n else epochs
        rest = budgets[leaf] - whole * n
        mine = [(hashlib.md5(f"{seed}:{whole}:{'null' if d[0] is None else d[0]}".encode()).hexdigest(), d) for d in docs if d[1:4] == leaf]
        for key, d in mine:
            end = sum(x[4] for k, x in mine if k <= key)
            out.append((-1 if d[0] is None else d[0], *d[1:], min(epochs, whole + (end <= rest))))
    return sorted(out)


def mixed(docs, percent, epochs):
    levels = {"domain": F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 1, "a").otherwise("b"), "l": F.col("lang"), "s": F.col("source")}
    return X.mix_to_weights(docs, levels, WEIGHTS, percent=percent, epochs=epochs, seed=5)


def test_against_repetition(spark, edges):
    for percent, epochs in ((60, 4), (100, 1), (250, 3), (0, 2)):
        got = mixed(edges, percent, epochs).select("doc_id", "domain", "l", "s", "n_tokens", "copies").collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == expected(edge_rows(), percent, epochs, 5)


def test_other_columns_stay(edges):
    out = mixed(edges, 50, 2)
    assert {"_id", "spans", "evidence", "lang", "source"} <= set(out.columns)


def test_columns_of_working_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", "en", "x", 5, 6, 7), (2, None, None, None, 5, 6, 7)], "doc_id long, text string, lang string, source string, _rid int, _whole int, _last int")
    out = mixed(df, 100, 1).collect()
    assert [(r["_rid"], r["_whole"], r["_last"], r["copies"]) for r in out] == [(5, 6, 7, 1)] * 2


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "x " * 10) for i in range(0, 40)]
    docs = as_documents(spark, rows)
    got = {r["domain"]: r["t"] for r in mixed(docs, 50, 1).groupBy("domain").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert got["a"] > got["b"]


def test_nothing(nothing):
    assert mixed(nothing, 50, 2).count() == 0
