from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import as_documents, edge_rows
from pyspark.sql import functions as F

from oreline.llm import hmm as H


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), H.END]


def test_forward_and_counts_against_enumeration():
    """All state paths of short texts, one by one."""
    rng = np.random.default_rng(1)
    model = H.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2).T, np.full(4, 0.25))
    texts = [np.array(x, np.int32) for x in ([0, 1, 3], [2], [3, 3, 0, 1, 2], [1, 0])]
    total = H.Expected(4, 2)
    total.add(model, texts)
    emit, step, start = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    likelihoods = []
    for x in texts:
        paths = {}
        for code in range(2 ** len(x)):
            s = [(code >> t) & 1 for t in range(len(x))]
            p = model.start[s[0]] * model.emit[x[0], s[0]]
            for t in range(1, len(x)):
                p *= model.step[s[t - 1], s[t]] * model.emit[x[t], s[t]]
            paths[tuple(s)] = p
        z = sum(paths.values())
        likelihoods.append(math.log(z))
        for s, p in paths.items():
            start[s[0]] += p / z
            for t in range(len(x)):
                emit[x[t], s[t]] += p / z
                if t:
                    step[s[t - 1], s[t]] += p / z
    assert np.allclose(total.emit, emit) and np.allclose(total.step, step) and np.allclose(total.start, start)
    got = np.zeros(len(texts))
    for g in H.groups(texts):
        got[g.rows] = H.forward(model, g)[0]
    assert np.allclose(got, likelihoods)


@pytest.mark.parametrize("head", [150_000, 20])
def test_scores(spark, edges, monkeypatch, head):
    """Base scores are exact, whether words are in the head or joined; so are the model's shares of classes."""
    monkeypatch.setattr(H, "HEAD", head)
    monkeypatch.setattr(H, "OWN", 0.5)
    rows = edge_rows()
    counts = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = H.hmm_scores(edges, held(), states=3).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, is_held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_probabilities_sum_to_one(spark, monkeypatch):
    """Over all words (and one unknown word a class), one-word texts and the empty text share a mass of at most one."""
    monkeypatch.setattr(H, "OWN", 1)
    monkeypatch.setattr(H, "HEAD", 6)
    texts = ["a b c d e f g h", "a a b b c", "a b h h"]
    docs = as_documents(spark, [(i, t) for i, t in enumerate(texts)] + [(100 + i, w) for i, w in enumerate("abcdefgh")] + [(200, ""), (201, "zz")])
    got = {r["doc_id"]: r["score"] for r in H.hmm_scores(docs, F.col("doc_id") >= 100, states=2).collect()}
    mass = sum(10 ** got[100 + i] for i in range(8)) + 10 ** got[200] + 10 ** got[201]
    assert 0 < mass < 1


def test_beats_unigrams_where_there_are_states(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("ba", "bo", "bi", "be") if i % 2 else ("zu", "zy", "zo", "za")) for _ in range(40))) for i in range(200)]
    got = [r for r in H.hmm_scores(as_documents(spark, rows), held(), states=4).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.75 * sum(r["base_score"] for r in got)


def test_nothing_to_train_on(spark, nothing):
    assert H.hmm_scores(nothing, held()).count() == 0
    (r,) = H.hmm_scores(as_documents(spark, [(1, "a b")]), F.lit(True)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def test_every_pass_sees_all_training_texts(spark, monkeypatch):
    """Scores are those of plain passes over all texts, of which the last source is rare and one text is long."""
    monkeypatch.setattr(H, "OWN", 4)
    monkeypatch.setattr(H, "PASSES", 3)
    monkeypatch.setattr(H, "GAIN", 0.02)
    rng = random.Random(4)
    words = [("ba", "bo", "bi"), ("zu", "zy", "zo"), ("ke", "ku", "ki")]
    texts = [" ".join(rng.choice(words[0 if i % 2 else 1] if i < 1990 else words[2]) for _ in range(12)) for i in range(2000)] + [" ".join(rng.choice(words[2]) for _ in range(21_000))]
    docs = as_documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["score"] for r in H.hmm_scores(docs, F.lit(False), states=2, passes=3).collect()}
    v = H.build_vocabulary(H.count_words(docs.select(F.col("text").cast("binary").alias("_text"))))
    coded = [np.array([v.symbol[v.place[w]] for w in tokens(t)], np.int32) for t in texts]
    background = np.concatenate([10 ** v.log_count[: v.own] - 1, v.class_size]) + 1
    model, seen = H.Hmm.random(background / background.sum(), 2), []
    while len(seen) < 3 or seen[-1] - seen[-2] > 0.02 * abs(seen[-2]):
        total = H.Expected(len(model.emit), 2)
        total.add(model, coded)
        model = model.refit(total.emit, total.step, total.start)
        seen.append(total.likelihood)
    for g in H.groups(coded):
        for i, x in zip(g.rows, H.forward(model, g)[0], strict=True):
            assert math.isclose(got[i], x / math.log(10), rel_tol=1e-6)


def test_symbols_grow_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(H, "LEAST_OWN", 0)
    sizes = []
    for n in (100, 10_000):
        v = H.build_vocabulary(spark.createDataFrame([(f"w{i}", 1 + i % 50) for i in range(n)], "word string, c long"))
        sizes.append((v.own, len(v.class_size)))
        assert v.class_size.sum() == len(v.class_size) + sum(2 + i % 50 for i in range(n)) - sum(1 + round(10 ** v.log_count[p] - 1) for p in range(v.own))
    assert sizes[1][0] == 10 * sizes[0][0] == H.OWN * 100 if H.OWN * 10 <= 100 else sizes[1][0] == H.OWN * 100
    assert sizes[1][1] > sizes[0][1]


def test_words_are_split_as_bytes():
    """Odd white space, bytes that are no UTF-8, letters beyond ASCII, blank texts: as bytes.lower().split()."""
    texts = [b"", b" ", b" \t\n", b"a", b" a", b"A\x0bb\x0cc\x1cd\x00e\r\nf ", b"\xff\xfe X\xc3\x84 y", "Ä ß x Y".encode(), b"  a  a  "]
    for rows in (texts, texts[3:4], texts[:1], []):
        sizes, places, words = H.split_words(pa.array(rows, pa.binary()))
        words = words.to_pylist()
        assert sizes.tolist() == [len(x.split()) for x in rows] and b"" not in words
        assert [words[i] for i in places] == [w for x in rows for w in x.lower().split()]


@pytest.mark.parametrize(("states", "group", "block"), [(2, 10**6, 1), (3, 10**6, 7), (4, 150, 64), (5, 60, 10**6)])
def test_blocks_give_the_counts_of_single_texts(monkeypatch, states, group, block):
    """Whatever the sizes of groups and blocks, counts are those of plain recursions over one text after the other."""
    monkeypatch.setattr(H, "GROUP_TOKENS", group)
    monkeypatch.setattr(H, "BLOCK_TOKENS", block)
    rng = np.random.default_rng(states)
    model = H.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(9), states).T, np.full(9, 1 / 9))
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 40, 0, 17, 16, 40, 3, 33, 1, 16, 100)]
    total = H.Expected(9, states)
    total.add(model, texts)
    emit, step, start, likelihood = np.zeros((9, states)), np.zeros((states, states)), np.zeros(states), 0.0
    for x in filter(len, texts):
        alpha, beta = [model.start * model.emit[x[0]]], [np.ones(states)]
        for s in x[1:]:
            alpha.append(alpha[-1] @ model.step * model.emit[s])
        for s in x[:0:-1]:
            beta.insert(0, model.step @ (model.emit[s] * beta[0]))
        z = alpha[-1].sum()
        likelihood += math.log(z)
        start += alpha[0] * beta[0] / z
        for t, s in enumerate(x):
            emit[s] += alpha[t] * beta[t] / z
            if t:
                step += np.outer(alpha[t - 1], model.emit[s] * beta[t]) * model.step / z
    assert np.allclose(total.emit, emit, rtol=1e-10) and np.allclose(total.step, step, rtol=1e-10) and np.allclose(total.start, start, rtol=1e-10) and math.isclose(total.likelihood, likelihood, rel_tol=1e-10)


def test_a_pass_costs_less_than_its_texts_do_in_memory():
    """Emissions and betas are held for a block only: the memory of a group is little more than its alphas."""
    model = H.Hmm.random(np.full(50, 0.02), 8)
    texts = [np.arange(n) % 50 for n in (2000, *[400] * 900)]
    H.Expected(50, 8).add(model, texts[:3])
    tracemalloc.start()
    H.Expected(50, 8).add(model, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * sum(map(len, texts))
