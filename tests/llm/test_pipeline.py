from __future__ import annotations

import hashlib
import random

import corpus_pipeline as C
import numpy as np
from conftest import edge_rows, sentence
from test_mixing import fill

from oreline.llm import queries, toxicity
from oreline.llm.common import TEXT_ROWS, small_batches


def test_stages_against_plain_python(spark, tmp_path):
    """Toxic documents go, one of each group stays, secrets are masked, the mix holds, all that is left is packed."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = sentence(rng, 60)
        if i % 10 == 0:
            words += " idiot moron scum"
        if i % 10 == 1:
            words += " password=abcdefabcdef123456"
        rows.append((i, words, "en", f"src{i % 4}", len(words)))
    rows += [(1000 + i, "".join(c.upper() if c.isascii() else c for c in rows[i][1]), "en", "src1", len(rows[i][1])) for i in range(2, 40, 10)] + [(2000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    kept = []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    clean = {i for i in range(300) if i % 10} | set(range(1002, 1040, 10)) | {2000}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - set(range(1002, 1040, 10))
    for i, r in kept[2].items():
        assert ("[SECRET]" in (r["text"] or "")) == (i % 10 == 1 and i < 300)
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.8 * len(kept[2])
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])
    ends = {}
    for r in packed:
        ends[r["sequence_id"]] = ends.get(r["sequence_id"], 0) + r["length"]
    assert max(ends.values()) <= 4096
    assert C.run(spark, str(tmp_path)).count() == len(packed)


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and C.ORACLE_SQL is None
    assert len(queries.QUERIES) == 10


def test_near_copies_by_five_words_from_four_fifths_on(spark, tmp_path):
    """A copy with a fifth appended goes (0.83); one with three tenths appended stays (0.77)."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        words = [f"w{rng.random()}" for _ in range(204)]
        more = [f"x{rng.random()}" for _ in range(40 if i % 2 else 60)]
        rows += [(i, " ".join(words), "en", "src1", 1), (100 + i, " ".join(words + more), "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(40)) | set(range(100, 140, 2))


def test_near_copies_with_words_changed(spark, tmp_path):
    """Words changed apart in 200 shingles of five: with four, 180 of 220 are common (0.82); with eight, 160 of 240 (0.67), but 178 of 226 of three."""
    rng = random.Random(10)
    rows = []
    for i in range(20):
        words = [f"w{rng.random()}" for _ in range(204)]
        near = list(words)
        for k in range(8 if i % 2 else 4):
            near[10 + 20 * k] = f"x{rng.random()}"
        rows += [(i, " ".join(words), "en", "src1", 1), (100 + i, " ".join(near), "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(20)) | set(range(101, 120, 2))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _rep long, n long, sequence_id string"


def test_edge_rows_in_every_stage(spark, tmp_path):
    """Null, empty, blank and very long texts, repeated rows and clashing columns; without labels nothing is toxic."""
    rows = [(t, i) for i, t in edge_rows()]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1, 2, "y") for t, i in rows], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = C.drop_toxic(spark, docs, str(tmp_path))
    assert clean.count() == len(rows) and clean.columns == docs.columns
    left = C.drop_near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert {None, 100, 101, 102, 103, 105} <= set(ids) and not {104, 106, 109} & set(ids)
    masked = C.mask_secrets(spark, docs, str(tmp_path))
    assert masked.count() == len(rows) and masked.columns == docs.columns
    assert sorted(str(r["text"]) for r in masked.collect()) == sorted(str(t) for t, _ in rows)
    mixed = C.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and 0 < mixed.count() <= len(rows)
    packed = C.pack_documents(spark, docs, str(tmp_path))
    assert sum(r["start"] == 0 for r in packed.collect()) == len(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_mixing_against_plain_python(spark, tmp_path):
    """The documents that a budget of MIX_PERCENT leaves, by the budgets' plain form."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", "fr", None]), f"src{rng.randrange(5)}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in C.mix_sources(spark, docs, str(tmp_path)).collect()}
    domain = lambda s: "web" if (h := hashlib.md5(s.encode()).hexdigest()) < "5" else "books" if h < "b" else "code"
    leaf = {i: (domain(s), lang or "", s) for i, _, lang, s, _ in rows}
    size = {i: len(t.split()) for i, t, *_ in rows}
    budget = {(): sum(size.values()) * C.MIX_PERCENT // 100}
    for k in range(3):
        for up, b in [x for x in budget.items() if len(x[0]) == k]:
            names = sorted({p[k] for p in leaf.values() if p[:k] == up})
            weights = queries.WEIGHTS[k] or {}
            supply = {n: sum(size[i] for i, p in leaf.items() if p[: k + 1] == (*up, n)) for n in names}
            budget |= {(*up, n): v for n, v in fill([(n, supply[n], weights.get(n, 1)) for n in names], b).items()}
    want = set()
    for p in set(leaf.values()):
        ids = sorted((i for i in leaf if leaf[i] == p), key=lambda i: hashlib.md5(f"17:{0 if budget[p] < sum(size[j] for j in leaf if leaf[j] == p) else 1}:{i}".encode()).hexdigest())
        total = 0
        if budget[p] >= sum(size[i] for i in ids):
            want |= set(ids)
            continue
        for i in ids:
            total += size[i]
            if total > budget[p]:
                break
            want.add(i)
    assert got == want


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """Jobs of the stages that hand whole texts to Python run under the bound, and the session has its own again afterwards."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    own = spark.conf.get(key)
    docs = spark.range(2 * TEXT_ROWS + 500, numPartitions=1).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang", "'src1' AS source", "10L AS n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = lambda df: df.select("doc_id").mapInPandas(lambda batches: (x.assign(doc_id=len(x)).head(1) for x in batches), "doc_id long")

    def spied(module, name):
        def run(df, *args, **how):
            seen[name] = max(r[0] for r in sizes(docs).collect())
            return kept(df, *args, **how)

        kept = getattr(module, name)
        monkeypatch.setattr(module, name, run)

    spied(C.toxicity, "score_chain")
    spied(C.neardup, "near_duplicates")
    spied(C.packing, "pack_pieces")
    stages = dict(C.STAGES)
    for name in ("toxicity", "near_duplicates", "packing"):
        stages[name](spark, docs, str(tmp_path))
        assert spark.conf.get(key) == own
    assert seen == {"score_chain": TEXT_ROWS, "near_duplicates": TEXT_ROWS, "pack_pieces": TEXT_ROWS}
    spark.conf.set(key, "7")
    try:
        with small_batches(spark):
            assert max(r[0] for r in sizes(docs).collect()) == 7
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, own)


def test_scores_do_not_depend_on_slices(spark):
    """Rows beyond TEXT_ROWS of one Arrow batch are scored, in their order."""
    words = ["idiot", "kind", "moron", "calm", "even"]
    rows = [(i, f"{words[i % 5]} {words[i % 3]} text") for i in range(2 * TEXT_ROWS + 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lists = toxicity.feature_lists([t.encode() for _, t in rows], None, {})
    chain = toxicity.train_chain(lists[:100], np.array([[int(i % 5 in (0, 2))] for i in range(100)]), ["toxic"])
    kept = [np.array(sorted(chain.known[x] for x in row.tolist() if x in chain.known), np.int32) for row in lists]
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.score_chain(docs, chain).collect()}
    assert len(got) == len(rows) and np.allclose([got[i] for i in range(len(rows))], chain.score(kept)[:, 0], rtol=0, atol=1e-12)
