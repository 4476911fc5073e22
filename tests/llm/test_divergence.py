"""The audit against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from oreline.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, min_docs: int, top: int = 50) -> list[tuple]:
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        docs[lang].update(set(terms(text)))
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows, min_docs: int) -> list[tuple]:
    df = spark.createDataFrame([(t, s, lang, i, "x", 3) for i, (lang, s, t) in enumerate(rows)], "text string, source string, lang string, n int, `key` string, `_v` int").repartition(3)
    got = D.audit_sources(df, min_docs=min_docs).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(map(tuple, got))


def sample(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = [a + b for a in ("ka", "Lo", "mÜ", "ter", "naïve", "中") for b in ("da", "RIN", "é", "zun", "")] + ["w" * 90, "w" * 89 + "É", "x" * 300]
    rows = [(r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", None, "Z", "é"]), "".join(r.choice(words) + r.choice([" ", ", ", "1", "\n", "_", " - "]) for _ in range(r.randint(0, 30)))) for _ in range(120)]
    rows += [("en", "a", "kada " * 500), ("en", "a", "kada " * 500), ("en", "empty", None), ("en", "blank", " 12 "), ("fr", "only", "kada"), ("es", "p", None), ("es", "q", ""), (None, "a", None)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_exact(spark, seed):
    rows = sample(seed)
    assert audited(spark, rows, 4) == brute(rows, 4)


def test_in_small_blocks(spark, monkeypatch):
    """Many automata, blocks of sources, chunks of terms, and counts passed on early."""
    for name, value in {"BLOCK_TERMS": 7, "SOURCES": 2, "TERMS": 5, "FLUSH": 10, "HITS": 50}.items():
        monkeypatch.setattr(D, name, value)
    rows = sample(5)
    assert audited(spark, rows, 3) == brute(rows, 3)


def test_no_rows(spark):
    assert audited(spark, [], 1) == []
    assert audited(spark, [("en", "a", "x y x")], 1) == [("en", "a", "term", "x", v, 1) for v in () ]  # one source is its language


def test_shares_stay_exact_for_counts_beyond_2_to_the_33(spark):
    n, total, kept = 98_765_432_109, 345_678_901_234_567, 4_321
    row = spark.createDataFrame([(n, total, kept)], "n long, _total long, _v long").select(D.share(D.F.col("n")).alias("p")).collect()[0]
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * kept)
