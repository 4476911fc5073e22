"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "ün", "sol") for b in ("da", "rin", "vex", "o", "pé", "zun", "bal")]
SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, _id long, spans string, n_tokens string, evidence double, flagged int, row long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    base = sentence(rng, 120)
    near = base.split()
    near[7] = "changed"
    rows: list[tuple[int | None, str | None]] = [(i, sentence(rng, rng.randint(1, 60))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, long), (104, long), (105, base), (106, " ".join(near)), (107, base.upper()), (108, "one"), (109, "ONE"), (110, "two words"), (None, base), (None, None), (105, base), (111, "ünïcode 中文 😀 text"), (112, "a b c")]
    return rows


def as_documents(spark, rows):
    """Documents with other columns, some named like the operators' own."""
    full = [(t, i, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", len(t or ""), 1, "x", "y", 0.5, 1, 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return as_documents(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return as_documents(spark, [])
