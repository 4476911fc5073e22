"""Line rules: single lines, whole texts by a plain count, and clean documents left alone."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from oreline.llm import cleaning as C
from oreline.llm import queries as Q

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("A sentence of some words.", None),
        ("A long paragraph. Its last words lack a mark", None),
        ("Words without any mark", "punctuation"),
        ("STOP!! NOW!! HERE!!", "punctuation"),
        ("a*** b%%% c&&& d.", "punctuation"),
        ("Home | News | Sport | More.", "navigation"),
        ("Read more...", "navigation"),
        ("All rights reserved.", "boilerplate"),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("He had licensed under that name for a long time, and " + "so it went on and on, " * 6 + "as they say.", None),
        ("word " * 20 + ".", "boilerplate"),
        ("“So it was,” she said.”", None),
        ("El niño llegó.\r", None),
    ],
)
def test_rules(line, rule):
    assert C.failed_rule(line, line.encode().split()) == rule


def brute(text: str) -> tuple:
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), base


def test_counts(spark, edges):
    for r in C.clean_lines(edges, out="cleaned").select("doc_id", "text", "cleaned").collect():
        c = r["cleaned"]
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], c["base_failed"]) == brute(r["text"] or "")
        removed = {x["line"] for x in c["removed"]}
        assert c["clean"] == "\n".join(x for i, x in enumerate((r["text"] or "").split("\n")) if i not in removed)


def test_columns_stay_and_no_rows(spark, edges, nothing):
    out = C.clean_lines(edges, out="SPANS")  # replaces the column of that name
    assert sorted(x.lower() for x in out.columns) == sorted(x.lower() for x in edges.columns) and out.count() == edges.count()
    assert C.clean_lines(nothing).count() == 0


def test_documents_that_lose_their_text_are_rejected(spark):
    good = "This is a sentence of eight plain words.\n"
    distinct = "".join(f"This{i} is a{i} sentence{i} of nine{i} plain{i} words{i} here{i}.\n" for i in range(20))
    menu = "".join(f"home{i} | news{i} | sport{i} | more{i}\n" for i in range(30))
    rows = [(1, distinct), (2, distinct + menu[:200]), (3, distinct[:400] + menu), (4, good * 20), (5, "few words.")]
    got = {r["doc_id"]: r["cleaned"] for r in C.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [True, True, False, False, False]
    assert [got[i]["base_failed"] for i in range(1, 6)] == [False, False, False, True, True]
    assert {x["rule"] for x in got[2]["removed"]} == {"punctuation"} and got[1]["removed"] == []


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{folder}/labels.parquet' WHERE quality = 1").fetchall()}
    got = {r["doc_id"]: r for r in Q.op13_cleaning(spark, folder).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in good)
