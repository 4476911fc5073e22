"""Stored tables: what a change writes and a page reads; exact quantiles of one hot key."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from oreline.operators import relational as R
from oreline.operators.stored import BucketedTable, SortedTable

SCHEMA = "id long, name string, n long"


def files(folder: str) -> dict[str, tuple[int, float]]:
    """Size and time of each data file."""
    out = {}
    for at, _, names in os.walk(f"{folder}/rows"):
        out |= {f"{at}/{n}": (os.path.getsize(f"{at}/{n}"), os.path.getmtime(f"{at}/{n}")) for n in names if n.endswith(".parquet")}
    return out


def test_a_change_writes_the_buckets_that_it_touches(spark, tmp_path):
    path, rows = f"{tmp_path}/t", {i: (i, f"name {i}", i % 7) for i in range(4000)}
    t = BucketedTable.create(spark.createDataFrame(list(rows.values()), SCHEMA), path, ["id"], buckets=32)
    before = files(path)
    change = [(5, "five", 1), (5, "cinq", 2), (4001, "new", 3)]
    u = t.upsert(spark.createDataFrame(change, SCHEMA), F.col("n"))
    rows[5], rows[4001] = change[1], change[2]
    assert sorted(map(tuple, u.read().collect())) == sorted(rows.values()) and u.rewritten == 2
    after = files(path)
    assert all(after[f] == s for f, s in before.items())  # nothing that was there is written
    new = sum(size for f, (size, _) in after.items() if f not in before)
    print(f"bytes written: {new} of {sum(s for s, _ in before.values())}")
    assert new < sum(s for s, _ in before.values()) * 4 / 32
    assert t.read().count() == 4000  # the version before is still there
    # By ids, where a test holds; then a delete; nulls are keys too.
    v = BucketedTable.open(spark, path).update(spark.createDataFrame([(i, 100) for i in range(10)], "id long, more long"), {"n": F.col("n") + F.col("more")}, F.col("n") < 3)
    rows = {i: (i, a, n + 100 if i < 10 and n < 3 else n) for i, a, n in rows.values()}
    assert sorted(map(tuple, v.read().collect())) == sorted(rows.values())
    w = v.delete(spark.range(100).select("id")).upsert(spark.createDataFrame([(None, "null", 0)], SCHEMA))
    assert w.read().count() == 3902 and w.version == 4
    assert BucketedTable.open(spark, path).version == 4


def test_two_changes_of_one_version_do_not_both_count(spark, tmp_path):
    t = BucketedTable.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), f"{tmp_path}/t", ["id"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "b", 2)], SCHEMA))
    with pytest.raises(RuntimeError, match="another change"):
        t.upsert(spark.createDataFrame([(1, "c", 3)], SCHEMA))
    assert BucketedTable.open(spark, t.path).read().collect()[0]["name"] == "b"


def test_duplicates_and_empty_tables(spark, tmp_path):
    rows = [(i % 50 if i % 9 else None, "x", i) for i in range(200)]
    t = BucketedTable.create(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/d", ["id"], buckets=8).deduplicate(F.col("n"))
    first: dict = {}
    for i, _, n in rows:
        first.setdefault(i, n)
    assert {r["id"]: r["n"] for r in t.read().collect()} == first
    assert t.deduplicate(F.col("n")).rewritten == 0
    e = BucketedTable.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e", ["id"], buckets=4)
    assert e.read().count() == 0 and e.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA)).read().count() == 1


def test_pages_read_the_files_that_hold_them(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.randrange(300), f"{i}", i) for i in range(3000)]
    t = SortedTable.create(spark.createDataFrame(rows, SCHEMA).repartition(7), f"{tmp_path}/s", ["id", "n"], files=20)
    ordered = sorted((i, n) for i, _, n in rows)
    assert t.count() == 3000 and len(t.files) == 20
    of = lambda df: [(x["id"], x["n"]) for x in df.collect()]
    for limit, offset in ((50, 0), (50, 1475), (200, 2900), (1, 2999), (50, 5000)):
        page = t.page(limit, offset)
        assert of(page) == ordered[offset : offset + limit] and len(page.inputFiles()) <= 3
    falling = ordered[::-1]
    for cursor, limit in (((150,), 20), ((7,), 20), ((0,), 5), (ordered[1500], 30)):
        page = t.before(cursor, limit)
        assert of(page) == [x for x in falling if x[: len(cursor)] < cursor][: limit + 1] and len(page.inputFiles()) <= 3
    assert of(t.before(None, 10)) == falling[:11]
    assert SortedTable.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", ["id", "n"], files=3).page(10).count() == 0


def test_quantiles_of_one_hot_key(spark):
    r = random.Random(1)
    rows = [("k", int(r.gauss(0, 1) * 10 ** r.choice([1, 6, 12]))) for _ in range(5000)] + [("one", 5), (None, 1), (None, 4), ("none", None)] + [("ends", -(2**62)), ("ends", 2**62)]
    figures: dict = {}
    df = spark.createDataFrame(rows, "k string, v long")
    got = {x["k"]: x for x in R.quantiles(df.where("k is null or k <> 'ends'"), "k", "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, figures).collect()}
    assert figures["passes"] <= 7 and set(got) == {"k", "one", None}
    for k in got:
        vs = sorted(v for a, v in rows if a == k and v is not None)
        for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            want = duckdb.execute("SELECT quantile_cont(v, ?) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [p, vs]).fetchone()[0]
            assert got[k][name] == pytest.approx(want, rel=1e-9, abs=1e-3)
        assert (got[k]["least"], got[k]["most"]) == (vs[0], vs[-1])
    ends = R.values_at(spark.createDataFrame([("e", -(2**62), 1), ("e", 7, 1), ("e", 2**62, 1)], "_k string, _v long, _c long"), spark.createDataFrame([("e", i, -(2**62), 2**62) for i in range(3)], "_k string, rank long, lo long, hi long"))
    assert sorted((x["rank"], x["v"]) for x in ends.collect()) == [(0, -(2**62)), (1, 7), (2, 2**62)]
