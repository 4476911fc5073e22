"""Names held in texts, by scope and by grams, against plain Python; nothing exploded is sent to all tasks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oreline.catalog import QUERIES
from oreline.operators import factcheck as C
from oreline.operators import gaps as G
from oreline.operators import matching as M
from oreline.plans.factcheck import fact_spec

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [1, 60], ids=["compared", "grams"])
def test_held_in_scopes(spark, crowd):
    draw = random.Random(5)
    word = lambda most: "".join(draw.choice("abc") for _ in range(draw.randrange(most)))
    names = [(i % (120 // crowd), word(5)) for i in range(240)]
    texts = [(i % (120 // crowd), word(9)) for i in range(240)] + [(0, None), (9999, "abc")]
    frame = lambda rows, c: spark.createDataFrame(rows, f"doc long, {c} string")
    found = M.held_in(frame(names, "s"), frame(texts, "l"), ["doc"])
    assert ("_g" in plan(found)) == (crowd == 60)
    want = {(a, s, l) for a, s in names for b, l in texts if a == b and s and l and s in l}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Broadcast" not in plan(found)


def test_orphan_conditions_send_nothing_to_all(spark):
    assert "Broadcast" not in plan(QUERIES["join_20_orphan_conditions"](spark, SF_DIR))


def test_diagnosis_sends_nothing_to_all(spark):
    assert "Broadcast" not in plan(QUERIES["mod_02_diagnosis"](spark, SF_DIR))


def test_spec_gaps_of_several_paths_once(spark):
    draw = random.Random(7)
    paths = [f"/p{i}" for i in range(6)]
    items = [(i, draw.choice(paths)) for i in range(60) for _ in range(draw.randrange(4))] + [(None, "/p1"), (5, None)]
    gaps = [(g, draw.choice(paths)) for g in range(70) for _ in range(draw.randrange(4))] + [(3, None)]
    found = C.path_pairs(spark.createDataFrame(items, "id long, path string"), spark.createDataFrame(gaps, "gap long, path string"), part=4)
    assert Counter(map(tuple, found.collect())) == Counter({(i, g) for i, p in items for g, q in gaps if p is not None and p == q})


def test_pairs_of_a_path_are_not_shuffled(spark):
    """Of one path with 2,000 ids and 2,000 gaps, parts are sent and not four million pairs."""
    items, gaps = (spark.range(2000).selectExpr(f"id as {c}", "'/p' as path") for c in ("id", "gap"))
    found = C.path_pairs(items, gaps)
    assert found.count() == 4_000_000
    tree = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in tree.split("Generate explode(_id")[0]  # from the pairs on, upwards


def test_gaps_of_columns_and_parameters_send_nothing_to_all(spark):
    spec = fact_spec(spark, SF_DIR)
    pairs = spec["tables"].select("src", (F.col("src") + 1).alias("doc"))
    matched = M.match_columns(pairs, spec["columns"], spec["doc_columns"])
    assert "Broadcast" not in plan(matched)
    assert "Broadcast" not in plan(G.column_gaps(pairs, spec["columns"], spec["doc_columns"], matched))
    assert "Broadcast" not in plan(G.parameter_gaps(pairs, spec["params"], spec["doc_params"]))
    assert "Broadcast" not in plan(G.missing_in_document(spec["apis"].withColumn("primary", F.lit(False)), pairs))
