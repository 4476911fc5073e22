"""Every registered query against its SQL at the smallest size."""

from __future__ import annotations

import math

import duckdb
import pytest

from oreline import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL: assignments in order, recursive or model-like; tests/test_factcheck.py checks them in plain Python.
WALKED = {"join_04_endpoint_match", "join_07_table_match", "mod_01_importance", "mod_02_diagnosis", "mod_10_criteria", "mod_14_fact_check", "mod_14_gaps", "mod_16_process_items", "mod_23_cycles", "mod_23_witness_cycles", "scl_17_repaired_json"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, db, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = db.execute(catalog.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == cols
    assert got == sorted(repr([plain(r[at.index(c)]) for c in cols]) for r in found.fetchall())


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WALKED
