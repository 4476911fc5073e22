"""Matching, fact check and models against plain Python walks over small tables."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from oreline.functions import rules, severity, specs
from oreline.functions import text as T
from oreline.operators import factcheck as C
from oreline.operators import graph as N
from oreline.operators import matching as M
from oreline.operators import models as D
from oreline.operators import policies as P
from oreline.operators import skills as K
from oreline.plans import factcheck as plans
from oreline.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def walk(wanted: dict[int, list[tuple[str, float]]], offered: list[tuple[int, str]]) -> dict[int, int]:
    """Sources in order; each takes the free document of the key it prefers most, the smallest of equals."""
    free, out = sorted(offered), {}
    for s in sorted(wanted):
        best = max(((p, -doc, doc) for k, p in wanted[s] for doc, key in free if key == k), default=None)
        if best:
            out[s] = best[2]
            free = [x for x in free if x[0] != best[2]]
    return out


def assigned(spark, wanted: dict[int, list[tuple[str, float]]], offered: list[tuple[int, str]], figures: dict | None = None) -> dict[int, int]:
    rows = [(s, k, p) for s, ks in wanted.items() for k, p in ks]
    got = M.assign_keys(spark.createDataFrame(rows, "src long, key string, prefer double").repartition(5), spark.createDataFrame(offered, "doc long, key string").repartition(3), figures=figures).collect()
    assert len({r["src"] for r in got}) == len(got)
    return {r["src"]: r["doc"] for r in got}


@pytest.mark.parametrize("block", [7, 40, 4096])
@pytest.mark.parametrize("seed", range(2))
def test_assignment_is_the_walk(spark, monkeypatch, seed, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SLICE", 4)
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(6)]
    wanted = {s: [(k, float(r.choice([0, 1, 2] if seed else [0]))) for k in r.sample(keys, r.randint(1, 4))] for s in range(60)}
    offered = [(100 + i, r.choice(keys)) for i in range(45)]
    assert assigned(spark, wanted, offered) == walk(wanted, offered)


def test_chains_of_sources_that_push_each_other_on(spark, monkeypatch):
    """Source i wants keys i and i + 1, each with one document, the first key is gone: every choice rests on the one before."""
    monkeypatch.setattr(M, "BLOCK", 20)
    n = 100
    wanted = {0: [("k1", 0.0)]} | {i: [(f"k{i}", 1.0), (f"k{i + 1}", 0.0)] for i in range(1, n)}
    offered = [(1000 + i, f"k{i}") for i in range(1, n)]
    figures: dict = {}
    assert assigned(spark, wanted, offered, figures) == walk(wanted, offered)
    assert len(figures["walked"]) <= figures["blocks"] + 1  # a round settles one more block at least


def test_ties_between_keys_of_interleaved_documents(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 30)
    r = random.Random(4)
    wanted = {i: [("a", 0.0), ("b", 0.0)] if i % 3 else [("b", 0.0), ("c", 0.0)] for i in range(120)}
    offered = [(1000 + i, r.choice("aabc")) for i in range(130)]
    assert assigned(spark, wanted, offered) == walk(wanted, offered)


def test_a_hot_key_is_cut_into_blocks_that_need_no_second_walk(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 50)
    figures: dict = {}
    wanted = spark.range(300).selectExpr("id as src", "'k' as key", "0D as prefer")
    got = M.assign_keys(wanted, spark.range(200).selectExpr("id + 1000 as doc", "'k' as key"), figures=figures)
    assert {r["src"]: r["doc"] for r in got.collect()} == {i: 1000 + i for i in range(200)}
    assert figures["blocks"] == 6 and len(figures["walked"]) <= 3


def test_nothing_to_assign(spark):
    assert assigned(spark, {}, [(1, "a")]) == {} and assigned(spark, {1: [("a", 0.0)]}, []) == {} and assigned(spark, {1: [("b", 0.0)]}, [(1, "a")]) == {}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def endpoint_walk(apis, docs):
    """The three steps in plain Python on normalised spellings: (src, doc, score, method)."""
    out, used, taken = [], set(), set()

    def step(method, choose):
        for s in sorted(apis):
            if s not in used:
                found = choose(apis[s], [d for d in sorted(docs) if d not in taken])
                if found:
                    used.add(s)
                    taken.add(found[0])
                    out.append((s, found[0], found[1], method))

    def exact(a, free):
        for i, k in enumerate(a["keys"]):
            for doc in free:
                if docs[doc]["key"] == k:
                    return doc, 1.0 if i == 0 else 0.9
        return None

    def fuzzy(a, free):
        best = (0.0, None)
        for doc in free:
            for words in a["words"]:
                score = jaccard(words, docs[doc]["words"])
                if score > best[0]:
                    best = (score, doc)
        return (best[1], best[0]) if best[0] >= 0.6 else None

    step("exact", exact)
    step("resource", lambda a, free: next(((d, 0.85) for d in free if docs[d]["resource"] and docs[d]["resource"] in a["resources"]), None))
    step("fuzzy", fuzzy)
    return out


def spelled(spark, paths):
    rows = spark.createDataFrame([(p,) for p in sorted(set(paths))], "p string").select("p", T.normalize_path(F.col("p")).alias("k"), T.resource_path(F.col("p")).alias("r"), T.path_tokens(F.col("p")).alias("w")).collect()
    return {r["p"]: r for r in rows}


def check_endpoints(spark, apis, docs):
    sources = [(s, p, m, alt) for s, p, m, alt in apis]
    paths = [p for _, p, *_ in sources] + [f"{p}/{m}" for _, p, m, _ in sources] + [a for *_, alt in sources for a in alt or []] + [p for _, p in docs]
    by = spelled(spark, paths)
    a = {}
    for s, p, m, alt in sources:
        spellings = [p, *(alt or [])]
        a[s] = {"keys": list(dict.fromkeys(by[x]["k"] for x in [p, *(alt if alt is not None else [f"{p}/{m}"])])), "resources": {by[x]["r"] for x in spellings}, "words": [set(by[x]["w"]) for x in spellings]}
    d = {i: {"key": by[p]["k"], "resource": by[p]["r"], "words": set(by[p]["w"])} for i, p in docs}
    got = M.match_endpoints(spark.createDataFrame(sources, "src long, path string, method string, alternatives array<string>"), spark.createDataFrame(docs, "doc long, path string"))
    assert sorted((r["src"], r["doc"], round(r["score"], 9), r["method"]) for r in got.collect()) == sorted((s, x, round(v, 9), m) for s, x, v, m in endpoint_walk(a, d))


@pytest.mark.parametrize("block", [25, 4096])
def test_endpoints_against_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    r = random.Random(1)
    word = lambda: r.choice(["order", "pay", "gift", "user", "list", "detail"])
    apis = [(i, f"/{r.choice(['api/v1', 'x', 'v2.0'])}/{word()}/{word()}" + r.choice(["", "/{id}", "List"]), word(), r.choice([None, [], [f"/{word()}/{word()}", f"/alt/{word()}"]])) for i in range(40)]
    docs = [(100 + i, f"/{r.choice(['api/V1', 'y', ''])}/{word()}/{word()}" + r.choice(["", "/:key", "/"])) for i in range(40)]
    check_endpoints(spark, apis, docs)


def test_a_null_list_of_spellings_is_not_an_empty_one(spark):
    check_endpoints(spark, [(1, "/a/order", "pay", None), (2, "/b/order", "pay", [])], [(10, "/a/order/pay"), (11, "/b/order/pay")])
    got = M.match_endpoints(spark.createDataFrame([(1, "/a", "b", None)], "src long, path string, method string, alternatives array<string>"), spark.createDataFrame([(9, "/a/b")], "doc long, path string")).collect()
    assert [tuple(x) for x in got] == [(1, 9, 0.9, "exact")]


def test_registered_endpoint_match(spark):
    s = plans.fact_spec(spark, SF_DIR)
    apis = [(r["src"], r["path"], r["method"], r["alternatives"]) for r in s["apis"].collect()]
    check_endpoints(spark, apis, [(r["doc"], r["path"]) for r in s["doc_apis"].collect()])


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_tables_against_a_walk(spark):
    r = random.Random(2)
    name = lambda: r.choice(["TB_", "t_", ""]) + "_".join(r.choice(["ORDER", "PAY", "HIST", "LOG", "ordr", "X"]) for _ in range(r.randint(1, 3)))
    source, docs = {i: name() for i in range(30)}, {100 + i: name() for i in range(30)}
    plain = lambda n: re.sub("^(tb_|t_|tbl_)", "", n.lower())
    out, taken = [], set()
    for exact in (True, False):
        for s in sorted(set(source) - {x[0] for x in out}):
            best = (0.0, None)
            for d in sorted(set(docs) - taken):
                a, b = plain(source[s]), plain(docs[d])
                score = 1.0 if a == b else 0.8 if edits(a, b) < 3 else jaccard(set(filter(None, a.split("_"))), set(filter(None, b.split("_"))))
                if score > best[0] and (a == b or not exact):
                    best = (score, d)
            if best[1] is not None and best[0] >= 0.6:
                taken.add(best[1])
                out.append((s, best[1], best[0]))
    got = M.match_tables(spark.createDataFrame(list(source.items()), "src long, name string"), spark.createDataFrame(list(docs.items()), "doc long, name string")).collect()
    assert sorted((r["src"], r["doc"], round(r["score"], 9)) for r in got) == sorted((s, d, round(v, 9)) for s, d, v in out)


def test_registered_gaps_row_by_row(spark):
    """Every gap of the registered query, from the matches and the specification in plain Python."""
    s = {k: df.collect() for k, df in plans.fact_spec(spark, SF_DIR).items()}
    matches, _ = C.fact_check(plans.fact_spec(spark, SF_DIR))
    m = matches.collect()
    api, tab = ({r["src"]: r["doc"] for r in m if r["kind"] == kind} for kind in ("api", "table"))
    noise_names = {r["name"]: r["why"] for r in spark.createDataFrame([(x["name"], x["n_columns"]) for x in s["tables"]], "name string, n_columns int").distinct().select("name", rules.table_noise(F.col("name"), F.col("n_columns")).alias("why")).collect()}
    noisy = {(r["p"], r["c"]): r["why"] for r in spark.createDataFrame([(x["path"], x["controller"]) for x in s["apis"]], "p string, c string").distinct().select("p", "c", rules.api_noise(F.col("p"), F.col("c")).alias("why")).collect()}
    outside = lambda p: not any(x in p for x in ("/internal/", "/admin/", "/debug/", "/health"))
    want = []
    for a in s["apis"]:
        if a["src"] not in api:
            why = noisy[a["path"], a["controller"]]
            want.append(("api", "MID", "LOW" if why else "HIGH" if outside(a["path"]) else "MEDIUM", a["src"], None, None, why))
    want += [("api", "MC", "HIGH" if d["required"] else "MEDIUM", None, d["doc"], None, None) for d in s["doc_apis"] if d["doc"] not in api.values()]
    want += [("table", "MC", "MEDIUM", None, d["doc"], None, None) for d in s["doc_tables"] if d["doc"] not in tab.values()]
    want += [("table", "MID", "LOW" if noise_names[t["name"]] else "MEDIUM", t["src"], None, None, noise_names[t["name"]]) for t in s["tables"] if t["src"] not in tab]
    for src, doc in tab.items():  # Long in VARCHAR(20); memo is not documented, NOTE not implemented
        want += [("table", "TM", "HIGH", src, doc, "orderId", None), ("table", "SM", "LOW", src, doc, "memo", None), ("table", "SM", "LOW", src, doc, "NOTE", None)]
    for src, doc in api.items():
        want += [("api", "PM", "HIGH", src, doc, "q", None), ("api", "PM", "MEDIUM", src, doc, "size", None)]
    got = [tuple(r[c] for c in ("kind", "gap_type", "severity", "src", "doc", "name", "noise")) for r in QUERIES["mod_14_gaps"](spark, SF_DIR).collect()]
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    assert [x for x in a if x not in b][:3] == [x for x in b if x not in a][:3] == []
    assert a == b


def test_fact_check_adds_up(spark):
    s = plans.fact_spec(spark, SF_DIR)
    matches, gaps = C.fact_check(s)
    m, g = matches.collect(), gaps.collect()
    count = lambda kind, test: sum(1 for x in g if x["gap_type"] == kind and test(x))
    assert count("MID", lambda x: x["kind"] == "api") == s["apis"].count() - sum(x["kind"] == "api" for x in m)
    assert count("MC", lambda x: x["kind"] == "api") == s["doc_apis"].count() - sum(x["kind"] == "api" for x in m)
    assert count("MID", lambda x: x["kind"] == "table") == s["tables"].count() - sum(x["kind"] == "table" for x in m)
    pairs = sum(x["kind"] == "table" for x in m)
    assert count("TM", lambda x: True) == pairs  # Long in VARCHAR(20)
    assert count("SM", lambda x: True) == 2 * pairs  # memo and NOTE
    calls = sum(x["kind"] == "api" for x in m)
    assert count("PM", lambda x: x["name"] == "q") == calls and count("PM", lambda x: x["name"] == "size") == calls
    assert all(x["severity"] == "LOW" for x in g if x["noise"])
    (row,) = QUERIES["mod_14_fact_check"](spark, SF_DIR).collect()
    noise = sum(x["noise"] is not None for x in g)
    assert (row["matched"], row["gaps"], row["noise"]) == (len(m), len(g) - noise, noise)
    assert row["coverage"] == int(len(m) * 1000 / (row["sources"] - noise) + 0.5) / 10


def test_statistics_without_noise(spark):
    g = spark.createDataFrame([(1, "MID", "HIGH", None), (1, "MID", "LOW", None)], "k int, gap_type string, severity string, noise string")
    (r,) = C.statistics(g, "k").collect()
    assert (r["by_gap_type"], r["by_severity"], r["by_noise"]) == ({"MID": 2}, {"HIGH": 1, "LOW": 1}, {})


def test_kpi_of_broken_and_missing_results(spark):
    rows = [(1, None, 5, 8), (2, "{bad", 5, 8), (3, json.dumps({"matchedItems": [{"sourceRef": {"type": "table"}}, {"sourceRef": {"type": "api"}}], "unmatchedSourceApis": 3}), 4, 8), (4, "{}", 2, 8)]
    got = {r["id"]: tuple(r)[1:] for r in C.kpi_split(spark.createDataFrame(rows, "id long, json string, matched long, sources long")).collect()}
    assert got == {1: (5, 0, 3, 0), 2: (5, 0, 3, 0), 3: (2, 2, 2, 0), 4: (2, 0, 0, 0)}


def test_perspective_items(spark):
    """The registered items are among names and units, and cover all that fit on the page."""
    names, units, maps = plans.term_tables(spark, SF_DIR)
    rows = QUERIES["mod_16_process_items"](spark, SF_DIR).collect()
    stem = lambda n: re.sub(r"(?i)(controller|service)$", "", n.lower())
    n, u, m = [r[0] for r in names.collect()], [r[0] for r in units.collect()], [tuple(r) for r in maps.collect()]
    told = {}
    for name in n:
        direct = sorted(x for x in u if stem(name) in stem(x) or stem(x) in stem(name))
        led = sorted((-v, s.lower(), x) for d, s, v in m if d.lower() in name.lower() or name.lower() in d.lower() for x in u if s.lower() in x.lower() or x.lower() in s.lower())
        told[name] = direct[0] if direct else led[0][2] if led else None
    want = {(x, "matched" if told[x] else "gap-in-code") for x in n} | {(x, "gap-in-doc") for x in u if x not in told.values()}
    assert {(r["name"], r["status"]) for r in rows} == want


def before_cycles(edges) -> set:
    """Nodes on or before a cycle: all but those that a walk from the ends backwards removes."""
    into, out = {}, {}
    for a, b in set(edges):
        into.setdefault(b, []).append(a)
        out[a] = out.get(a, 0) + 1
    ends = [n for n in into if not out.get(n)]
    for n in ends:
        for a in into.get(n, ()):
            out[a] -= 1
            if not out[a]:
                ends.append(a)
    return {n for n, k in out.items() if k}


def check_cycles(spark, edges, figures=None) -> None:
    df = spark.createDataFrame(edges, "src long, dst long").repartition(4)
    want = before_cycles(edges)
    assert {r[0] for r in N.cyclic_nodes(df, figures).collect()} == want
    found = N.witness_cycles(df).collect()
    assert len({r["node"] for r in found}) == len(found) and bool(found) == bool(want)
    way = {r["node"]: r for r in found}
    for r in found:
        assert (r["node"], r["next"]) in set(edges) and way[r["next"]]["cycle"] == r["cycle"] <= r["node"]
        at, steps = r["next"], 1
        while at != r["node"]:
            at, steps = way[at]["next"], steps + 1
        assert steps == sum(x["cycle"] == r["cycle"] for x in found)  # one cycle to a name


def test_cycles(spark):
    check_cycles(spark, [(1, 2), (2, 3), (3, 2), (4, 1), (5, 6), (6, 7)])
    check_cycles(spark, [(1, 1), (2, 1), (3, 4)])
    check_cycles(spark, [(1, 2), (2, 3)])
    r = random.Random(8)
    check_cycles(spark, [(r.randrange(60), r.randrange(60)) for _ in range(70)])
    assert N.cyclic_nodes(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_registered_cycles(spark):
    import duckdb

    edges = duckdb.sql(f"SELECT DISTINCT o_custkey, o_orderkey FROM '{SF_DIR}/orders.parquet' WHERE o_custkey <> o_orderkey").fetchall()
    assert {r[0] for r in QUERIES["mod_23_cycles"](spark, SF_DIR).collect()} == before_cycles(edges)
    found = {(r["node"], r["next"]) for r in QUERIES["mod_23_witness_cycles"](spark, SF_DIR).collect()}
    assert found <= set(edges) and {a for a, _ in found} == {b for _, b in found}


def test_a_long_chain_takes_few_rounds(spark):
    """100,000 edges in a row, shuffled names, once open and once closed to a cycle."""
    n = 100_000
    name = lambda c: F.pmod(F.col("id") * 7919 + c * 7919, F.lit(n + 1))
    chain = spark.range(n).select(name(0).alias("src"), name(1).alias("dst"))
    open_, closed = {}, {}
    assert N.cyclic_nodes(chain, open_).count() == 0 and open_["rounds"] < 20
    whole = spark.range(n + 1).select(name(0).alias("src"), name(1).alias("dst"))
    assert N.cyclic_nodes(whole, closed).count() == n + 1 and closed["rounds"] < 20


def test_importance_of_a_document(spark):
    """By hand: a named in two of four rule texts, at one end of a relation and in b's steps."""
    processes = spark.createDataFrame([(1, "aa", "the money", ["x"]), (1, "bb", "", ["do aa", "y"])], "doc long, name string, description string, steps array<string>")
    rules = spark.createDataFrame([(1, "if aa", "then"), (1, "aa again", "bb")], "doc long, condition string, outcome string")
    relations = spark.createDataFrame([(1, "cc", "aa")], "doc long, src string, dst string")
    got = {r["name"]: r for r in D.process_importance(processes, rules, relations, ("money",)).collect()}
    # rules * 2 + relations * 2 + other processes = 7 places; aa is in 2 + 1 + 1 of them
    assert got["aa"]["frequency"] == 1.0 and got["aa"]["dependency"] == 1.0 and got["aa"]["domain"] == 0.2 and got["aa"]["centrality"] == 1.0
    assert got["aa"]["importance"] == 0.72 and got["aa"]["category"] == "core" and got["aa"]["is_core"]
    assert got["bb"]["dependency"] == 0.0 and got["bb"]["centrality"] == 0.0 and not got["bb"]["is_core"]


def importance_walk(x: dict, keywords) -> dict:
    """{(doc, position): (frequency, dependency, domain, centrality, importance)} of the processes of each document."""
    out = {}
    for doc in {p["doc"] for p in x["processes"]}:
        mine = {k: sorted((r for r in rows if r["doc"] == doc), key=lambda r: r["position"] if "position" in r else 0) for k, rows in x.items()}
        ps, rules_, rels = mine["processes"], mine["rules"], mine["relations"]
        total = 2 * len(rules_) + 2 * len(rels) + len(ps) - 1

        def linked(n, rels=rels):
            return len({r["dst"] for r in rels if n in r["src"]} | {r["src"] for r in rels if n in r["dst"]})

        def needed(n, rels=rels):
            return sum(n in r["dst"] for r in rels)

        for p in ps:
            n = p["name"]
            count = sum((n in r["condition"]) + (n in r["outcome"]) for r in rules_) + sum((n in r["src"]) + (n in r["dst"]) for r in rels)
            count += sum(any(n in s for s in q["steps"]) for q in ps if q["name"] != n)
            text = " ".join([n, p["description"], *p["steps"]])
            parts = (
                min(1.0, count / max(total * 0.1, 1)) if total > 0 else 0.0,
                min(1.0, needed(n) / max(1, *(needed(q["name"]) for q in ps))),
                min(1.0, sum(k in text for k in keywords) / 5),
                min(1.0, linked(n) / max(1, *(linked(q["name"]) for q in ps))),
            )
            out[doc, p["position"]] = (*parts, int(sum(a * b for a, b in zip(parts, (0.2, 0.2, 0.35, 0.25), strict=True)) * 100 + 0.5 + 1e-9) / 100)
    return out


def diagnosis_walk(x: dict, importance: dict) -> list[tuple]:
    """Rule by rule over the lists of each document: (doc, name, other, type, severity, confidence, related)."""
    out = []
    for doc in {r["doc"] for rows in x.values() for r in rows}:
        of = lambda k: sorted((r for r in x[k] if r["doc"] == doc), key=lambda r: r.asDict().get("position", 0))  # noqa: B023, E731
        ps = of("processes")
        names, entities = [p["name"] for p in ps], {e["name"] for e in of("entities")}
        told: list[str] = []
        for r in of("relations"):
            for n in (r["src"], r["dst"]):
                if n not in names and n not in entities and not any(n in t for t in told):
                    told.append(f"관계({r['type']})에서 참조하는 '{n}'이(가) 엔티티/프로세스 목록에 정의되어 있지 않습니다.")
                    out.append((doc, n, None, "missing", "warning", 0.75, "|".join(e for e in (r["src"], r["dst"]) if e in names)))
        seen = set()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                words = lambda n: {w for w in re.split(r"\s+", re.sub(r"[^A-Za-z0-9_가-힣]", " ", n)) if len(w) > 1}
                score = jaccard(words(a), words(b))
                if (a, b) not in seen and score > 0.7:
                    out.append((doc, a, b, "duplicate", "info", half_up(score, 2), f"{a}|{b}"))
                seen.add((a, b))
        for p in ps:
            if importance[doc, p["position"]][-1] < 0.2 and len(p["steps"]) > 5:
                out.append((doc, p["name"], None, "overspec", "info", 0.65, p["name"]))
        told = []
        for r in of("rules"):
            for n in re.findall(r"([가-힣]+(?:\s[가-힣]+)?)\s(?:시|경우|때|후|전)", r["condition"]):
                if len(n) >= 2 and not any(n in q or q in n for q in names) and not any(n in t for t in told):
                    told.append(f"규칙 조건에서 참조하는 '{n}'에 대응하는 프로세스가 정의되어 있지 않습니다.")
                    out.append((doc, n, None, "inconsistency", "warning", 0.6, ""))
    return out


def test_registered_models_against_walks(spark):
    x = {k: df.collect() for k, df in plans.extraction(spark, SF_DIR).items()}
    want = importance_walk(x, plans.KEYWORDS)
    names = {(p["doc"], p["position"]): p["name"] for p in x["processes"]}
    got = QUERIES["mod_01_importance"](spark, SF_DIR).collect()
    shaped = lambda doc, name, parts: (doc, name, *(f"{v:.9f}" for v in parts))
    assert sorted(shaped(r["doc"], r["name"], (r["frequency"], r["dependency"], r["domain"], r["centrality"], r["importance"])) for r in got) == sorted(shaped(k[0], names[k], v) for k, v in want.items())
    found = [(r["doc"], r["name"], r["other"], r["type"], r["severity"], r["confidence"], r["related"]) for r in QUERIES["mod_02_diagnosis"](spark, SF_DIR).collect()]
    assert {r[3] for r in found} >= {"missing", "duplicate", "inconsistency"}
    assert sorted(found, key=repr) == sorted(diagnosis_walk(x, want), key=repr)


def test_entities_are_known_and_duplicates_are_names(spark):
    processes = spark.createDataFrame([(1, 0, "pay now", "money out", ["s"] * 6), (1, 1, "now-pay", "other words", []), (1, 2, "send", "money out", []), (2, 0, "pay now", "money out", [])], "doc long, position int, name string, description string, steps array<string>")
    rules_ = spark.createDataFrame([(1, 0, "고객 해지 시 처리", "x")], "doc long, position int, condition string, outcome string")
    relations = spark.createDataFrame([(1, 0, "pay now", "gone", "uses"), (1, 1, "client", "go", "uses")], "doc long, position int, src string, dst string, type string")
    entities = spark.createDataFrame([(1, "client")], "doc long, name string")
    importance = D.process_importance(processes, rules_, relations.where("false"), ())
    got = {(r["doc"], r["name"], r["other"], r["type"], r["rank"], r["confidence"], tuple(r["related"])) for r in P.diagnosis(processes, entities, rules_, relations, importance).collect()}
    assert got == {  # "go" is held by the finding on "gone"; "send" only shares its description
        (1, "gone", None, "missing", 1, 0.75, ("pay now",)), (1, "pay now", "now-pay", "duplicate", 2, 1.0, ("pay now", "now-pay")), (1, "pay now", None, "overspec", 2, 0.65, ("pay now",)), (1, "고객 해지", None, "inconsistency", 1, 0.6, ()),
        (2, "pay now", None, "overspec", 2, 0.65, ("pay now",)),
    } - {(2, "pay now", None, "overspec", 2, 0.65, ("pay now",))}


def half_up(x: float, digits: int) -> float:
    return int(x * 10**digits + 0.5) / 10**digits


def test_readiness_of_packages(spark):
    """The registered packages, criterion by criterion in plain Python."""
    packages = plans.skill_packages(spark, SF_DIR).collect()
    got = {r["key"]: r for r in QUERIES["mod_10_criteria"](spark, SF_DIR).collect()}
    assert len(got) == len(packages)
    for s in packages:
        ps = [p.asDict() for p in s["policies"] or []]
        n = len(ps)
        share = lambda test: sum(map(test, ps)) / n if n else 0.0  # noqa: B023, E731
        full = lambda p: "\n".join([p["title"], p["description"] or "", p["condition"], p["criteria"], p["outcome"]])
        text = "\n".join(full(p) + "\n" + (p["excerpt"] or "") for p in ps)
        low = text.lower()
        machine = 0.3 * s["schema_uri"].startswith("https://") + 0.5 * s["valid"] + 0.2 * share(lambda p: bool(re.match(K.POLICY_CODE, p["code"])))
        domains = {m[1] for p in ps if (m := re.match(K.POLICY_DOMAIN, p["code"]))}
        semantic = 0.4 * (s["term_uris"] >= 1) + 0.3 * bool(s["skos"]) + 0.3 * (len(domains) <= 1)
        long = share(lambda p: all(len(p[c]) >= 10 for c in ("condition", "criteria", "outcome")))
        excerpt = share(lambda p: bool(p["excerpt"]))
        testable = 0.5 * long + 0.3 * excerpt + 0.2 * min(1, n / 3) if n else 0.0
        trace = 0.3 * bool(s["sources"]) + 0.5 * share(lambda p: p["document"] in s["sources"]) + 0.2 * (s["stages"] >= 3)  # noqa: B023
        words = low + " " + " ".join(t for p in ps for t in p["tags"]).lower()
        business = 0.5 * (n >= 1 and all(p["condition"] and p["criteria"] and p["outcome"] for p in ps)) + 0.25 * any(w in words for w in ("ring", "widget")) + 0.25 * bool(re.search(r"\d+\s*(%|원|일|년|건)", text))
        spec = s["apis"] + s["tables"] + s["flows"] + s["errors"] > 0
        api = s["apis"] > 0 if spec else bool(re.search(r"(?ai)\b(api|endpoint|post|get|put|delete|patch|rest)\b|/api/", text))
        data = s["tables"] + s["flows"] + s["errors"] > 0 if spec else any(w.lower() in low for w in K.SCHEMA_WORDS) or bool(re.search(K.CAMEL_NAME, text) or re.search(K.SNAKE_NAME, text))
        technical = 0.4 * api + 0.4 * data + 0.2 * (s["mcp"] or s["openapi"])
        quality = 0.4 * any(w.lower() in low for w in K.QUALITY_WORDS) + 0.3 * (s["trust"] > 0 or s["level"] != "unreviewed") + 0.3 * (excerpt >= 0.5)
        mean = sum(len(full(p)) for p in ps) / n if n else 0
        human = 0.4 * (s["level"] in ("reviewed", "validated")) + 0.2 * (n > 0 and all(len(p["title"]) >= 5 for p in ps)) + 0.2 * (200 <= mean <= 2000) + 0.2 * bool(s["author"])
        want = {"machineReadable": machine, "semanticConsistency": semantic, "testable": testable, "traceable": trace, "completeness": (business + technical + quality) / 3, "humanReviewable": human}
        r = got[s["key"]]
        for k, v in want.items():
            assert abs(r[k] - half_up(v, 3)) <= 0.0011, (s["key"], k)
            assert (k in r["failed"]) == (v < D.READINESS[k] - 1e-12) or abs(v - D.READINESS[k]) < 1e-9
        assert abs(r["overall"] - sum(r[k] for k in want) / 6) < 0.001 and r["ready"] == ("overall" not in r["failed"])


def test_repaired_json_of_every_cut(spark):
    whole = json.dumps({"a": [1, {"b": "x, y \"q\"", "c": [True, None]}], "d": "end"})
    cuts = ["```json\n" + whole[:i] for i in range(1, len(whole) + 1)] + [None, "no json", "```json\n" + whole + "\n```"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cuts)], "i int, t string").select("i", specs.repaired_json(F.col("t")).alias("j")).collect()
    got = {r["i"]: r["j"] for r in rows}
    assert json.loads(got[len(whole) - 1]) == json.loads(got[len(cuts) - 1]) == json.loads(whole)
    assert got[len(cuts) - 3] is None and got[len(cuts) - 2] is None
    for i in range(len(whole)):
        if got[i] is not None:
            json.loads(got[i])
    assert sum(v is not None for v in got.values()) > 0.6 * len(whole)
    assert json.loads(specs.valid_json('{"a": [1, 2], "b": "hal')) == {"a": [1, 2], "b": "hal"}
    assert json.loads(specs.valid_json('{"a": [1, 2], "b')) == {"a": [1, 2]}
    import duckdb

    want = {}
    for conv, turn, role, text in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_DIR}/conversations.parquet'").fetchall():
        output = "```json\n" + json.dumps({"role": role, "parts": [text, role], "at": {"conv_id": conv, "turn": turn}}, separators=(",", ":"), ensure_ascii=False)
        want[conv, turn] = specs.valid_json(output[: max(12, len(output) - conv % 60)])
    assert {(r["conv_id"], r["turn"]): r["json"] for r in QUERIES["scl_17_repaired_json"](spark, SF_DIR).collect()} == want
    assert sum(v is not None for v in want.values()) > len(want) / 2


def test_severity_of_unknown_flags(spark):
    none = F.lit(None).cast("boolean")
    one = spark.range(1).select(
        severity.gap_severity(F.lit("MID"), none, none, none).alias("a"), severity.gap_severity(F.lit("MID"), none, none, F.lit(False)).alias("b"), severity.gap_severity(F.lit("TM"), none, none, none, F.lit("String"), F.lit("CLOB")).alias("c"),
        rules.api_noise(F.lit("/a/b/a/b"), F.lit("")).alias("d"), rules.table_noise(F.lit("x"), F.lit(3)).alias("e"),
    ).first()
    assert tuple(one) == ("MEDIUM", "LOW", "MEDIUM", "duplicate_path", "sql_alias")


def test_jaccard_of_nothing(spark):
    empty = F.array().cast("array<string>")
    assert tuple(spark.range(1).select(T.jaccard(empty, empty), T.jaccard(empty, empty, 1.0), T.jaccard(empty, F.array(F.lit("a")))).first()) == (0.0, 1.0, 0.0)
