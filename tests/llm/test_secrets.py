from __future__ import annotations

import math
import random
import re
import string

from conftest import as_documents, edge_rows

from oreline.llm import secrets as S

ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?ai:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def cases() -> list[str]:
    r = random.Random(1)
    code = lambda a, n: "".join(r.choice(a) for _ in range(n))
    texts = [
        "password: hunter2hunter2 and token=secret=abcdefghijklmnop end",
        "token=password:abcdefghijkl TOKEN = 'x' Api_Key:\"" + code(string.ascii_letters, 20) + '"',
        "AKIA" + code(string.ascii_uppercase + string.digits, 14) + " AKIA1234567890123 AKIAAKIA" + code(string.ascii_uppercase, 20),
        code("0123456789abcdef", 40) + "g" + code("0123456789abcdef", 15),
        "😀 secret=" + code(string.ascii_letters + string.digits, 16) + " 中文 " + code("0123456789abcdef", 16),
        " ".join(code("0123456789abcdef", r.randint(10, 24)) for _ in range(700)),
        "passwordpassword=abcdefabcdef1234567890abcdefabcdef",
    ]
    for _ in range(60):
        texts.append("".join(r.choice(["token", "=", ":", " ", '"', "secret", "api_key", "AKIA", code("0123456789abcdef", r.randint(1, 20)), code(string.ascii_letters, r.randint(1, 20)), "ß", "😀"]) for _ in range(r.randint(1, 30))))
    return texts


def test_base_spans(spark):
    texts = cases()
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + j, t) for j, (_, t) in enumerate(edge_rows())]
    got = {r["doc_id"]: r["spans"] for r in S.scan_secrets(as_documents(spark, rows)).select("doc_id", "spans").collect()}
    for i, t in rows:
        assert [(x["start"], x["end"], x["kind"]) for x in got[i] if x["kind"] != "random"] == base(t or ""), t


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(2)
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(60)]
    words = ["_".join(r.choice(["international", "configuration", "management", "application", "development"]) for _ in range(3)) for _ in range(200)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(1000 + i, f"see {w} here") for i, w in enumerate(words)]
    out = S.scan_secrets(as_documents(spark, rows)).select("doc_id", "spans").collect()
    hits = {x["doc_id"] for x in out if any(s["kind"] == "random" for s in x["spans"])}
    assert len([h for h in hits if h < 1000]) >= 45
    assert len([h for h in hits if h >= 1000]) <= 3
    for x in out:
        for s in x["spans"]:
            if s["kind"] == "random":
                assert (s["start"], s["end"]) == (4, 44)


def p_value(s: str) -> tuple[str, float]:
    """The battery in plain Python: encoding and the largest of three p-values."""
    s = s.rstrip("=")
    name, _, alphabet, share = next(e for e in S.ENCODINGS if re.match(e[1], s))
    s = s.lower() if name == "hex" else s.translate(str.maketrans("-_", "+/"))
    n, k = len(s), len(alphabet)
    x2 = sum(s.count(c) ** 2 for c in set(s)) * k / n - n
    far, p, weight = n * (k * share - 1), 0.0, 0.0
    weight = math.exp(-far / 2)
    for j in range(400):  # Poisson mixture of central chi-squared distributions
        p += weight * chi2_cdf(x2, k - 1 + 2 * j)
        weight *= far / 2 / (j + 1)
    phi = lambda z: math.erfc(-z / math.sqrt(2)) / 2
    half = [2 * alphabet.index(c) >= k for c in s]
    ones = sum(half)
    mean = 2 * ones * (n - ones) / n
    runs = 1 + sum(a != b for a, b in zip(half, half[1:], strict=False))
    p_runs = phi((abs(runs - 1 - mean) - S.FAR * mean) / math.sqrt(mean * (mean - 1) / (n - 1))) if 0 < ones < n and mean > 1 else 1.0
    v = [alphabet.index(c) + 1 for c in s]
    v = [x - sum(v) / n for x in v]
    total = sum(x * x for x in v)
    p_serial = phi((abs(sum(a * b for a, b in zip(v, v[1:], strict=False)) / total) - S.FAR) * math.sqrt(n)) if total else 1.0
    return name, max(p, p_runs, p_serial)


def chi2_cdf(x: float, df: int) -> float:
    """Lower regularised gamma function by its series."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
    for i in range(1, 600):
        term *= x / (a + i)
        total += term
    return total


def test_battery_is_near_exact_distributions(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    code = lambda a, n: "".join(r.choice(a) for _ in range(n))
    strings = [code(e[2], n) for e in S.ENCODINGS for n in (20, 31, 40, 64, 100)]
    strings += ["internationalconfiguration", "abcdefghijklmnopqrstuvwxyz", "01" * 20, "a" * 30, "1234567890" * 3, "Donaudampfschifffahrtsgesellschaft", "aaaaaaaaaaaaaaaabbbbbbbbbbbbbbbb", "0001" * 9]
    df = spark.createDataFrame([(s,) for s in strings], "whole string")
    got = {x["whole"]: x["t"] for x in df.select("whole", S.battery(F.array(F.struct(F.lit(0).alias("start"), F.length("whole").alias("end"), "whole")))[0]["t"].alias("t")).collect()}
    for s in strings:
        name, p = p_value(s)
        assert got[s]["encoding"] == name
        cell = min(S.STEPS * S.DEEPEST, -math.log10(max(p, 1e-300)) * S.STEPS)
        assert abs(got[s]["cell"] - cell) <= 3 + 0.05 * cell, (s, got[s]["cell"], cell)


def test_the_family_is_every_tested_string(spark):
    """A string is found or not by how many others were tested with it, whatever its length."""
    r = random.Random(6)
    key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(26))
    words = ["".join(r.choice(["inter", "nation", "config", "uration", "manage", "ment"]) for _ in range(5))[:26].ljust(26, "e") for _ in range(4000)]
    found = lambda rows: {x["doc_id"] for x in S.scan_secrets(as_documents(spark, rows)).collect() if x["spans"]}
    assert found([(0, key)]) == {0}
    assert 0 not in found([(0, key), *((i + 1, w) for i, w in enumerate(words))])


def test_columns_of_working_names_stay(spark):
    df = spark.createDataFrame([(1, "token=abcdefabcdef123456", 7, 8, 9)], "doc_id int, text string, _text int, base int, `a.b` int")
    got = S.scan_secrets(df).collect()[0]
    assert (got["_text"], got["base"], got["a.b"], len(got["spans"])) == (7, 8, 9, 2)  # the value is hex as well
    assert S.scan_secrets(df, keep=["doc_id"]).columns == ["doc_id", "spans"]


def test_step_up_controls():
    counts = [("hex", 0, 40, 5), ("hex", 0, 0, 95)]
    assert S.step_up(counts, 0.05) == {}  # 100 * 10^-2.5 > 0.05 * 5
    assert S.step_up([("hex", 0, 60, 5), ("hex", 0, 0, 95)], 0.05) == {("hex", 0): 60}


def test_redaction(spark):
    docs = S.scan_secrets(as_documents(spark, [(1, "a password=abcdefabcdef123456 b"), (2, "clean"), (3, None)]))
    from pyspark.sql import functions as F

    got = {r[0]: r[1] for r in docs.select("doc_id", S.redact(F.col("text"), F.col("spans"))).collect()}
    assert got == {1: "a [SECRET] b", 2: "clean", 3: None}


def test_nothing(nothing):
    assert S.scan_secrets(nothing).count() == 0
