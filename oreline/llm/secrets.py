"""Secret scan: three published formats, and a randomness test battery for the rest.

Everything is a Column expression. Spans are found as (gap, match, gap, ...): the
pieces between matches give the offsets, in code points. Strings of code-like
characters that no format covers go through the battery. The encoding is inferred
from the characters (hex, base32, alphanumeric, base64), and three tests ask whether
the string is further from written or patterned text than chance allows. The null of
each says that it is not random in one respect:

* uniformity: the chi-squared statistic against a uniform alphabet is non-central, with
  non-centrality the length times the divergence of written words from uniform; its
  lower tail is taken by Sankaran's normal approximation,
* runs of lower and upper half symbols (Wald-Wolfowitz) are fewer or more than expected
  by FAR of the expectation or more,
* the lag-1 serial correlation is FAR or more in size.

A random string must reject all three, so the largest of the three p-values is its
p-value (intersection-union test). All tested strings of an encoding and length band
are one family, whatever their tests say, and the Benjamini-Hochberg step-up at rate
``fdr`` decides in each. It works on a fixed grid of p-values, so that only counts
per grid cell are gathered, at most 4 x 6 x 241 of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stage, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
CODE = "A-Za-z0-9+/_=-"
KINDS = ("assign", "access", "hex", "random")

#: Encodings by rank: name, what the string must match, alphabet, sum of squared
#: symbol shares in written text (letters of English: 0.0655; digits of numbers: 0.1).
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.1),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567", 0.0655),
    ("alnum", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.0655),
    ("base64", r"^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/", 0.0655),
)
BANDS = (24, 32, 48, 64, 128)
STEPS, DEEPEST = 16, 15  # grid cells per power of ten, powers of ten
FAR = 0.8  # relative departure of runs, and serial correlation, of patterned text
BLOCK = 256


def running_ends(lens: Column) -> Column:
    """Running sums of an array of ints, block by block: linear but for n / BLOCK squared."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))
    zero = F.lit(0).cast("int")
    grow = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), zero, lambda a, x: a + x))
    starts = grow(sums, zero)
    ends = F.flatten(F.transform(blocks, lambda b: F.slice(grow(part(b), F.element_at(starts, b + 1)), 2, BLOCK)))
    return F.when(F.size(lens) > 0, ends).otherwise(F.array().cast("array<int>"))


def add_spans(df: DataFrame, text: str, name: str, pattern: str, groups: dict[str, int], least: int, by: str) -> DataFrame:
    """Add array ``name`` of (start, end, groups...) of the matches whose group ``by`` has ``least`` characters."""
    raw = df.withColumns(
        {f"_{g}": F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for g, i in groups.items()}
        | {"_gap": F.transform(F.split(text, pattern, -1), lambda x: F.length(x))}
    )
    raw = raw.withColumn("_len", F.transform("_whole", lambda h, i: F.element_at("_gap", i + 1) + F.length(h)))
    raw = raw.withColumn("_end", running_ends(F.col("_len")))
    parts = lambda e, i: [(e - F.length(F.element_at("_whole", i + 1))).alias("start"), e.alias("end"), *(F.element_at(f"_{g}", i + 1).alias(g) for g in groups)]
    spans = F.transform("_end", lambda e, i: F.struct(*parts(e, i)))
    return raw.withColumn(name, F.filter(spans, lambda x: F.length(x[by]) >= least)).drop("_gap", "_len", "_end", *(f"_{g}" for g in groups))


def fields(rows: Column, more) -> Column:
    """An array of structs with fields added; ``more`` gives them by name, each evaluated once."""
    return F.transform(rows, lambda r: reduce(lambda acc, kv: acc.withField(*kv), more(r).items(), r))


def tail_depth(z: Column, x: Column) -> Column:
    """-log10 of the normal distribution function at z; x is its absolute value.

    Abramowitz and Stegun 26.2.17 (absolute error under 7.5e-8) and, below -3, the
    continued fraction 26.2.14, whose relative error there is under 1e-5 and falls.
    """
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * x)
    upper = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    fraction = x
    for i in range(9, 0, -1):
        fraction = x + i / fraction
    depth = F.when(z < -3, x * x / 2 / math.log(10) + F.log10(fraction) + math.log10(2 * math.pi) / 2)
    return depth.when(z < 0, -F.log10(upper)).otherwise(-F.log10(1 - upper))


def sankaran(x: Column, df: Column, far: Column) -> Column:
    """Normal score of a non-central chi-squared value (Sankaran 1963)."""
    both, twice = df + far, df + 2 * far
    h = 1 - 2 / 3 * both * (df + 3 * far) / (twice * twice)
    p = twice / (both * both)
    m = (h - 1) * (1 - 3 * h)
    centre = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    return (F.pow(F.greatest(x, F.lit(0.0)) / both, h) - centre) / (h * F.sqrt(2 * p) * (1 + 0.5 * m * p))


def battery(rows: Column) -> Column:
    """``rows`` (array of structs with ``whole``) as (start, end, t): t is (encoding, band, cell) of the string.

    cell is the grid cell of its p-value, high for low p.
    """
    pick = lambda r, values: F.element_at(F.array(*map(F.lit, values)), r["rank"] + 1)
    alphabets = [e[2] for e in ENCODINGS]
    half = [a.translate({ord(c): "01"[2 * j >= len(a)] for j, c in enumerate(a)}) for a in alphabets]

    def encoding(r: Column) -> Column:
        rank = F.lit(len(ENCODINGS) - 1)
        for i in reversed(range(len(ENCODINGS) - 1)):
            rank = F.when(r["s"].rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(rank)
        return rank

    rows = fields(rows, lambda r: {"s": F.regexp_replace(r["whole"], "=+$", "")})
    rows = fields(rows, lambda r: {"rank": encoding(r), "n": F.length(r["s"]).cast("double")})
    rows = fields(rows, lambda r: {"folded": F.when(r["rank"] == 0, F.lower(r["s"])).otherwise(F.translate(r["s"], "-_", "+/"))})
    halves = lambda r: F.element_at(F.array(*(F.translate(r["folded"], a, h) for a, h in zip(alphabets, half, strict=True))), r["rank"] + 1)
    rows = fields(
        rows,
        lambda r: {
            "codes": F.transform(F.split(r["folded"], ""), lambda c: F.instr(pick(r, alphabets), c).cast("double")),
            "halves": halves(r),
            "squares": F.aggregate(F.array_distinct(F.split(r["folded"], "")), F.lit(0.0), lambda a, c: a + F.pow(r["n"] - F.length(F.replace(r["folded"], c, F.lit(""))), F.lit(2.0))),
            "k": pick(r, [float(len(a)) for a in alphabets]),
        },
    )
    rows = fields(
        rows,
        lambda r: {
            "far": r["n"] * (r["k"] * pick(r, [e[3] for e in ENCODINGS]) - 1),
            "ones": F.length(F.replace(r["halves"], F.lit("0"), F.lit(""))).cast("double"),
            "runs": F.length(F.regexp_replace(r["halves"], "0+|1+", "x")).cast("double"),
            "middle": F.aggregate(r["codes"], F.lit(0.0), lambda a, v: a + v) / r["n"],
        },
    )
    rows = fields(rows, lambda r: {"mean": 2 * r["ones"] * (r["n"] - r["ones"]) / r["n"], "codes": F.transform(r["codes"], lambda v: v - r["middle"])})
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * b)
    rows = fields(rows, lambda r: {"total": F.aggregate(r["codes"], F.lit(0.0), lambda a, v: a + v * v), "lagged": F.aggregate(pairs(r["codes"]), F.lit(0.0), lambda a, v: a + v)})
    never = F.lit(99.0)
    z_runs = lambda r: F.when((r["ones"] > 0) & (r["ones"] < r["n"]) & (r["mean"] > 1), (F.abs(r["runs"] - 1 - r["mean"]) - FAR * r["mean"]) / F.sqrt(r["mean"] * (r["mean"] - 1) / (r["n"] - 1))).otherwise(never)
    z_serial = lambda r: F.when(r["total"] > 0, (F.abs(r["lagged"] / r["total"]) - FAR) * F.sqrt(r["n"])).otherwise(never)
    # The largest p-value is that of the largest score.
    rows = fields(rows, lambda r: {"z": F.greatest(sankaran(r["squares"] * r["k"] / r["n"] - r["n"], r["k"] - 1, r["far"]), z_runs(r), z_serial(r))})
    band = lambda r: sum(((r["n"] >= b).cast("int") for b in BANDS), F.lit(0))
    cell = lambda r: F.least(F.lit(STEPS * DEEPEST), F.floor(tail_depth(r["z"], F.abs(r["z"])) * STEPS)).cast("int")
    return F.transform(rows, lambda r: F.struct(r["start"], r["end"], F.struct(pick(r, [e[0] for e in ENCODINGS]).alias("encoding"), band(r).alias("band"), cell(r).alias("cell")).alias("t")))


def step_up(counts: list[tuple[str, int, int, int]], fdr: float) -> dict[tuple[str, int], int]:
    """Least accepted grid cell of each stratum; counts: (encoding, band, cell, number)."""
    out = {}
    strata: dict[tuple[str, int], dict[int, int]] = {}
    for encoding, band, cell, n in counts:
        strata.setdefault((encoding, band), {})[cell] = n
    for key, cells in strata.items():
        m, below = sum(cells.values()), 0
        for cell in sorted(cells, reverse=True):
            below += cells[cell]
            if m * 10 ** (-cell / STEPS) <= fdr * below:
                out[key] = cell
    return out


def with_candidates(docs: DataFrame, text_col: str, least: int, keep: list[str]) -> DataFrame:
    """One row a document: struct ``doc`` of the kept columns, ``base`` (spans of the formats) and ``tested`` (other code-like strings)."""
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in keep)).alias("doc"), text_or_empty(quoted(text_col)).alias("text"))
    rows = add_spans(rows, "text", "assign", ASSIGN, {"whole": 0, "value": 2}, 12, "value")
    rows = add_spans(rows, "text", "access", ACCESS, {"whole": 0}, 18, "whole")
    rows = add_spans(rows, "text", "hex", "[0-9a-f]{16,}+", {"whole": 0}, 16, "whole")
    rows = add_spans(rows, "text", "code", f"(?<![{CODE}])[{CODE}]{{{least},}}+", {"whole": 0}, least, "whole")
    kind = lambda name, i: F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(i).alias("kind")))
    rows = rows.withColumn("base", F.concat(kind("assign", 0), kind("access", 1), kind("hex", 2)))
    free = F.filter("code", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc", "base", battery(free).alias("tested"))


def scan_secrets(docs: DataFrame, fdr: float = 0.05, text_col: str = "text", least: int = 20, keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) plus ``out``: an array of (start, end, kind) of secrets, by start, then kind.

    Offsets are in code points, end exclusive. Kinds: assign, access, hex, random.
    Matches of one kind never overlap; a random span overlaps no other. ``least`` is
    the length from which strings are tested. The texts are read once: spans of the
    formats and test results are staged beside the kept columns, counts per grid cell
    come from there. A null or empty text has no span; repeated rows have equal spans;
    a column named ``out`` is replaced, all others stay whatever their names; no rows: no rows.
    """
    names = [c for c in (keep or docs.columns) if c.lower() != out.lower()]
    found = stage(with_candidates(docs, text_col, least, names), "secrets")
    cells = found.select(F.explode("tested.t").alias("t")).groupBy("t.encoding", "t.band", "t.cell").count()
    accepted = step_up([tuple(r) for r in cells.collect()], fdr)  # bounded: strata times grid cells
    is_secret = lambda t: F.lit(False)
    for (encoding, band), cell in sorted(accepted.items()):
        is_secret = lambda t, f=is_secret, e=encoding, b=band, c=cell: f(t) | ((t["encoding"] == e) & (t["band"] == b) & (t["cell"] >= c))
    more = F.transform(F.filter("tested", lambda x: is_secret(x["t"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(3).alias("kind")))
    ordered = F.sort_array(F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("rank"), x["end"].alias("end"))))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(kinds, x["rank"] + 1).alias("kind")))
    return found.select(*(F.col("doc")[c].alias(c) for c in names), spans.alias(out))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)
