"""Relational building blocks: latest and first rows, upserts, quantiles, modes, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from .lineage import cut


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order`` (give a unique order)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_n_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys (nulls are equal)."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest_by(both, keys, F.desc("_v")).drop("_v")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``old`` plus, of the rows of ``new`` with a key that it lacks, the first in ``order`` (a unique one).

    Null keys conflict with nothing: all rows that hold one are inserted.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = latest_by(new.where(whole), keys, *order).select(*new.columns)
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti")).unionByName(new.where(~whole))


def dedup_first(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of least ``sequence`` for each key; null keys group together."""
    return latest_by(df, keys, F.asc(sequence))


def conjunction(tests: list[Column | None]) -> Column:
    """All given tests; an absent one holds."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def mode_by(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; the earliest by ``position`` wins ties."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(position).alias("_p"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_p"), F.col(value))).alias(value))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of at most ``most`` rows; ``order`` must be unique."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def keyset_page(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Rows before ``cursor`` in falling key order, one more than asked to tell whether more follow."""
    rows = df if cursor is None else df.where(F.col(key) < F.lit(cursor))
    return rows.orderBy(F.desc(key)).limit(limit + 1)


def sample_keys(df: DataFrame, key: str, n: int, seed: str = "1") -> DataFrame:
    """``n`` distinct keys in the order of a seeded digest."""
    return df.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def zero_filled(counts: DataFrame, key: str, values: list[str], count: str) -> DataFrame:
    """``counts`` with a row for each of ``values``, 0 where there is none."""
    keys = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(key))
    return keys.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


PIECES = 1024  # of a range of values that a pass tells apart


def values_at(counts: DataFrame, ranks: DataFrame, figures: dict | None = None) -> DataFrame:
    """(_k, rank, v): the value at each rank (from 0) of a key. ``counts``: _k, _v (integer), _c; ``ranks``: _k, rank, lo, hi (least and greatest value).

    Exact selection by histograms: each pass cuts the range that holds a rank into PIECES
    of equal width, sums the counts of each and goes on with the piece that the rank falls
    into, until it is one value wide. Sums are partial before the shuffle, and no task
    holds more than PIECES rows of a key and rank. Ranges of 64 bits take seven passes.
    """
    live, done = cut(ranks.withColumn("_before", F.lit(0).cast("long"))), None
    while True:
        settled = live.where("lo = hi").select("_k", "rank", F.col("lo").alias("v"))
        done = cut(settled if done is None else done.unionByName(settled))
        live = cut(live.where("lo < hi"))
        if not live.count():
            return done
        if figures is not None:
            figures["passes"] = figures.get("passes", 0) + 1
        width = F.call_function("div", F.col("hi").cast("decimal(20,0)") - F.col("lo") + PIECES, F.lit(PIECES).cast("decimal(20,0)"))  # the piece's share, rounded up
        within = counts.join(live.withColumn("_w", width), "_k").where("_v between lo and hi")
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        piece = F.call_function("div", wide("_v") - wide("lo"), wide("_w"))
        sums = within.groupBy("_k", "rank", "lo", "hi", "_w", "_before", piece.alias("_i")).agg(F.sum("_c").alias("_n"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "rank").orderBy("_i"))
        hit = sums.withColumn("_upto", upto).where("_upto > rank and _upto - _n <= rank")
        start = (F.col("lo") + F.col("_i") * F.col("_w")).cast("long")
        live = hit.select("_k", "rank", start.alias("lo"), F.least("hi", start + F.col("_w") - 1).alias("hi"), (F.col("_upto") - F.col("_n")).alias("_before"))


def quantiles(df: DataFrame, key: str, value: str, wanted: dict[str, float], figures: dict | None = None) -> DataFrame:
    """Interpolated quantiles, least, most and mean (three digits) of an integer column for each key; nulls do not count.

    Values are counted first; the values at the ranks that are asked for are found by
    histograms (see values_at). A null key is a key like others.
    """
    named = df.where(F.col(value).isNotNull()).select(F.to_json(F.struct(F.col(key).alias("k"))).alias("_k"), F.col(key).alias("_own"), F.col(value).cast("long").alias("_v"))
    counts = cut(named.groupBy("_k", "_v").agg(F.count("*").alias("_c"), F.first("_own").alias("_own")))
    totals = cut(counts.groupBy("_k").agg(F.first("_own").alias(key), F.sum("_c").alias("_n"), F.sum(F.col("_v").cast("decimal(19,0)") * F.col("_c").cast("decimal(19,0)")).cast("double").alias("_s"), F.min("_v").alias("least"), F.max("_v").alias("most")))
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in wanted.values()))))
    asked = totals.select("_k", F.explode(ranks).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    found = values_at(counts.select("_k", "_v", "_c"), asked, figures).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    j = totals.join(found, "_k")
    at = lambda r: F.col("_at")[r]
    part = lambda p: at(F.floor(place(p))) + (at(F.ceil(place(p))) - at(F.floor(place(p)))) * (place(p) - F.floor(place(p)))
    return j.select(key, *(rounded(part(p), 3).alias(name) for name, p in wanted.items()), "least", "most", rounded(F.col("_s") / F.col("_n"), 3).alias("mean"))
