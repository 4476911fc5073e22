"""Similar token sets, all pairs and exactly: by the rare tokens they share, or counted block by block where too many share one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

BLOCK_TOKENS = 4_000_000  # tokens of a block of sets, on average, at most
BLOCKS, LEAST_BLOCK = 6, 2048  # blocks of a side that are wished for, and sets of a block from which on there are as many
FEW = 2  # pairs for each rare token held, up to which pairs are joined and not counted in blocks
CELLS = 1 << 21  # numbers in a task's arrays of pairs
SENT = 200_000  # pairs in a batch
OFTEN = 1e-3  # share of a block's pairs that share a token, from which on it is counted by matrix product


def set_key(tokens: Column) -> Column:
    """Digest of a token set, whatever characters its tokens have."""
    each = F.transform(F.array_sort(F.array_distinct(tokens)), lambda w: F.concat(F.length(w).cast("string"), F.lit(":"), w))
    return F.unhex(F.sha2(F.array_join(each, ""), 256))


def numbered(tokens: DataFrame) -> DataFrame:
    """(t, r): each token (t, f) with its place in order of (f, t), from 0."""
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(tokens.repartitionByRange(n, "f", "t").sortWithinPartitions("f", "t").select("t", F.monotonically_increasing_id().alias("_m")))
    part, own = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before = F.array(*(F.lit(sum(sizes.get(i, 0) for i in range(p))).cast("long") for p in range(max(sizes, default=0) + 1)))
    return placed.select("t", (F.get(before, part.cast("int")) + own).cast("int").alias("r"))


def coded(left: DataFrame, right: DataFrame) -> DataFrame:
    """(k, in_left, in_right, codes) of the distinct non-empty sets of both sides (k, tokens); rarer tokens have lower codes."""
    side = lambda df, x: df.where(F.size("tokens") > 0).select("k", "tokens", F.lit(x).alias("l"), F.lit(not x).alias("r"))
    sets = side(left, True).unionByName(side(right, False)).groupBy("k").agg(F.first("tokens").alias("tokens"), F.bool_or("l").alias("in_left"), F.bool_or("r").alias("in_right"))
    words = cut(sets).select("k", "in_left", "in_right", F.explode(F.array_distinct("tokens")).alias("t"))
    numbers = numbered(words.groupBy("t").agg(F.count("*").alias("f")))
    # Exploded rows are more than Spark takes them for: a hint keeps it from sending them to all.
    both = words.join(numbers.hint("merge"), "t")
    return cut(both.groupBy("k", "in_left", "in_right").agg(F.sort_array(F.collect_list("r")).alias("codes")))


def counted(na: np.ndarray, ta: np.ndarray, nb: np.ndarray, tb: np.ndarray, threshold: float, contained: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in a and in b, and scores, of all pairs that reach the threshold. Sets are given by size in order (na, nb) and their tokens (ta, tb).

    Tokens that many pairs share are counted by a matrix product, which also takes off what
    a pair needs, the others by their postings. Memory is bounded by CELLS and the blocks.
    """
    tokens = ta, tb
    common = np.intersect1d(*map(np.unique, tokens), assume_unique=True)
    if not len(common):
        return
    local, rows = [], []
    for t, n in zip(tokens, (na, nb), strict=True):
        at = np.minimum(np.searchsorted(common, t), len(common) - 1)
        held = common[at] == t
        local.append(at[held])
        rows.append(np.repeat(np.arange(len(n)), n)[held])
    fa, fb = (np.bincount(t, minlength=len(common)) for t in local)
    share = fa * fb / (len(na) * len(nb))
    most = np.argsort(-share, kind="stable")[: max(1, 8 * CELLS // len(nb))]
    dense = most[share[most] > OFTEN]
    column = np.full(len(common), -1)
    column[dense] = np.arange(len(dense))
    kind = np.float32 if max(na[-1], nb[-1]) < 50_000 else np.float64
    # o / (na + nb - o) >= t is o >= t / (1 + t) * (na + nb); contained: o >= t * na
    x, y = (threshold, 0.0) if contained else (threshold / (1 + threshold),) * 2
    wide = np.zeros((len(nb), len(dense) + 2), kind)
    inside = column[local[1]] >= 0
    wide[rows[1][inside], column[local[1][inside]]] = 1
    wide[:, -2], wide[:, -1] = 1, -y * nb
    posted = np.sort(local[1][~inside] * len(nb) + rows[1][~inside])  # by token, then by size
    place = posted % len(nb)
    ends = np.searchsorted(rows[0], np.arange(len(na) + 1))
    step = max(1, CELLS // len(nb))
    for first in range(0, len(na), step):
        last = min(len(na), first + step)
        lo = np.searchsorted(nb, threshold * na[first] - 1e-6)
        hi = len(nb) if contained else np.searchsorted(nb, na[last - 1] / threshold + 1e-6, "right")
        if lo >= hi:
            continue
        t, r = local[0][ends[first] : ends[last]], rows[0][ends[first] : ends[last]] - first
        tall = np.zeros((last - first, len(dense) + 2), kind)
        inside = column[t] >= 0
        tall[r[inside], column[t[inside]]] = 1
        tall[:, -2], tall[:, -1] = -x * na[first:last], 1
        over = (tall @ wide[lo:hi].T).ravel()
        t, r = t[~inside], r[~inside]
        starts = np.searchsorted(posted, t * len(nb) + lo)
        n = np.searchsorted(posted, t * len(nb) + hi) - starts
        whole = np.cumsum(n)
        cuts = [0, *np.unique(np.searchsorted(whole, np.arange(CELLS, whole[-1] if len(n) else 0, CELLS))), len(n)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            m = n[i:j]
            if not m.sum():
                continue
            cell = place[np.repeat(starts[i:j] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            cell += np.repeat(r[i:j] * (hi - lo) - lo, m)
            np.add.at(over, cell, kind(1))
        hits = np.flatnonzero(over >= -0.05)
        i, j = first + hits // (hi - lo), lo + hits % (hi - lo)
        shared = np.rint(over[hits] + x * na[i] + y * nb[j]).astype(np.int64)
        score = shared / (na[i] if contained else na[i] + nb[j] - shared)
        good = score >= threshold
        yield i[good], j[good], score[good]


def in_blocks(left: DataFrame, right: DataFrame, blocks: tuple[int, int], threshold: float, contained: bool) -> DataFrame:
    """The pairs of rows (codes and any others) that reach the threshold, with the columns of both and score: each block of one side with each of the other."""
    p, q = blocks
    mine, theirs = ([c for c in df.columns if c not in ("codes", "k")] for df in (left, right))
    fields = {c: df.schema[c].dataType for df, names in ((left, mine), (right, theirs)) for c in names}

    def side(df: DataFrame, names: list[str], of: int, others: int, number: Column) -> DataFrame:
        dealt = df.withColumn("_own", F.pmod(F.hash("k", *names), F.lit(of))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return dealt.select(number.alias("_pair"), F.lit(names is mine).alias("_left"), "codes", *((F.col(c) if c in names else F.lit(None).cast(t)).alias(c) for c, t in fields.items()))

    def by_size(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        sizes = pc.list_value_length(rows["codes"])
        rows = rows.take(pc.array_sort_indices(sizes))
        return np.sort(sizes.to_numpy()).astype(np.int64), pc.list_flatten(rows["codes"]).to_numpy(), rows.select(names).combine_chunks()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        (na, ta, a), (nb, tb, b) = by_size(rows.filter(rows["_left"]), mine), by_size(rows.filter(pc.invert(rows["_left"])), theirs)
        if not len(na) or not len(nb):
            return
        for i, j, score in counted(na, ta, nb, tb, threshold, contained):
            for k in range(0, len(i), SENT):
                x, y = a.take(i[k : k + SENT]), b.take(j[k : k + SENT])
                yield from pa.table([*x.columns, *y.columns, score[k : k + SENT]], names=[*mine, *theirs, "score"]).to_batches()

    one, two = side(left, mine, p, q, F.col("_own") * q + F.col("_other")), side(right, theirs, q, p, F.col("_other") * q + F.col("_own"))
    schema = T.StructType([*(T.StructField(c, t) for c, t in fields.items()), T.StructField("score", T.DoubleType())])
    return one.unionByName(two).repartition(2 * p * q, "_pair").groupBy("_pair").applyInArrow(compare, schema)


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, contained: bool = False) -> DataFrame:
    """Rows of both sides (tokens and any others, of other names) whose sets' Jaccard similarity - ``contained``: the share of the left's tokens that the right has - is ``threshold`` or more, and that as score.

    Similar sets share one of the rarest n - ceil(threshold * n) + 1 tokens of each - contained:
    of the left. Where few pairs do, for the tokens held, the distinct sets are joined by them.
    Otherwise all pairs of rows are counted in blocks, which sends each row as often as the other
    side has blocks, whatever the number of pairs. Both are exact. Empty sets match nothing.
    """
    left, right = (df.withColumn("k", set_key(F.col("tokens"))) for df in (left, right))
    sets = coded(left, right)
    n = F.size("codes")
    rare = F.slice("codes", F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    heads = lambda of, codes, k, m: sets.where(of).select(F.col("k").alias(k), n.alias(m), F.explode(codes).alias("t"))
    a, b = heads("in_left", rare, "k1", "n1"), heads("in_right", F.col("codes") if contained else rare, "k2", "n2")
    posted = a.select("t", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("t", F.lit(0), F.lit(1))).groupBy("t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    cost = posted.agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(F.col("x") + F.col("y")), F.lit(0)).alias("held")).first()
    if cost["pairs"] > FEW * cost["held"]:
        # The number of sets, of which rows may be many more: rows of a set are counted, too.
        rows = [cut(df.drop("tokens").join(sets.select("k", "codes").hint("merge"), "k")) for df in (left, right)]
        sized = [df.agg(F.count("*").alias("n"), F.sum(n).alias("tokens")).first() for df in rows]
        p, q = (max(-(-s["tokens"] // BLOCK_TOKENS), min(BLOCKS, -(-s["n"] // LEAST_BLOCK))) for s in sized)
        return in_blocks(*rows, (p, q), threshold, contained)
    fits = F.col("n2") >= F.lit(threshold) * F.col("n1") - 1e-9
    fits = fits if contained else fits & (F.col("n1") >= F.lit(threshold) * F.col("n2") - 1e-9)
    pairs = a.hint("merge").join(b, "t").where(fits).select("k1", "k2").distinct()
    of = lambda k, c: sets.select(F.col("k").alias(k), F.col("codes").alias(c)).hint("merge")
    pairs = pairs.join(of("k1", "c1"), "k1").join(of("k2", "c2"), "k2").withColumn("_shared", F.size(F.array_intersect("c1", "c2")))
    score = F.col("_shared") / (F.size("c1") if contained else F.size("c1") + F.size("c2") - F.col("_shared"))
    pairs = pairs.select("k1", "k2", score.alias("score")).where(F.col("score") >= threshold)
    whose = lambda df, k: df.withColumnRenamed("k", k).drop("tokens").hint("merge")
    return pairs.join(whose(left, "k1"), "k1").join(whose(right, "k2"), "k2").drop("k1", "k2")
