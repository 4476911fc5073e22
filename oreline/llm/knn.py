"""Exact top-k search by a Voronoi kNN join.

Largest inner product becomes nearest neighbour by one more coordinate: with M the
largest data norm, (x, sqrt(M^2 - |x|^2)) and (q, 0) have squared distance
|q|^2 + M^2 - 2 q.x. Data and queries go to the cell of their nearest pivot; a large
cell is cut into rings by distance to its pivot.

1. Summaries of the cells (k + 1 smallest distances of different ids) give every group
   of queries an upper bound of its k-th distance by the triangle inequality.
2. Each query is solved in its own cell; its true k-th distance there is a bound too.
3. A query goes to a ring of another cell only if the smaller bound reaches it: past the
   hyperplane between the two pivots, and into the ring's span of distances.
4. Rings are solved block by block with exact integer products, and winners are merged.

Queries are the smaller side, so they are what is replicated; a data row is sent once
to each step, and only if some query needs its ring. Blocks of a ring and parts of its
queries are bounded, so no task grows with a cell. Pivots are a bounded sample; all
rows are searched. Vectors of different lengths never meet: each length has pivots,
cells and bounds of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, remove, stage

PIVOTS = 1024  # of one vector length, at most; half the square root of its rows below that
RINGS = 64  # of a cell, at most
BLOCK = 8192  # data rows of a block, on average
PART = 16384  # queries of a part of a ring's queries, on average
SLACK = 1e-6  # relative widening of bounds against rounding


def to_integers(vectors: DataFrame, vec_col: str, id_col: str, scale: int) -> DataFrame:
    """(_id, _v: array<long>) of the usable rows: floor(scale * x); null or non-finite components drop a row."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    usable = F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(usable).select(F.col(id_col).alias("_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("_v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floats where they hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


class Cells:
    """Pivots of one vector length, lifted; ``first`` is the number of its first cell."""

    def __init__(self, pivots: np.ndarray, most2: float, first: int):
        self.most2, self.first = most2, first
        self.lifted = np.hstack([pivots, np.sqrt(np.maximum(0, most2 - (pivots**2).sum(1)))[:, None]])
        self.norm2 = (self.lifted**2).sum(1)

    def distances(self, v: np.ndarray, lift: bool) -> np.ndarray:
        """Of each row to each pivot; data rows are lifted, queries lie in the plane."""
        x = v.astype(np.float64)
        own = (x**2).sum(1)
        last = np.sqrt(np.maximum(0, self.most2 - own)) if lift else np.zeros(len(x))
        d2 = (own + last**2)[:, None] + self.norm2 - 2 * (x @ self.lifted[:, :-1].T + last[:, None] * self.lifted[:, -1])
        return np.sqrt(np.maximum(0, d2))


def sample_pivots(whole: DataFrame, vectors_of: dict[int, tuple]) -> dict[int, Cells]:
    """Pivots of each length: distinct vectors whose hash a modulus picks, and the least vector."""
    wanted = {d: min(PIVOTS, max(1, math.ceil(math.sqrt(n) / 2))) for d, (n, _, _) in vectors_of.items()}
    step = F.lit(1).cast("long")
    for d, (n, _, _) in vectors_of.items():
        step = F.when(F.col("_d") == d, F.lit(max(1, n // wanted[d])).cast("long")).otherwise(step)
    some: dict[int, list] = {d: [least] for d, (_, _, least) in vectors_of.items()}
    for r in whole.where(F.pmod(F.xxhash64("_v"), step) == 0).select("_d", "_v").distinct().collect():  # about PIVOTS of a length
        some[r["_d"]].append(r["_v"])
    out, first = {}, 0
    for d in sorted(some):
        pivots = np.unique(np.array(some[d], dtype=np.float64).reshape(-1, d), axis=0)
        out[d] = Cells(pivots, vectors_of[d][1], first)
        first += len(pivots)
    return out


def group_bounds(cells: dict[int, Cells], near: dict[int, list[float]], far: dict[int, float], k: int) -> dict[int, float]:
    """By query cell: a distance within which each of its queries has k rows of other ids (infinite if unknown)."""
    out = {}
    for d in cells.values():
        known = [(c - d.first, v) for c, ds in near.items() if d.first <= c < d.first + len(d.lifted) for v in ds]
        at, dist = np.array([c for c, _ in known], dtype=int), np.array([v for _, v in known])
        for i in range(len(d.lifted)):
            if d.first + i in far:
                upper = far[d.first + i] + np.linalg.norm(d.lifted[i] - d.lifted, axis=1)[at] + dist
                out[d.first + i] = float(np.partition(upper, k)[k]) if len(upper) > k else math.inf
    return out


def top_k_inner(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_col: str = "embedding", id_col: str = "vec_id", figures: dict | None = None) -> DataFrame:
    """The k rows of largest integer inner product for each query row: query_id, rank, id column, score.

    ``is_query`` is a Column on the id, named _id. Components count as floor(scale * x).
    Rows whose vector is null or empty or holds null, NaN or infinite components take no
    part; a query's candidates are the vectors of its own length. Ties go to the
    smaller id. A row is no candidate for queries of its own id. Query rows of one id
    and vector count once, those of one id and other vectors are queries each; repeated
    candidates each count. A null id is neither. Fewer candidates than k: all of them.
    Other columns are not carried; no rows: no rows. ``figures`` receives how many
    pairs of a query and a block were sent, of how many there are.
    """
    spark, made = vectors.sparkSession, []
    schema = f"query_id long, rank int, `{id_col}` long, score long"
    whole = to_integers(vectors.where(F.col(id_col).isNotNull()), vec_col, id_col, scale).withColumn("_d", F.size("_v")).where("_d > 0")
    norm2 = F.aggregate(F.transform("_v", lambda c: c.cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    lengths = {r["_d"]: (r["n"], r["m"], r["v"]) for r in whole.groupBy("_d").agg(F.count("*").alias("n"), F.max(norm2).alias("m"), F.min("_v").alias("v")).collect()}  # different lengths are few
    if not lengths:
        return spark.createDataFrame([], schema)
    cells = sample_pivots(whole, lengths)
    sent = spark.sparkContext.broadcast(cells)

    def assign(lift: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for d, rows in pdf.groupby("_d"):
                    c = sent.value[d]
                    dist = c.distances(matrix(rows["_v"]), lift)
                    best = dist.argmin(1)
                    yield rows.assign(_cell=(best + c.first).astype(np.int32), _dist=dist[np.arange(len(rows)), best])

        return work

    kinds = "_id long, _v array<long>, _d int"
    cut = whole.mapInPandas(assign(True), kinds + ", _cell int, _dist double")
    cut = stage(cut.withColumn("_row", F.monotonically_increasing_id()), "knn-cells", made)
    asked = whole.where(is_query).dropDuplicates(["_id", "_v"]).mapInPandas(assign(False), kinds + ", _cell int, _dist double")
    asked = stage(asked.withColumn("_q", F.monotonically_increasing_id()), "knn-asked", made)

    # Rings of the large cells, by quantiles of the distance to the pivot.
    marks = [i / RINGS for i in range(1, RINGS)]
    edges: dict[int, list[float]] = {}
    for r in cut.groupBy("_cell").agg(F.count("*").alias("n"), F.percentile_approx("_dist", marks, 1000).alias("e")).where(f"n > {BLOCK}").collect():  # a row a cell
        rings = min(RINGS, -(-r["n"] // BLOCK))
        edges[r["_cell"]] = sorted({r["e"][i * RINGS // rings - 1] for i in range(1, rings)})
    sent_edges = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def ring_of(cell: pd.Series, dist: pd.Series) -> pd.Series:
        out = np.zeros(len(cell), np.int32)
        for c in set(cell.unique()) & set(sent_edges.value):
            at = np.flatnonzero(cell == c)
            out[at] = np.searchsorted(sent_edges.value[c], dist.to_numpy()[at])
        return pd.Series(out)

    data = cut.withColumn("_ring", ring_of("_cell", "_dist")) if edges else cut.withColumn("_ring", F.lit(0))
    summary = sorted(tuple(r) for r in data.groupBy("_cell", "_ring").agg(F.count("*"), F.min("_dist"), F.max("_dist")).collect())  # RINGS rows a cell at most
    leaf = pd.DataFrame(summary, columns=["cell", "ring", "n", "low", "high"])
    leaf["blocks"] = -(-leaf["n"] // BLOCK)
    first_of = Window.partitionBy("_cell").orderBy("_near", "_id")
    nearest = data.groupBy("_cell", "_id").agg(F.min("_dist").alias("_near")).withColumn("_rn", F.row_number().over(first_of)).where(F.col("_rn") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in nearest.select("_cell", "_near").collect():  # k + 1 rows a cell
        near.setdefault(r["_cell"], []).append(r["_near"])
    far = {r[0]: r[1] for r in asked.groupBy("_cell").agg(F.max("_dist")).collect()}
    bounds = group_bounds(cells, near, far, k)
    plan = spark.sparkContext.broadcast((leaf, bounds))

    def route(own: bool):
        """(_q, _leaf, _block) of each query: the rings of its own cell, or of other cells that its bound reaches."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            leaves, bound_of = plan.value
            cell_of, low, high, blocks = (leaves[c].to_numpy() for c in ("cell", "low", "high", "blocks"))
            for pdf in batches:
                for d, rows in pdf.groupby("_d"):
                    c = sent.value[d]
                    here = np.flatnonzero((cell_of >= c.first) & (cell_of < c.first + len(c.lifted)))
                    at = cell_of[here] - c.first
                    for a in range(0, len(rows), 64):
                        part = rows.iloc[a : a + 64]
                        mine = part["_cell"].to_numpy() - c.first
                        same = at[None] == mine[:, None]
                        if own:
                            use = same
                        else:
                            v = matrix(part["_v"])
                            dist = c.distances(v, False)
                            total = (v.astype(np.float64) ** 2).sum(1) + c.most2
                            kth = part["_kth"].to_numpy(dtype=np.float64)
                            true = np.sqrt(np.maximum(0, total - 2 * kth) + 1e-9 * total)
                            reach = np.fmin(true, [bound_of[x] for x in part["_cell"]])
                            apart = np.maximum(1e-12, np.linalg.norm(c.lifted[mine][:, None] - c.lifted[None], axis=2))
                            plane = (dist**2 - dist[np.arange(len(part)), mine][:, None] ** 2) / (2 * apart)
                            gap = np.maximum(plane[:, at], np.maximum(dist[:, at] - high[here], low[here] - dist[:, at]))
                            use = ~same & (gap <= reach[:, None] * (1 + SLACK) + SLACK * np.sqrt(total)[:, None])
                        i, j = np.nonzero(use)
                        times = blocks[here[j]]
                        i, j = np.repeat(i, times), np.repeat(j, times)
                        block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                        yield pd.DataFrame({"_q": part["_q"].to_numpy()[i], "_leaf": here[j].astype(np.int32), "_block": block.astype(np.int32)})

        return work

    names = leaf.assign(number=np.arange(len(leaf)))[["cell", "ring", "number", "blocks"]]
    numbered = spark.createDataFrame([tuple(map(int, r)) for r in names.itertuples(index=False)], "_cell int, _ring int, _leaf int, _blocks int")
    data = data.join(F.broadcast(numbered), ["_cell", "_ring"]).select("_id", "_v", "_leaf", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int").alias("_block"))

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("_id")
            ids, x = rows["_id"].to_numpy(), matrix(rows["_v"])
            q, own, number = matrix(queries["_v"]), queries["_id"].to_numpy(), queries["_q"].to_numpy()
            for a in range(0, len(q), 256):
                score = products(q[a : a + 256], x)
                for line, me, name in zip(score, own[a : a + 256], number[a : a + 256], strict=True):
                    use = np.flatnonzero(ids != me)
                    if len(use) > k:
                        s = line[use]
                        use = use[s >= np.partition(s, len(s) - k)[len(s) - k]]
                    best = use[np.lexsort((ids[use], -line[use]))][:k]
                    out.append(pd.DataFrame({"_q": name, "query_id": me, id_col: ids[best], "score": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "query_id": [], id_col: [], "score": []}, dtype="int64")

    def answer(routes: DataFrame, label: str) -> DataFrame:
        """The k best rows of each query in each block that it was sent to."""
        needed = stage(routes.groupBy("_leaf", "_block").agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / PART).cast("int")), f"knn-needed-{label}", made)
        if figures is not None:
            figures[label] = needed.agg(F.coalesce(F.sum("_n"), F.lit(0))).collect()[0][0], asked.count() * int(leaf["blocks"].sum())
        n_needed, needed = needed.count(), needed.drop("_n")
        keys = ["_leaf", "_block", "_part"]
        rows = lookup_join(data, needed, ["_leaf", "_block"], n_needed, "inner").select("_leaf", "_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_id", "_v")
        put = lookup_join(routes, needed, ["_leaf", "_block"], n_needed, "inner").join(asked.select("_q", "_id", "_v"), "_q").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int")).select(*keys, "_q", "_id", "_v")
        found = put.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(solve, f"_q long, query_id long, `{id_col}` long, score long")
        return stage(found, f"knn-{label}", made)

    best = Window.partitionBy("_q").orderBy(F.desc("score"), id_col)
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    pairs = "_q long, _leaf int, _block int"
    first = answer(stage(asked.mapInPandas(route(True), pairs), "knn-own", made), "found-own")
    kth = top(first).where(F.col("rank") == k).select("_q", F.col("score").cast("double").alias("_kth"))
    others = stage(asked.join(kth, "_q", "left").mapInPandas(route(False), pairs), "knn-others", made)
    second = answer(others, "found-others")
    out = stage(top(first.unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), F.col(id_col), "score"), "knn-top")
    remove(spark, made)
    return out
