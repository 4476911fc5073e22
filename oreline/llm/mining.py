"""Hard-negative mining on one-dimensional distance keys.

Largest inner product becomes nearest neighbour by one more coordinate: with M the
largest norm, (x, sqrt(M^2 - |x|^2)) and (q, 0) have squared distance
|q|^2 + M^2 - 2 q.x. Every augmented row belongs to its nearest pivot, and its key is
(pivot, distance to the pivot). The rows are written sorted by that key, so that a leaf
- at most LEAF rows in a row of one pivot - is an interval of keys.

A row within r of a query has a key within r of the query's own distance to the pivot.
A search therefore scans, for a growing radius, the intervals of keys that came in since
the radius before: two annuli around every pivot. It ends for a query when its k-th
result is within the radius scanned, or when no row beyond can lie in its window of
scores. Radii grow so that each round scans about GROWTH times the rows of the one
before, and never past the k-th result found, so rounds are logarithmic in the rows.

Positives are the nearest rows of the anchor's label. Negatives are searched once an
anchor's positives are known, for all its windows in one scan.

Anchors are the smaller side and are what is replicated; a leaf is sent to a round only
if some anchor's annuli meet it. Leaves and parts of their anchors are bounded. Pivots
are a bounded sample; all rows are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, quoted, remove, stage
from .knn import matrix, products, sample_pivots, to_integers

LEAF = 8192  # rows of a leaf, at most; more beyond LEAF * LEAVES rows
LEAVES = 500_000  # so that their summary stays small on the driver
PARTITION = 4096  # rows of a partition of the sorted table, about; more beyond PARTITION * 10,000 rows
PART = 16384  # anchors of a part of a leaf's anchors, on average
FIRST, GROWTH = 4096, 8  # rows that the first round scans for an anchor, about, and how much more each next one does
SLACK = 1e-6  # relative widening of bounds against rounding
LEAST, MOST = -(2**63), 2**63 - 1


def search(keys: DataFrame, leaves: pd.DataFrame, cells: dict, asked: DataFrame, k: int, same: bool, made: list[str], figures: dict | None = None) -> DataFrame:
    """(_q, want, rank, id, score): the k best rows of each window of each query, certified.

    ``asked``: _q, _id, _label, _v, _d and wants, an array of (want, low, high): the k best
    rows with scores in low..high, of the same or of another label.
    """
    sent = keys.sparkSession.sparkContext.broadcast((cells, leaves))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The leaves that a query's next annuli meet (leaf -1: none), and its radius before and after."""
        cells, leaves = sent.value
        cell_of, low, high, rows = (leaves[c].to_numpy() for c in ("cell", "low", "high", "n"))
        for pdf in batches:
            for d, some in pdf.groupby("_d"):
                c = cells[d]
                here = np.flatnonzero((cell_of >= c.first) & (cell_of < c.first + len(c.lifted)))
                for a in range(0, len(some), 64):
                    part = some.iloc[a : a + 64]
                    v = matrix(part["_v"])
                    dist = c.distances(v, False)[:, cell_of[here] - c.first]
                    far = (v.astype(np.float64) ** 2).sum(1) + c.most2
                    nearest = np.maximum(0, np.maximum(low[here] - dist, dist - high[here]))
                    whole = np.maximum(np.abs(dist - low[here]), np.abs(dist - high[here]))
                    about = (nearest + whole) / 2  # the radius at which half a leaf's span is in
                    order = np.argsort(about, axis=1, kind="stable")
                    heaped = np.cumsum(rows[here][order], axis=1)
                    for i, (q, before, goal, reach) in enumerate(zip(part["_q"], part["_radius"], part["_goal"], part["_reach"], strict=True)):
                        slack = SLACK * np.sqrt(far[i])
                        n = int(np.searchsorted(heaped[i], goal))
                        wish = about[i, order[i, n]] if n < len(here) else np.inf
                        need = np.sqrt(max(0.0, far[i] - 2.0 * reach) + 1e-9 * far[i]) if reach > LEAST else np.inf
                        radius = min(max(wish, before), need)
                        if radius + slack >= whole[i].max():
                            radius = np.inf  # every key is in
                        hit = np.flatnonzero((nearest[i] <= radius + slack) & (whole[i] > before - slack))
                        out = pd.DataFrame({"_leaf": here[hit] if len(hit) else [-1]})
                        yield out.assign(_q=q, _from=before - slack, _to=radius + slack, _radius=radius, _sure=radius >= need or np.isinf(radius), _far=far[i])

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k best of a leaf within each query's annuli; neighbouring annuli overlap by a rounding's width."""
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("_id")
            ids, labels, dist, number, x = rows["_id"].to_numpy(), rows["_label"].to_numpy(), rows["_dist"].to_numpy(), rows["_row"].to_numpy(), matrix(rows["_v"])
            c, cell = sent.value[0][x.shape[1]], int(rows["_cell"].iloc[0])
            for a in range(0, len(queries), 256):
                part = queries.iloc[a : a + 256]
                column = lambda name, part=part: part[name].to_numpy()[:, None]
                q = matrix(part["_v"])
                score = products(q, x)
                key = np.abs(c.distances(q, False)[:, [cell - c.first]] - dist)
                use = (key >= column("_from")) & (key <= column("_to")) & (ids != column("_id")) & ((labels == column("_label")) == same)
                for line, ok, name, wants in zip(score, use, part["_q"], part["wants"], strict=True):
                    for w in wants:
                        at = np.flatnonzero(ok & (line >= w["low"]) & (line <= w["high"]))
                        if len(at) > k:
                            s = line[at]
                            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
                        best = at[np.lexsort((number[at], ids[at], -line[at]))][:k]
                        if len(best):
                            out.append(pd.DataFrame({"_q": name, "want": w["want"], "id": ids[best], "score": line[best], "row": number[best]}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "want": [], "id": [], "score": [], "row": []}, dtype="int64")

    best = F.row_number().over(Window.partitionBy("_q", "want").orderBy(F.desc("score"), "id", "row"))
    group, found = ["_leaf", "_part"], None
    todo = asked.withColumns({"_radius": F.lit(0.0), "_goal": F.lit(float(FIRST)), "_reach": F.array_min(F.col("wants.low"))})
    while True:
        routes = stage(todo.mapInPandas(route, "_q long, _leaf int, _from double, _to double, _radius double, _sure boolean, _far double"), "mine-routes", made)
        met = routes.where("_leaf >= 0").select("_q", "_leaf", "_from", "_to")
        needed = stage(met.groupBy("_leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")), "mine-needed", made)
        n_needed = needed.count()
        if figures is not None:
            figures.setdefault("sent", []).append((met.count(), asked.count() * len(leaves)))
        rows = lookup_join(keys, needed, ["_leaf"], n_needed, "inner").select("_leaf", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_cell", "_dist", "_row", "_id", "_label", "_v")
        put = lookup_join(met, needed, ["_leaf"], n_needed, "inner").join(todo.select("_q", "_id", "_label", "_v", "wants"), "_q").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int"))
        new = put.drop("_parts").groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(solve, "_q long, want int, id long, score long, row long")
        both = new if found is None else found.drop("rank").unionByName(new)
        found = stage(both.dropDuplicates(["_q", "want", "row"]).withColumn("rank", best).where(F.col("rank") <= k), "mine-found", made)
        # A window is settled when its k-th score so far, or its end, is no farther than the radius; else that is how far to go.
        kth = found.where(F.col("rank") == k).select("_q", "want", F.col("score").alias("_kth"))
        step = routes.groupBy("_q").agg(F.max("_radius").alias("_radius"), F.bool_or("_sure").alias("_sure"), F.max("_far").alias("_far")).where("not _sure")
        left = todo.select("_q", F.explode("wants").alias("w")).join(step, "_q").withColumn("want", F.col("w.want")).join(kth, ["_q", "want"], "left")
        left = left.withColumn("_reach", F.greatest(F.col("w.low"), F.coalesce("_kth", F.lit(LEAST))))
        away = F.sqrt(F.greatest(F.lit(0.0), F.col("_far") - 2 * F.col("_reach").cast("double")) + 1e-9 * F.col("_far"))
        left = left.where((F.col("_reach") == LEAST) | (away > F.col("_radius"))).groupBy("_q").agg(F.collect_list("w").alias("wants"), F.min("_reach").alias("_reach"), F.max("_radius").alias("_radius"))
        todo = stage(todo.select("_q", "_id", "_label", "_v", "_d", (F.col("_goal") * GROWTH).alias("_goal")).join(left, "_q"), "mine-todo", made)
        if not todo.count():
            return found.drop("row")


def distance_keys(whole: DataFrame, made: list[str]) -> tuple[DataFrame, pd.DataFrame, dict] | None:
    """The rows sorted by (pivot, distance) with the number of their leaf, a summary of the leaves, and the pivots.

    ``whole``: _id, _label, _v, _d. None without rows.
    """
    norm2 = F.aggregate(F.transform("_v", lambda c: c.cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    lengths = {r["_d"]: (r["n"], r["m"], r["v"]) for r in whole.groupBy("_d").agg(F.count("*").alias("n"), F.max(norm2).alias("m"), F.min("_v").alias("v")).collect()}  # different lengths are few
    if not lengths:
        return None
    cells = sample_pivots(whole, lengths)
    sent = whole.sparkSession.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows in pdf.groupby("_d"):
                c = sent.value[d]
                dist = c.distances(matrix(rows["_v"]), True)
                best = dist.argmin(1)
                yield rows.assign(_cell=(best + c.first).astype(np.int32), _dist=dist[np.arange(len(rows)), best])

    n = sum(x for x, _, _ in lengths.values())
    kind = whole.schema["_v"].dataType.simpleString()
    keyed = whole.mapInPandas(assign, f"_id long, _label long, _v {kind}, _d int, _cell int, _dist double")
    keyed = stage(keyed.withColumn("_row", F.monotonically_increasing_id()), "mine-cells", made)
    order = ["_cell", "_dist", "_row"]
    parts = max(1, min(10_000, -(-n // PARTITION)))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    size = max(LEAF, n // LEAVES)
    placed = placed.withColumns({"_p": F.shiftright("_at", 33).cast("int"), "_b": F.floor(F.col("_at").bitwiseAND(2**33 - 1) / size).cast("int")})
    placed = stage(placed.select("_p", "_b", "_cell", "_dist", "_row", "_id", "_label", "_v"), "mine-sorted", made)
    leaves = placed.groupBy("_cell", "_p", "_b").agg(F.count("*").alias("n"), F.min("_dist").alias("low"), F.max("_dist").alias("high")).toPandas()  # about LEAVES rows at most
    leaves = leaves.sort_values(["_cell", "_p", "_b"], ignore_index=True).rename(columns={"_cell": "cell"})
    numbered = whole.sparkSession.createDataFrame([(int(c), int(p), int(b), i) for i, (c, p, b) in enumerate(zip(leaves["cell"], leaves["_p"], leaves["_b"], strict=True))], "_cell int, _p int, _b int, _leaf int")
    keys = lookup_join(placed, numbered, ["_cell", "_p", "_b"], len(leaves), "inner").select("_leaf", "_cell", "_dist", "_row", "_id", "_label", "_v")
    return keys, leaves, cells


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, scale: int = 256, vec_col: str = "embedding", id_col: str = "vec_id", figures: dict | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor row.

    ``is_anchor`` is a Column on the id, named _id; ``label`` one on the rows of ``vectors``.
    A row's score is the integer inner product of floor(scale * x) with the anchor's. An
    anchor's positives are its best other rows of the same label; for each, the best
    rows of other labels with 80 to 100 per cent of its score are ranked. Ties go to the
    smaller id. Fewer rows than asked for: all of them; an anchor without positives, or a
    positive without negatives, gives no row. A positive of a score below 0 has none.

    Rows whose id or label is null, or whose vector is null, empty or holds null, NaN or
    infinite components, take no part; vectors of different lengths never meet. A row is
    no candidate for anchors of its own id. Anchor rows of one id, label and vector count
    once; repeated candidates each count. Other columns are not read; no rows: no rows.
    The result is written in the shared folder. ``figures`` receives, for each round, the
    pairs of an anchor and a leaf that were sent, and how many there are.
    """
    spark, made = vectors.sparkSession, []
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    used = vectors.select(F.col(quoted(id_col)).cast("long").alias("_id"), label.cast("long").alias("_label"), F.col(quoted(vec_col)).alias("_x")).where("_id is not null and _label is not null")
    short = to_integers(used.withColumn("_key", F.struct("_id", "_label")), "_x", "_key", scale).where(F.size("_v") > 0)
    whole = short.select("_id._id", "_id._label", "_v", F.size("_v").alias("_d"))
    reach = whole.agg(F.max(F.array_max(F.transform("_v", lambda c: F.abs(c))))).collect()[0][0]
    if reach is not None and 0 <= reach < 2**31:
        whole = whole.withColumn("_v", F.col("_v").cast("array<int>"))
    built = distance_keys(whole, made)
    if not built:
        return spark.createDataFrame([], schema)
    keys, leaves, cells = built
    asked = stage(whole.where(is_anchor).dropDuplicates(["_id", "_label", "_v"]).withColumn("_q", F.monotonically_increasing_id()), "mine-anchors", made)
    want = lambda number, low, high: F.struct(number.cast("int").alias("want"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    whole_range = F.array(want(F.lit(0), F.lit(LEAST), F.lit(MOST)))
    near = search(keys, leaves, cells, asked.withColumn("wants", whole_range), positives, True, made, figures)
    # ceil(4 s / 5) = s - floor(s / 5); the window of a positive below 0 is empty.
    window = want(F.col("rank"), F.col("score") - F.expr("score div 5"), F.col("score"))
    wants = near.where("score >= 0").groupBy("_q").agg(F.collect_list(window).alias("wants"))
    far = search(keys, leaves, cells, stage(asked.join(wants, "_q"), "mine-asked", made), negatives, False, made, figures)
    told = near.select("_q", F.col("rank").alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(told, ["_q", "want"]).join(asked.select("_q", F.col("_id").alias("anchor_id")), "_q")
    out = out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = stage(out, "mined")
    remove(spark, made)
    return out
