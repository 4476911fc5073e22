"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full sets.

A signature has ``trees`` times ``step`` minima. Each tree is one sorted order of the
signatures, read from position t * step on, around the end; rows that share the first
``step`` minima are neighbours in it and form a region. There are as many trees as the
threshold needs: two sets at it share no region with probability MISS at most (24 trees
of 5 minima for 0.85, 35 for 0.8).

1. All orders are sorted at once, range partitioned; a row's candidates are the rows
   before and after it with which it shares the longest prefix, over all trees. The
   denser a region, the longer the prefix must be: its depth grows by ``step`` with each
   power of DENSE in its rows. Neighbours across the edges of partitions count as well.
2. Regions whose rows are still in different components: those outside the component of
   the region's hub - the row whose regions are the fullest - are compared with the hub.
3. Rows of a region that still differ in component are compared with each other, in
   blocks, so that no link within a region is lost, whatever neighbours and hubs missed.

Signatures only spare comparisons that could not succeed; every link is confirmed on
the full shingle sets. Components come from alternating large-star and small-star
steps. Documents of equal sets are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, TEXT_ROWS, lookup_join, remove, stage

STEP, MOST_TREES = 5, 48  # minima that a region's rows share, fewer where more trees than that would be needed
MISS = 1e-6  # share of pairs at the threshold that may meet in no tree
TAIL = 15  # minima behind a region's that are sorted, 16 bits each
DENSE = 32  # rows of a region by whose powers its depth grows
REACH = 2  # rows after a row that its prefix is compared with
BLOCK = 256
SALT = 4096  # rows of a region that are joined as one key
#: A pair is compared in full unless its signatures agree in fewer positions than a
#: pair at the threshold does in this share of cases (exact binomial tail).
MISS_AGREE = 1e-7

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, size: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; shorter texts are one shingle."""
    words = text.lower().split()  # bytes: folds A-Z and splits at ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * M1 + h[i : n - k + 1 + i])
    return np.unique(out)


def forest_shape(percent: int) -> tuple[int, int]:
    """(trees, step) with which a pair at the threshold meets in no tree in a share of MISS cases at most."""
    for step in range(STEP, 0, -1):
        p = (percent / 100) ** step
        trees = 1 if p >= 1 else math.ceil(math.log(MISS) / math.log1p(-p))
        if trees <= MOST_TREES:
            break
    return trees, step


@cache
def hash_family(width: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(2024))
    odd = random.integers(0, 2**32, width, dtype=np.uint32) | np.uint32(1)
    return odd, random.integers(0, 2**32, width, dtype=np.uint32)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    odd, flip = hash_family(width)
    low = np.full(width, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(low, ((h[a : a + 2048, None] ^ flip) * odd).min(0), out=low)
    return low


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of two lists of sorted distinct arrays."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(both), 8192):
        part = both[a : a + 8192]

        def incidence(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                m[i, at[part[at] == s]] = 1
            return m

        out += (incidence(left) @ incidence(right).T).astype(np.int64)
    return out


def least_agreement(percent: int, width: int) -> int:
    """Most positions that a pair at the threshold agrees in or exceeds but in MISS_AGREE of cases."""
    j, below = percent / 100, 0.0
    for c in range(width + 1):
        log = math.lgamma(width + 1) - math.lgamma(c + 1) - math.lgamma(width - c + 1)
        below += math.exp(log + c * math.log(j) + (width - c) * math.log1p(-j)) if 0 < j < 1 else float(c == width * j)
        if below > MISS_AGREE:
            return c
    return width


def sets_of(docs: DataFrame, ids: DataFrame, n_ids: int, size: int, text_col: str, id_col: str) -> DataFrame:
    """(_rep, _set) of the documents in ``ids``, recomputed from their texts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), TEXT_ROWS):
                part = pdf.iloc[a : a + TEXT_ROWS]
                yield pd.DataFrame({"_rep": part["_rep"], "_set": [shingle_set(bytes(t), size).tobytes() for t in part["_text"]]})

    rows = docs.select(F.col(id_col).alias("_rep"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).where(F.col("_rep").isNotNull())
    return lookup_join(rows, ids, ["_rep"], n_ids, "left_semi").mapInPandas(read, "_rep long, _set binary")


def components(links: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long): root is the least node of its component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stage(edges, "links", made), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "stars", made)
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).collect()[0])
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = state


def neighbours(forest: DataFrame, step: int, made: list[str]) -> DataFrame:
    """(a, b) of each row and the rows before and after it of longest common prefix, over all sorted orders.

    ``forest`` has _region, _tail, _rep and m (rows of the region).
    """

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        kept, first = None, True
        for pdf in batches:
            if first and len(pdf):
                yield edge(pdf.iloc[:1], part, False)
                first = False
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            tail = np.frombuffer(b"".join(pdf["_tail"]), np.uint16).reshape(-1, TAIL)
            region, rep = pdf["_region"].to_numpy(), pdf["_rep"].to_numpy()
            need = step * np.floor(np.log(pdf["m"].to_numpy()) / np.log(DENSE) + 1e-9)
            for lag in range(1, REACH + 1):
                at = np.flatnonzero(region[lag:] == region[:-lag])
                shared = np.logical_and.accumulate(tail[at + lag] == tail[at], axis=1).sum(1)
                use = shared >= np.minimum(TAIL, need[at])
                at, shared = at[use], shared[use].astype(np.int32)
                yield pd.DataFrame({"a": rep[at], "b": rep[at + lag], "lcp": shared})
            kept = pdf.iloc[-REACH:]
        if kept is not None and len(kept):
            yield edge(kept.iloc[-1:], part, True)

    def edge(row: pd.DataFrame, part: int, last: bool) -> pd.DataFrame:
        return pd.DataFrame({"a": row["_rep"], "part": 2 * part + last, "region": row["_region"]})

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pair(batches):
            yield pdf.reindex(columns=["a", "b", "lcp", "part", "region"]).astype("Int64")

    ordered = forest.repartitionByRange("_region", "_tail", "_rep").sortWithinPartitions("_region", "_tail", "_rep")
    found = stage(ordered.mapInPandas(filled, "a long, b long, lcp int, part int, region long"), "dedup-order", made)
    line = Window.orderBy("part")  # two rows a partition
    ends = found.where("part is not null").select("a", "region", F.lag("a").over(line).alias("b"), F.lag("region").over(line).alias("r"), (F.col("part") % 2).alias("last"))
    across = ends.where("last = 0 and region = r and a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("lcp"))
    pairs = found.where("b is not null").select("a", "b", "lcp").unionByName(across)
    best = lambda x, y: pairs.groupBy(x).agg(F.max(F.struct("lcp", y)).alias("best")).select(F.col(x).alias("x"), F.col(f"best.{y}").alias("y"))
    both = best("a", "b").union(best("b", "a"))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def region_join(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Inner join of ``rows`` (_region, _rep, m) with one row a region; many regions are salted by their rows."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), "_region")
    parts = F.ceil(F.col("m") / SALT).cast("int")
    salted = table.join(rows.select("_region", "m").distinct(), "_region").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("m")
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_rep"), parts).cast("int")).join(salted, ["_region", "_salt"]).drop("_salt")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row: id column, n_shingles (long), component_id and kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| of their sets of
    ``size``-word shingles (ASCII lower case; a shorter text is one shingle).
    component_id is the least id reachable. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows without an id are linked with nothing
    either: component_id is null, kept is true. Repeated rows are in one component;
    an id with several texts stands for all of them. Other columns are not carried;
    no rows: no rows. The id column must be integer.
    """
    spark, made = docs.sparkSession, []
    trees, step = forest_shape(percent)
    width = trees * step

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["_text"]:
                s = shingle_set(bytes(t), size)
                k = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, mixed(s))]
                out.append((len(s), *k, signature(s, width).tobytes() if len(s) else None))
            yield pd.DataFrame(out, columns=["n", "k1", "k2", "_sig"]).assign(_id=pdf["_id"].to_numpy())

    all_rows = stage(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).mapInPandas(sign, "n long, k1 long, k2 long, _sig binary, _id long"),
        "dedup-signed",
        made,
    )
    key = ["n", "k1", "k2"]
    reps = stage(all_rows.where("n > 0 and _id is not null").groupBy(*key).agg(F.min("_id").alias("_rep"), F.first("_sig").alias("_sig")), "dedup-sets", made)

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x.iloc[a : a + TEXT_ROWS] for x in batches for a in range(0, len(x), TEXT_ROWS)):  # a row makes ``trees`` rows
            sig = np.frombuffer(b"".join(pdf["_sig"]), np.uint32).reshape(-1, width)
            keys, tails = np.empty((len(sig), trees), np.uint64), np.empty((len(sig), trees, TAIL), np.uint16)
            for t in range(trees):
                acc = np.full(len(sig), t, np.uint64)
                for i in range(step):
                    acc = mixed(acc * M1 + sig[:, t * step + i].astype(np.uint64))
                keys[:, t] = acc
                tails[:, t] = sig[:, [(t * step + step + i) % width for i in range(TAIL)]] & np.uint32(0xFFFF)
            yield pd.DataFrame({"_region": keys.ravel().view(np.int64), "_tail": [x.tobytes() for x in tails.reshape(-1, TAIL)], "_rep": np.repeat(pdf["_rep"].to_numpy(), trees)})

    forest = reps.select("_rep", "_sig").mapInPandas(plant, "_region long, _tail binary, _rep long")
    full = forest.groupBy("_region").agg(F.count("*").alias("m")).where("m > 1")
    forest = stage(forest.join(full, "_region"), "dedup-forest", made)
    placed = forest.drop("_tail")

    enough = least_agreement(percent, width)
    sizes = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    side = lambda x: reps.select(F.col("_rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("_sig").alias(f"sig_{x}"))

    @F.pandas_udf("boolean")
    def may_link(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, width) for s in (a, b))
        return pd.Series((x == y).sum(1) >= enough)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    def confirm(tries: DataFrame, sets: DataFrame | None, label: str) -> DataFrame:
        """The tried pairs that are linked; without ``sets``, those of their documents are read."""
        tried = stage(tries.join(side("a"), "a").join(side("b"), "b").where(sizes(F.col("n_a"), F.col("n_b"))).where(may_link("sig_a", "sig_b")).select("a", "b"), f"dedup-tries-{label}", made)
        if sets is None:
            ids = stage(tried.select(F.col("a").alias("_rep")).union(tried.select("b")).distinct(), f"dedup-ids-{label}", made)
            sets = stage(sets_of(docs, ids, ids.count(), size, text_col, id_col), f"dedup-full-{label}", made)
        full = lambda x: sets.select(F.col("_rep").alias(x), F.col("_set").alias(f"set_{x}"))
        return stage(tried.join(full("a"), "a").join(full("b"), "b").where(linked("set_a", "set_b")).select("a", "b"), f"dedup-links-{label}", made)

    links = confirm(neighbours(forest, step, made), None, "order")
    labels = stage(components(links, made), "dedup-labels", made)

    # Regions whose rows are in different components, with their hubs.
    rows_of = placed.groupBy("_rep").agg(F.sum("m").alias("_full")).join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").select("_rep", "_full", F.coalesce("root", "_rep").alias("_label"))
    named = stage(placed.join(rows_of, "_rep"), "dedup-named", made)
    hubs = named.groupBy("_region").agg(F.min("_label").alias("x"), F.max("_label").alias("y"), F.max_by(F.struct("_rep", "_label"), F.struct("_full", -F.col("_rep"))).alias("_h"))
    hubs = stage(hubs.where("x <> y").select("_region", F.col("_h._rep").alias("_hub"), F.col("_h._label").alias("_hub_label")), "dedup-hubs", made)
    opened = stage(region_join(named.select("_region", "_rep", "m", "_label"), hubs, hubs.count()), "dedup-opened", made)
    ids2 = stage(opened.select("_rep").distinct(), "dedup-ids2", made)
    n2 = ids2.count()
    if n2:
        sets2 = stage(sets_of(docs, ids2, n2, size, text_col, id_col), "dedup-full2", made)
        tries = opened.where("_label <> _hub_label").select(F.greatest("_rep", "_hub").alias("a"), F.least("_rep", "_hub").alias("b")).distinct()
        star = lambda: labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
        labels = stage(components(star().union(confirm(tries, sets2, "hubs")), made), "dedup-labels-hubs", made)

        # Regions in which rows besides the hub still differ.
        named = opened.drop("_label", "_hub_label").join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").select("_region", "_rep", "m", "_hub", F.coalesce("root", "_rep").alias("_label"))
        named = stage(named, "dedup-named2", made)
        counts = named.groupBy("_region", "_label").agg(F.count("*").alias("_c"), F.count(F.when(F.col("_rep") != F.col("_hub"), 1)).alias("_others"))
        sizes_of = counts.groupBy("_region").agg(
            F.sum("_c").alias("_all"), F.max_by("_label", F.struct("_c", "_label")).alias("_main"), F.max("_c").alias("_most"), F.count(F.when(F.col("_others") > 0, 1)).alias("_labels")
        )
        sizes_of = stage(sizes_of.where("_labels > 1").drop("_labels"), "dedup-sizes", made)
        open_ = stage(region_join(named.drop("_hub"), sizes_of, sizes_of.count()), "dedup-open", made)
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        part = lambda n, seed: F.pmod(F.xxhash64("_rep", F.lit(seed)), n).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        loaded = open_.join(reps.select("_rep", "n", "_sig"), "_rep").join(sets2, "_rep")
        carried = ["_region", "_rep", "_label", "n", "_sig", "_set"]
        rest = loaded.where("_label <> _main").withColumn("_i", part(blocks(F.col("_all") - F.col("_most")), 1)).select(*carried, "_i", spread(blocks(F.col("_all"))).alias("_j"))
        every = loaded.withColumn("_j", part(blocks(F.col("_all")), 2)).select(*carried, "_j", spread(blocks(F.col("_all") - F.col("_most"))).alias("_i"))

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            """Links between the two blocks, one for each row on the left and component on the right."""
            out, left, right = [], pdf[pdf["_left"]], pdf[~pdf["_left"]]
            if len(left) and len(right):
                sig = lambda p: np.frombuffer(b"".join(p["_sig"]), np.uint32).reshape(-1, width)
                n1, n2 = left["n"].to_numpy(), right["n"].to_numpy()
                may = (left["_label"].to_numpy()[:, None] != right["_label"].to_numpy()) & (100 * np.minimum(n1[:, None], n2) >= percent * np.maximum(n1[:, None], n2))
                for i in np.flatnonzero(may.any(1)):
                    may[i] &= (sig(right) == sig(left)[i]).sum(1) >= enough
                r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                if len(r):
                    common = overlaps([np.frombuffer(left["_set"].iat[i], np.uint64) for i in r], [np.frombuffer(right["_set"].iat[i], np.uint64) for i in c])
                    yes = may[np.ix_(r, c)] & (100 * common >= percent * (n1[r][:, None] + n2[c] - common))
                    roots, mine, theirs = right["_label"].to_numpy()[c], left["_rep"].to_numpy()[r], right["_rep"].to_numpy()[c]
                    for i in np.flatnonzero(yes.any(1)):
                        hit = np.flatnonzero(yes[i])
                        out += [(mine[i], theirs[hit[k]]) for k in np.unique(roots[hit], return_index=True)[1]]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        block = ["_region", "_i", "_j"]
        pairs = rest.withColumn("_left", F.lit(True)).unionByName(every.withColumn("_left", F.lit(False)))
        second = stage(pairs.groupBy(*block).applyInPandas(compare, "a long, b long"), "dedup-links2", made)
        if second.limit(1).count():
            labels = stage(components(star().union(second), made), "dedup-labels2", made)

    final = reps.select(*key, "_rep").join(labels.withColumnRenamed("node", "_rep"), "_rep", "left").select(*key, F.coalesce("root", "_rep").alias("_root"))
    out = all_rows.select("_id", *key).join(final, key, "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("_root"))
    component = F.when(F.col("_id").isNotNull(), component)
    out = out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
    out = stage(out, "dedup-out")
    remove(spark, made)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows that are not kept; rows of one id stay or go together.

    Rows without an id, and null, empty and blank texts, stay; the columns are those of
    ``docs``, whatever their names; no rows: no rows. ``how``: see near_duplicates.
    """
    gone = near_duplicates(docs, id_col=id_col, **how).where("not kept").select(id_col).distinct()
    gone = stage(gone, "dedup-gone")
    return lookup_join(docs, gone, [id_col], gone.count(), "left_anti").select(docs.columns)
