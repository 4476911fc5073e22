"""Property graphs as node and edge tables: co-occurrence, neighbours, upserts, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def cooccurrence(terms: DataFrame) -> DataFrame:
    """Pairs of labels (a < b) that share groups, weighted by distinct groups. ``terms``: grp, label."""
    t = terms.select("grp", "label").distinct()
    pairs = t.select("grp", F.col("label").alias("a")).join(t.select("grp", F.col("label").alias("b")), "grp").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def neighbours(terms: DataFrame, label: str) -> DataFrame:
    """Labels that share groups with ``label``, by number of groups."""
    t = terms.select("grp", "label").distinct()
    own = t.where(F.col("label") == label).select("grp")
    return t.join(own, "grp", "left_semi").where(F.col("label") != label).groupBy("label").agg(F.count("*").alias("weight"))


def merge_nodes(old: DataFrame, new: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """Nodes of both tables, last writer wins for equal keys."""
    both = old.unionByName(new)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).where("_rn = 1").drop("_rn")


def live_edges(edges: DataFrame, figures: dict | None = None) -> DataFrame:
    """Edges (src, dst) out of the nodes on or before a cycle, by trimming and path doubling.

    A round drops the edges to nodes without edges of their own, and leads each edge to a
    node with a single edge on to where that one leads; neither changes which nodes reach
    a cycle. What is left when nothing was dropped can be followed forever. A path of
    n single edges takes about log2(n) rounds; only paths through nodes of several edges
    each are trimmed step by step. The edges left may be such shortcuts. ``figures``
    receives the rounds.
    """
    live = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("_c", F.lit(1)))
    n = live.count()
    while n:
        ways = live.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_n"), F.min("dst").alias("_next"))
        on = live.join(ways, "dst").select("src", F.when(F.col("_n") == 1, F.col("_next")).otherwise(F.col("dst")).alias("dst"))
        live = cut(on.groupBy("src", "dst").agg(F.count("*").alias("_c")))
        left, kept = live.agg(F.count("*"), F.coalesce(F.sum("_c"), F.lit(0))).collect()[0]
        if figures is not None:
            figures["rounds"] = figures.get("rounds", 0) + 1
        if kept == n:
            break
        n = left
    return live.select("src", "dst")


def cyclic_nodes(edges: DataFrame, figures: dict | None = None) -> DataFrame:
    """Nodes on or before a cycle of ``edges`` (src, dst): see live_edges."""
    return live_edges(edges, figures).select(F.col("src").alias("node")).distinct()


def witness_cycles(edges: DataFrame, figures: dict | None = None) -> DataFrame:
    """(cycle, node, next): one cycle for every set of nodes that run into it, named by its least node.

    Each node on or before a cycle goes on to its least neighbour of that kind, so each
    ends in one cycle. Doubling the way that all have gone, for as many steps as there are
    nodes, leads every node into its cycle, and only nodes of cycles are still led to.
    """
    nodes = cut(cyclic_nodes(edges, figures))
    kept = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    way = cut(kept.groupBy("src").agg(F.min("dst").alias("next")))
    n, gone = way.count(), 1
    far = way.select("src", F.col("next").alias("at"), F.col("next").alias("least"))
    while gone < n:  # at: where 2^k steps lead; least: the least node passed on them
        step = far.select(F.col("src").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        far = cut(far.join(step, "at").select("src", F.col("_at").alias("at"), F.least("least", "_least").alias("least")))
        gone *= 2
        if figures is not None:
            figures["doublings"] = figures.get("doublings", 0) + 1
    on = far.select(F.col("at").alias("src")).distinct()
    return way.join(on, "src").join(far.select("src", "least"), "src").select(F.col("least").alias("cycle"), F.col("src").alias("node"), "next")


def dependency_list(edges: DataFrame) -> DataFrame:
    """Every node of ``edges`` (src, dst) with how many it needs, the first of them, and how many need it."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("needs"), F.min("dst").alias("first_needs"))
    back = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("needed_by"))
    return out.join(back, "node", "full").select("node", F.coalesce("needs", F.lit(0)).alias("needs"), "first_needs", F.coalesce("needed_by", F.lit(0)).alias("needed_by"))


def analysis_graph(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, key) and edges (src, dst, type) of extraction results.

    ``extractions``: document, processes (array of struct name, steps, parts), entities (array of
    struct name), rules (array of struct condition, outcome), actors and requirements (arrays).
    """
    p = extractions.select("document", F.explode("processes").alias("p")).select("document", "p.*")
    inner = lambda c: p.select("document", F.col("name").alias("src"), F.explode(c).alias("key"))
    outer = lambda c: extractions.select("document", F.col("document").alias("src"), F.explode(c).alias("key"))
    parts = {
        ("Process", "HAS_PROCESS"): p.select("document", F.col("document").alias("src"), F.col("name").alias("key")),
        ("SubProcess", "HAS_SUBPROCESS"): inner("parts"),
        ("Method", "HAS_METHOD"): inner("steps"),
        ("Entity", "HAS_ENTITY"): outer(F.transform("entities", lambda e: e["name"])),
        ("Condition", "HAS_CONDITION"): outer(F.transform("rules", lambda r: r["condition"])),
        ("Actor", "HAS_ACTOR"): outer("actors"),
        ("Requirement", "HAS_REQUIREMENT"): outer("requirements"),
    }
    nodes = extractions.select(F.lit("Document").alias("label"), F.col("document").alias("key"))
    edges = None
    for (label, kind), rows in parts.items():
        nodes = nodes.union(rows.select(F.lit(label), "key"))
        one = rows.select("src", F.col("key").alias("dst"), F.lit(kind).alias("type"))
        edges = one if edges is None else edges.union(one)
    return nodes.where("key is not null").distinct(), edges.where("src is not null and dst is not null").distinct()
