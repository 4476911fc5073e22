"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (domain, language, source). At each node it is
split among the children by weight; a child never gets more than its supply
(tokens times epochs allowed), and what it cannot take goes to its siblings by
their weights. Since a node's own budget never exceeds the supply below it,
siblings always absorb a shortage before an ancestor does. A leaf reads whole
epochs and then a prefix of one more, each epoch in its own seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, stage, working_names

#: What a token is here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a bucket of a leaf's epoch.
BUCKET = 3


def weight_of(level: Column, weights: dict[str, int] | None) -> Column:
    """Integer weight of a node by its name; names not listed weigh 1 (0 if a dict has "*": 0)."""
    rest = F.lit(int((weights or {}).get("*", 1))).cast("long")
    out = rest
    for name, w in (weights or {}).items():
        if name != "*":
            out = F.when(level == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def split_budget(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Water-filling among siblings, in whole tokens.

    ``nodes`` has the parent columns, the child column, supply, weight and
    parent_budget (long). Adds budget. Children are taken by supply per weight;
    one is full if its share of what is left covers its supply. Weight 0: nothing.
    """
    order = [F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).asc_nulls_last(), F.col(child).asc()]
    past = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parents)
    zero = F.lit(0).cast("long")
    n = (
        nodes.withColumn("_b", F.col("parent_budget") - F.coalesce(F.sum("supply").over(past), zero))
        .withColumn("_w", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(past), zero))
        .withColumn("_full", (F.col("weight") > 0) & (F.col("supply") * F.col("_w") <= F.col("weight") * F.col("_b")))
        .withColumn("_bl", F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(all_), zero))
        .withColumn("_wl", F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(zero)).over(all_))
    )
    share = F.when(F.col("_wl") > 0, F.expr("weight * _bl div _wl")).otherwise(zero)
    budget = F.when(F.col("_full"), F.col("supply")).otherwise(F.least(F.col("supply"), share))
    return n.withColumn("budget", budget).drop("_b", "_w", "_full", "_bl", "_wl")


def leaf_budgets(supply: DataFrame, levels: list[str], weights: list[dict[str, int] | None], percent: int, epochs: int) -> DataFrame:
    """Budget of every leaf. ``supply`` has the level columns and tokens (of one epoch).

    The whole budget is ``percent`` per cent of all tokens of one epoch, and at
    most all tokens times ``epochs``.
    """
    total = supply.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("t")).select(
        F.least(F.expr(f"t * {int(percent)} div 100"), F.col("t") * int(epochs)).alias("parent_budget"), F.lit(0).alias("_root")
    )
    out = total
    for k in range(len(levels)):
        up = ["_root", *levels[:k]]
        nodes = (
            supply.withColumn("_root", F.lit(0))
            .groupBy(*up, levels[k])
            .agg((F.sum("tokens") * int(epochs)).alias("supply"))
            .withColumn("weight", weight_of(F.col(levels[k]), weights[k]))
        )
        out = split_budget(nodes.join(out, up), up, levels[k])
        out = out.select("_root", *levels[: k + 1], F.col("budget").alias("parent_budget"))
    return out.select(*levels, F.col("parent_budget").alias("budget")).join(supply, levels)


def mix_to_weights(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: list[dict[str, int] | None],
    percent: int = 100,
    epochs: int = 1,
    seed: int = 17,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """How often each row is read so that the tree's token shares follow the weights.

    ``levels`` names the tree's levels, top first, with the expressions that give
    them. Returns all columns of ``docs`` plus the level columns (a column of the
    same name is replaced), n_tokens and copies (0: left out). In an epoch, rows go
    by md5(seed:epoch:id); a row is taken if the tokens up to its end fit.

    Null levels are named "" and a null id "null"; a null or empty text has 0 tokens
    and is taken while the prefix reaches it. Rows with one id stand or fall
    together. No rows: no rows.
    """
    names = list(levels)
    own_rid, own_whole, own_last = working_names(docs.select(*(c for c in docs.columns if c not in names)), "_rid", "_whole", "_last")
    named = docs.withColumns({k: F.coalesce(v.cast("string"), F.lit("")) for k, v in levels.items()}).withColumns(
        {"n_tokens": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"), own_rid: F.coalesce(F.col(id_col).cast("string"), F.lit("null"))}
    )
    slim = stage(named.select(*names, "n_tokens", F.col(own_rid).alias("_rid")), "mix-rows")
    supply = slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = stage(
        leaf_budgets(supply, names, weights, percent, epochs)
        .withColumn("_whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(epochs)).cast("long"))
        .select(*names, "_whole", (F.col("budget") - F.col("_whole") * F.col("tokens")).alias("_rest")),
        "mix-leaves",
    )
    n_leaves = leaves.count()
    key = lambda whole, rid: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(whole).cast("string"), F.col(rid)))

    keyed = lookup_join(slim, leaves, names, n_leaves, "inner").withColumn("_key", key("_whole", "_rid"))
    buckets = keyed.groupBy(*names, F.substring("_key", 1, BUCKET).alias("_bucket")).agg(F.sum("n_tokens").alias("_t"), F.first("_rest").alias("_rest"))
    up_to = Window.partitionBy(*names).orderBy("_bucket")
    open_ = (
        buckets.withColumn("_end", F.sum("_t").over(up_to))
        .where((F.col("_end") > F.col("_rest")) & (F.col("_end") - F.col("_t") <= F.col("_rest")))
        .groupBy(*names)
        .agg(F.min_by(F.struct("_bucket", (F.col("_end") - F.col("_t")).alias("_before")), F.col("_bucket")).alias("_o"))
        .select(*names, "_o._bucket", "_o._before")
    )
    # The last key taken lies in the one bucket of each leaf in which the budget ends.
    inside = lookup_join(keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET)), open_, [*names, "_bucket"], n_leaves, "inner")
    by_key = inside.groupBy(*names, "_key").agg(F.sum("n_tokens").alias("_t"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    last = (
        by_key.withColumn("_end", F.col("_before") + F.sum("_t").over(Window.partitionBy(*names).orderBy("_key")))
        .where(F.col("_end") <= F.col("_rest"))
        .groupBy(*names)
        .agg(F.max("_key").alias("_last"))
    )
    decided = stage(
        leaves.join(open_, names, "left").join(last, names, "left").select(*names, "_whole", F.when(F.col("_bucket").isNull(), F.lit("g")).otherwise(F.coalesce("_last", "_bucket")).alias("_last")),
        "mix-decided",
    )
    decided = decided.withColumnsRenamed({"_whole": own_whole, "_last": own_last})
    out = lookup_join(named, decided, names, n_leaves, "inner")
    copies = F.least(F.col(own_whole) + (key(own_whole, own_rid) <= F.col(own_last)).cast("long"), F.lit(epochs).cast("long")).cast("int")
    return out.withColumn("copies", copies).drop(own_rid, own_whole, own_last)
