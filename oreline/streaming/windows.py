"""Windows that open with a key's first request, over whole tables and without walking a key in one task.

Each row knows the row that would open the next window if it opened one: its successor.
The windows of a key are the chain of successors from its first row. The chain is marked
by doubling: in round k every row knows the row 2^k windows on, and all marked rows mark
theirs. So a key of n windows takes log2(n) rounds of joins by row, whatever its rows.

Successors are found by time slots as long as a window: the end of a window that opens in
a slot lies in the next slot, so a row is compared with rows of two slots only, or else
goes to the first row of a later slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut


def chain_marks(rows: DataFrame, figures: dict | None = None) -> DataFrame:
    """(key, node) of the rows on the chain from each key's least node. ``rows``: key, node, next (null at the end)."""
    marks = cut(rows.groupBy("key").agg(F.min("node").alias("node")))
    jump = cut(rows.where("next is not null").select("key", "node", "next"))
    while jump.count():
        more = marks.join(jump, ["key", "node"]).select("key", F.col("next").alias("node"))
        marks = cut(marks.unionByName(more).distinct())
        step = jump.select("key", F.col("node").alias("next"), F.col("next").alias("_far"))
        jump = cut(jump.join(step, ["key", "next"]).select("key", "node", F.col("_far").alias("next")))
        if figures is not None:
            figures["rounds"] = figures.get("rounds", 0) + 1
    return marks


def first_from(rows: DataFrame, length: int, payload: Column | None = None) -> DataFrame:
    """(key, at, then): for each different time of a key the first row at ``length`` microseconds later or after; ``then`` holds its time and the least ``payload``.

    ``rows``: key, at (microseconds) and what ``payload`` reads.
    """
    slot = lambda c: F.floor(c / length)
    times = cut(rows.groupBy("key", "at").agg(F.struct(F.col("at").alias("_at"), F.min(F.lit(0) if payload is None else payload).alias("_p")).alias("_row")))
    both = times.select("key", (F.col("at") + length).alias("_t"), "at", F.lit(None).cast(times.schema["_row"].dataType).alias("_row")).unionByName(times.select("key", F.col("at").alias("_t"), F.lit(None).cast("long").alias("at"), "_row"))
    ahead = Window.partitionBy("key", "_slot").orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumn("_slot", slot(F.col("_t"))).withColumn("then", F.min("_row").over(ahead)).where("at is not null")
    slots = times.groupBy("key", slot(F.col("at")).alias("_slot")).agg(F.min("_row").alias("_first"))
    asked = near.where("then is null").select("key", "_slot").distinct()
    told = slots.unionByName(asked.select("key", "_slot", F.lit(None).cast(times.schema["_row"].dataType).alias("_first"))).groupBy("key", "_slot").agg(F.max("_first").alias("_first"))
    later = F.first("_first", ignorenulls=True).over(Window.partitionBy("key").orderBy("_slot").rowsBetween(1, Window.unboundedFollowing))  # a row a slot: as many as the time spans
    told = told.select("key", "_slot", later.alias("_later"))
    out = near.select("key", "at", "_slot", "then").join(told, ["key", "_slot"], "left")
    return out.select("key", "at", F.coalesce("then", "_later").alias("then"))


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def opened_windows(requests: DataFrame, key: str, at: str = "at", most: int = 60, seconds: int = 60, figures: dict | None = None) -> DataFrame:
    """Windows of each key - ``seconds`` from the request that opens one, the next by the first request from then on - with their requests and how many are over ``most``.

    Returns the key, start, n and rejected. Requests without a time are left out; a null
    key is a key like others; equal times fall into one window; no rows: no rows.
    """
    length = seconds * 1_000_000
    name = F.to_json(F.struct(F.col(key).alias("k")))
    r = cut(requests.where(F.col(at).isNotNull()).groupBy(name.alias("key"), micros(at).alias("at")).agg(F.count("*").alias("n"), F.first(key).alias("_own")))
    marks = chain_marks(first_from(r, length).select("key", F.col("at").alias("node"), F.col("then._at").alias("next")), figures)
    slot = F.floor(F.col("at") / length)
    opens = marks.select("key", F.col("node").alias("_open"), F.explode(F.array(F.floor(F.col("node") / length), F.floor(F.col("node") / length) + 1)).alias("_slot"))
    held = r.withColumn("_slot", slot).join(opens, ["key", "_slot"]).where("_open <= at").groupBy("key", "at", "n", "_own").agg(F.max("_open").alias("_open"))
    g = held.groupBy("key", "_open").agg(F.sum("n").alias("n"), F.first("_own").alias("_own"))
    return g.select(F.col("_own").alias(key), F.timestamp_micros("_open").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("rejected"))


def opened_batches(messages: DataFrame, key: str, at: str, seq: str, most: int = 10, seconds: int = 30, figures: dict | None = None) -> DataFrame:
    """``messages`` with ``batch``, the number of the key's message that opened theirs: ``most`` messages or ``seconds`` from its first one, whichever comes first.

    Messages of a key are numbered from 0 by time and ``seq`` (unique within a time).
    Those without a time are left out; a null key is a key like others.
    """
    length, name = seconds * 1_000_000, F.to_json(F.struct(F.col(key).alias("k")))
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = messages.where(F.col(at).isNotNull()).select(F.struct("*").alias("_m"), name.alias("key"), micros(at).alias("at"), F.col(seq).alias("_seq"))
    # Numbers within a key: of parts in order, plus what the parts before hold.
    m = cut(m.repartitionByRange(parts, "key", "at", "_seq").withColumn("_part", F.spark_partition_id()))
    before = F.sum("_c").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = m.groupBy("key", "_part").agg(F.count("*").alias("_c")).select("key", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("key", "_part").orderBy("at", "_seq")) - 1
    m = cut(m.withColumn("_own", own).join(offsets, ["key", "_part"]).select("_m", "key", "at", (F.col("_own") + F.col("_before")).alias("node")))
    then = first_from(m, length, F.col("node")).select("key", "at", F.col("then._p").alias("_then"))
    full = m.select("key", (F.col("node") - most).alias("node"), F.col("node").alias("_full"))
    nodes = m.join(then, ["key", "at"]).join(full, ["key", "node"], "left").select("key", "node", F.least("_then", "_full").alias("next"))
    marks = chain_marks(nodes, figures)
    slot = F.floor(F.col("node") / most)
    opens = marks.select("key", F.col("node").alias("batch"), F.explode(F.array(slot, slot + 1)).alias("_slot"))
    held = m.withColumn("_slot", slot).join(opens, ["key", "_slot"]).where("batch <= node").groupBy("key", "node").agg(F.max("batch").alias("batch"))
    return m.join(held, ["key", "node"]).select("_m.*", "batch")
