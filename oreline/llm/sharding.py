"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one atomic group. Groups are ordered by the digest of
their text; the smallest shard capacity for which a greedy left-to-right fill
needs at most ``n_shards`` shards is found by binary search, and the order is cut
where the greedy fill cuts it. The search runs over bounded summaries: sums per
digest prefix. Two greedy fills bracket the true one - one treats a prefix as
indivisible, one as divisible - and only prefixes in which a cut may fall are
summed again with longer prefixes, until those hold one group each. The answer is
therefore exact, while the driver sees some ten thousand sums at any input size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PREFIX = 4  # hex digits of the first summary: 65,536 sums
REFINE_ROWS = 65_536
PARTS, PART = 256, 500_000  # parts into which a group is dealt while it is numbered, at least, and rows of a part, on average at most


def cut_greedily(prefix: np.ndarray, capacity: int, n_shards: int, whole: np.ndarray | None = None) -> list[int]:
    """Byte offsets of the greedy cuts; ``prefix`` has the offset of each unit's end.

    ``whole`` marks indivisible units; None: all are. A cut inside a divisible unit
    is put where the capacity ends.
    """
    cuts, at, total = [], 0, int(prefix[-1]) if len(prefix) else 0
    for _ in range(n_shards):
        end = min(at + capacity, total)
        i = int(np.searchsorted(prefix, end, side="right"))
        start = int(prefix[i - 1]) if i else 0
        if end == total or (whole is not None and i < len(prefix) and not whole[i]):
            at = max(at, end)
        else:
            at = max(at, start)
        cuts.append(at)
    return cuts


def smallest_capacity(prefix: np.ndarray, n_shards: int, whole: np.ndarray | None = None) -> int:
    """Binary search for the least capacity at which the greedy fill reaches the end."""
    total = int(prefix[-1]) if len(prefix) else 0
    low, high = max(1, -(-total // n_shards)), max(1, total)
    while low < high:
        mid = (low + high) // 2
        if cut_greedily(prefix, mid, n_shards, whole)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(sums, n_shards: int) -> tuple[int, list[tuple[str, int]], dict[str, int]]:
    """Capacity, the (first digest, rows before) of each shard but the first, rows by first prefix.

    ``sums(length, within)`` gives (prefix, first digest, last digest, bytes, rows) for the
    prefixes of that length, of those that begin with one of ``within`` (None: all).
    """
    units = sorted(sums(PREFIX, None))
    rows_of = {u[0]: u[4] for u in units}
    while True:
        size = np.array([u[3] for u in units], dtype=np.int64)
        end = np.cumsum(size)
        whole = np.array([u[1] == u[2] for u in units], dtype=bool)
        low, high = smallest_capacity(end, n_shards, whole), smallest_capacity(end, n_shards)
        first, last = cut_greedily(end, low, n_shards)[:-1], cut_greedily(end, high, n_shards, whole)[:-1]
        begin = end - size
        open_ = np.zeros(len(units), dtype=bool)
        for a, b in zip(first, last, strict=True):
            open_ |= (end > a) & (begin < b)
        open_ &= ~whole
        if not open_.any():
            break
        chosen = [units[i] for i in np.flatnonzero(open_)]
        kept = [u for i, u in enumerate(units) if not open_[i]]
        finer = []
        for length in sorted({len(u[0]) for u in chosen}):
            within = [u[0] for u in chosen if len(u[0]) == length]
            step = 1
            while len(within) * 16 ** (step + 1) <= REFINE_ROWS and length + step < 32:
                step += 1
            finer += sums(length + step, within)
        units = sorted(kept + finer)
    cuts = cut_greedily(end, high, n_shards)[:-1]
    rows = np.cumsum([u[4] for u in units])
    marks = []
    for cut in cuts:
        i = int(np.searchsorted(end, cut, side="right"))
        marks.append((units[i][1], int(rows[i] - units[i][4])) if i < len(units) else ("g", int(rows[-1]) if len(units) else 0))
    return high, marks, rows_of


def shard_contiguous(docs: DataFrame, n_shards: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Give every row a shard and a gapless slot in it; shards' bytes are as equal as contiguity allows.

    Returns the id column, size (UTF-8 bytes of the text plus 1), text_digest, shard
    and slot, in which the rows of a shard are ordered by digest and id. A null text
    counts as an empty one (size 1) and is one group with the empty texts. Repeated
    rows get slots of their own. No rows: no rows. Other columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("_key"),
        ),
        "shard-rows",
    )

    def sums(length: int, within: list[str] | None) -> list[tuple]:
        part = rows if within is None else rows.where(F.substring("_key", 1, len(within[0])).isin(within))
        found = part.groupBy(F.substring("_key", 1, length).alias("p")).agg(
            F.min("_key").alias("a"), F.max("_key").alias("b"), F.sum("size").alias("s"), F.count("*").alias("n")
        )
        return [tuple(r) for r in found.collect()]

    _, marks, rows_of = minimax_cuts(sums, n_shards)
    base, before = [], 0
    for p in sorted(rows_of):
        base.append((p, before))
        before += rows_of[p]
    bases = docs.sparkSession.createDataFrame(base, "_bucket string, _base long")

    spread = max(PARTS, -(-before // PART))  # parts of a group, if all rows were one
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64("_id"), F.lit(spread)).cast("int"))
    runs = rows.groupBy("_key", "_sub").agg(F.count("*").alias("_n"))
    in_bucket = Window.partitionBy("_bucket").orderBy("_key", "_sub")
    runs = (
        runs.withColumn("_bucket", F.substring("_key", 1, PREFIX))
        .withColumn("_start", F.sum("_n").over(in_bucket) - F.col("_n"))
        .join(F.broadcast(bases), "_bucket")  # at most 16 ** PREFIX rows
        .select("_key", "_sub", (F.col("_base") + F.col("_start")).alias("_from"))
    )
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_sub").orderBy("_id")))
    at: Column = F.col("_from") + F.col("_rn") - 1
    shard, first = F.lit(0), F.lit(0).cast("long")
    for k, (key, n) in enumerate(marks, 1):
        shard = F.when(F.col("_key") >= key, F.lit(k)).otherwise(shard)
        first = F.when(F.col("_key") >= key, F.lit(n).cast("long")).otherwise(first)
    return numbered.join(runs, ["_key", "_sub"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.col("_key").alias("text_digest"), shard.cast("int").alias("shard"), (at - first).alias("slot")
    )
