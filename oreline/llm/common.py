"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows are at most this many.
BROADCAST_ROWS = 100_000
#: Rows of whole texts that Python workers work on at once, and that one Arrow batch holds in :func:`small_batches`.
TEXT_ROWS = 1_000
#: Folders made for applications on one machine that name none.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a session on one machine may name neither; it gets a temporary folder. On a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = LOCAL.get(app) or LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="oreline-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation. The path
    is added to ``made``, so that :func:`remove` can delete what is read no more.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs run inside exchange Arrow batches of at most ``rows`` rows with Python; a smaller bound of the session holds.

    Spark's 10,000 rows of whole texts are tens of MB, held several times over by the
    executor and by each of its Python workers. What is lazy runs outside, by the session's bound.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged folders that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], rows: int, how: str = "left") -> DataFrame:
    """Join a small ``table`` whose row count is known.

    Up to BROADCAST_ROWS rows it is broadcast; beyond, Spark shuffles both sides
    and splits skewed partitions at run time (adaptive skew join).
    """
    return df.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, keys, how)


def working_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has in any case (extra columns may clash)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
