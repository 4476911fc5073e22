"""At-least-once fan-out into tables that end up with each row once.

A micro-batch goes to several targets. Each target keeps a ledger: a file named by the
query and the number of the batch, written after the rows. A batch that failed half way
is delivered again; targets with its entry leave it out, the others write it anew over
what they had of it, so nothing is doubled. Redelivered messages, which come in a later
batch, are left out by their key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def noted(spark: SparkSession, path: str) -> bool:
    fs, p = file_of(spark, path)
    return fs.exists(p)


def note(spark: SparkSession, path: str) -> None:
    fs, p = file_of(spark, path)
    fs.create(p, True).close()


def table_rows(spark: SparkSession, target: str, query: str, schema, upto: int | None = None) -> DataFrame:
    """The rows of a target; those of batches before ``upto`` only, if it is given. Batches without an entry in the ledger do not count."""
    fs, p = file_of(spark, f"{target}/ledger/{query}")
    done = sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []
    paths = [f"{target}/rows/{query}/{n}" for n in done if upto is None or n < upto]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fan_out_writer(targets: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]], query: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch to all targets: name -> (folder, the target's part of a batch).

    ``query`` names the stream in the ledgers; rows whose ``key`` a target has from an
    earlier batch are left out, of equal keys in a batch one stays. If a target fails, the
    others are written all the same, and then the first failure is raised, so that the
    batch is delivered again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, failed = batch.sparkSession, []
        batch = batch.persist()
        for folder, part in targets.values():
            entry = f"{folder}/ledger/{query}/{number}"
            if noted(spark, entry):
                continue
            try:
                rows = part(batch).dropDuplicates(key)
                rows = rows.join(table_rows(spark, folder, query, rows.schema, number).select(*key), key, "left_anti").select(*rows.columns)
                rows.write.mode("overwrite").parquet(f"{folder}/rows/{query}/{number}")
                note(spark, entry)
            except Exception as e:  # the other targets get theirs; the batch comes again
                failed.append(e)
        batch.unpersist()
        if failed:
            raise failed[0]

    return write


def routed(kind: str, types: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: batch.where(F.col(kind).isin(*types))
