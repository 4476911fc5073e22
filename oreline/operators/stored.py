"""Tables in files that are changed and paged without reading or writing all of them.

A bucketed table keeps its rows in buckets by a hash of the key. A change rewrites only
the buckets that it touches; a manifest names the files of every bucket, and a new one
is put in place when all are written, so readers see the table before or after. A
sorted table keeps its rows in files in order, with their number and least and greatest
key, so that a page reads the one or two files that hold it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET_ROWS = 1_000_000  # rows of a bucket, on average, when a table is made
MOST_BUCKETS = 20_000  # so that a manifest stays small
FILE_ROWS = 1_000_000  # rows of a file of a sorted table, about
MOST_FILES = 20_000


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all; an error if it is there already."""
    fs, p = hadoop(spark, path)
    _, draft = hadoop(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if fs.exists(p) or not fs.rename(draft, p):
        raise RuntimeError(f"{path} was written by another change")


def get(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file


@dataclass
class BucketedTable:
    """Rows by bucket of ``keys`` under ``path``. Changes return the table's next version; this one stays readable."""

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int
    schema: StructType
    version: int = 0
    files: dict[int, str] = field(default_factory=dict)  # folder of each bucket that has rows
    rewritten: int = 0  # buckets that the last change wrote

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> BucketedTable:
        if buckets is None:
            buckets = max(1, min(MOST_BUCKETS, -(-df.count() // BUCKET_ROWS)))
        t = cls(df.sparkSession, path, keys, buckets, df.schema, -1)
        return t._next(df.withColumn("_bucket", t.bucket()), set(range(buckets)))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedTable:
        """The newest version."""
        fs, p = hadoop(spark, f"{path}/manifests")
        last = max(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())
        m = json.loads(get(spark, f"{path}/manifests/{last}"))
        return cls(spark, path, m["keys"], m["buckets"], StructType.fromJson(m["schema"]), last, {int(b): f for b, f in m["files"].items()}, m["rewritten"])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        paths = [f for b, f in sorted(self.files.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _next(self, rows: DataFrame, touched: set[int]) -> BucketedTable:
        n, folder = self.version + 1, f"{self.path}/rows/{self.version + 1}-{uuid.uuid4().hex}"  # not that of another change
        if touched:
            rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
        fs, p = hadoop(self.spark, folder)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        written = {int(x.split("=")[1]): f"{folder}/{x}" for x in names if x.startswith("_bucket=")}
        files = {b: f for b, f in self.files.items() if b not in touched} | written
        out = BucketedTable(self.spark, self.path, self.keys, self.buckets, self.schema, n, files, len(touched))
        put(self.spark, f"{self.path}/manifests/{n}", json.dumps({"keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(), "files": files, "rewritten": len(touched)}))
        return out

    def changed(self, touching: DataFrame, change: Callable[[DataFrame], DataFrame]) -> BucketedTable:
        """``change`` of the rows of the buckets that the keys in ``touching`` fall into; all other files stay as they are."""
        touched = {r[0] for r in touching.select(self.bucket()).distinct().collect()}  # buckets at most
        rows = change(self.read(touched)).select(*self.schema.names)
        return self._next(rows.withColumn("_bucket", self.bucket()), touched)

    def upsert(self, new: DataFrame, order: Column | None = None) -> BucketedTable:
        """Rows of ``new`` in place of those with their key, and besides; of equal keys in ``new`` the last by ``order``."""
        if order is not None:
            new = new.groupBy(*self.keys).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
        return self.changed(new, lambda old: old.join(new.select(*self.keys), self.keys, "left_anti").select(*old.columns).unionByName(new))

    def update(self, ids: DataFrame, values: dict[str, Column], where: Column | None = None) -> BucketedTable:
        """``values`` for the rows with a key in ``ids`` that also fit ``where``; values may read the columns of ``ids``."""

        def change(old: DataFrame) -> DataFrame:
            j = old.join(ids.withColumn("_hit", F.lit(True)), self.keys, "left")
            hit = F.col("_hit").isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
            return j.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns))

        return self.changed(ids, change)

    def delete(self, ids: DataFrame) -> BucketedTable:
        return self.changed(ids, lambda old: old.join(ids.select(*self.keys).distinct(), self.keys, "left_anti").select(*old.columns))

    def deduplicate(self, order: Column) -> BucketedTable:
        """The first row by ``order`` of each key; only buckets that hold a key twice are written. Null keys group together."""
        twice = self.read().groupBy(*self.keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*self.keys)
        return self.changed(twice, lambda old: old.groupBy(*self.keys).agg(F.min_by(F.struct(*old.columns), order).alias("_r")).select("_r.*"))


@dataclass
class SortedTable:
    """Rows in files in ascending order of ``order`` (together unique): folder, and of each file its path, rows, least and greatest order values."""

    spark: SparkSession
    schema: StructType
    order: list[str]
    files: list[tuple[str, int, tuple, tuple]]

    @classmethod
    def create(cls, df: DataFrame, path: str, order: list[str], files: int | None = None) -> SortedTable:
        if files is None:
            files = max(1, min(MOST_FILES, -(-df.count() // FILE_ROWS)))
        df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        key = F.struct(*order)
        found = df.sparkSession.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
        listed = sorted(((tuple(r["a"]), r["f"], r["n"], tuple(r["b"])) for r in found.collect()), key=lambda x: x[1].rsplit("/", 1)[1])  # a row a file; names go by partition
        return cls(df.sparkSession, df.schema, order, [(f, n, a, b) for a, f, n, b in listed])

    def count(self) -> int:
        """From the manifest, without a scan."""
        return sum(n for _, n, _, _ in self.files)

    def read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def page(self, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
        """Rows ``offset`` to ``offset`` + ``limit`` in order, ``most`` at most, out of the files that hold them."""
        limit, offset = min(max(1, limit), most), max(0, offset)
        use, skipped, seen = [], 0, 0
        for f, n, _, _ in self.files:
            if seen + n <= offset:
                skipped += n
            elif seen < offset + limit:
                use.append(f)
            seen += n
        return self.read(use).orderBy(*self.order).offset(offset - skipped).limit(limit)

    def before(self, cursor: tuple | None, limit: int) -> DataFrame:
        """The ``limit`` + 1 rows before ``cursor`` (a prefix of the order values) in falling order; without one, from the end."""
        use, have = [], 0
        for f, n, least, greatest in reversed(self.files):
            if cursor is not None and least[: len(cursor)] >= cursor:
                continue
            use.append(f)
            have += n if cursor is None or greatest[: len(cursor)] < cursor else 0
            if have > limit:
                break
        rows = self.read(use)
        if cursor is not None:
            names = self.order[: len(cursor)]
            here = (F.lit(str(v) if isinstance(v, (date, datetime)) else v).cast(self.schema[c].dataType).alias(c) for c, v in zip(names, cursor, strict=True))
            rows = rows.where(F.struct(*names) < F.struct(*here))
        return rows.orderBy(*map(F.desc, self.order)).limit(limit + 1)
