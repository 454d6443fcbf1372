"""Helpers that the training-data operators share: scratch tables, skew-safe lookups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HEAVY of all rows is heavy. At most HEAVY keys can be, so their rows may be broadcast.
HEAVY = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: list[str] = []
_paths: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset; a temporary one is made there."""
    if at := spark.conf.get("spark.checkpoint.dir", ""):
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return _own[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; release() removes it."""
    _paths.append(f"{shared_dir(spark)}/colloquy/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again. It survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """saved(), with the rows of a key in one bucket: a join or cogroup by that key leaves them where they are."""
    spark = df.sparkSession
    _tables.append(f"colloquy_{label}_{uuid.uuid4().hex}")
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", scratch(spark, label)).saveAsTable(_tables[-1])
    return spark.read.table(_tables[-1])


def scan_bytes(df: DataFrame) -> int:
    """What Spark's statistics say that df has, or 0 where they say nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def release(spark: SparkSession) -> int:
    """Removes all scratch of this process, once no DataFrame needs it any more. Returns how many paths there were."""
    n = len(_paths)
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _paths:
        drop_path(spark, _paths.pop())
    return n


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def attach(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows left-joined to table (one row for each key) on key, whatever the skew.

    table[count] says how many of rows have the key; total is the number of rows. Keys with 1/HEAVY of
    the rows or more, HEAVY of them at most, are broadcast; the other keys are shuffled, and none of them
    is large. Rows whose key is already found get a key of their own for that shuffle, so that they spread.
    """
    cols = [c for c in table.columns if c != key]
    is_heavy = F.col(count) * HEAVY >= total
    heavy = table.where(is_heavy).select(F.col(key).alias("__k"), F.struct(*cols).alias("__h"))
    light = table.where(~is_heavy).select(F.col(key).alias("__k"), F.struct(*cols).alias("__l"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("__k"), "left").drop("__k")
    cold = out.where(F.col("__h").isNull()).drop("__h").join(light, F.col(key) == F.col("__k"), "left").drop("__k").withColumnRenamed("__l", "__v")
    hot = out.where(F.col("__h").isNotNull()).withColumnRenamed("__h", "__v")
    both = hot.unionByName(cold)
    return both.select("*", *[F.col(f"__v.{c}").alias(c) for c in cols if c not in rows.columns]).drop("__v")


def text_of(name: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(name: str, m: int):
    """crc32 of an id written as decimal text, modulo m."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % m


def id_key(name: str):
    """An id as a join key that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def small_batches(spark: SparkSession) -> None:
    """Batches of a few megabytes between Spark and Python: texts are long, and several workers share an executor's memory. What the application itself has set stays."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2048"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def give_back() -> None:
    """Returns freed memory to the system. Python workers stay for later tasks, and several of them share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def clear(spark: SparkSession) -> None:
    """Has the driver give back what it no longer needs, in Python and the JVM, and Spark remove shuffles and broadcasts that no DataFrame has any more.

    Spark itself does so when the driver's heap is full, and then the heap stays as large as it became.
    """
    give_back()
    spark._jvm.System.gc()


#: Tables of up to so many rows of ids and digests are broadcast; larger ones are shuffled.
FEW = 1 << 18


def if_few(table: DataFrame) -> DataFrame:
    """A saved table of short rows, to be broadcast if it has FEW of them at most."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def text_digest(name: str):
    return F.md5(text_of(name).cast("binary"))


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each group; rows(id, node, group, n_same) has every distinct pair of an id and a text's digest, and how often it stands there.

    The smallest id stays (null last), of its texts that with the smallest digest, and of equal rows one.
    """
    least = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    first = rows.groupBy("group").agg(F.min(least).alias("first"))
    several = saved(rows.groupBy("group").agg(F.sum("n_same").alias("n")).where("n > 1").join(first, "group"), "groups")
    # only rows of groups with several have to be told: most are alone and stay
    told = rows.join(several, "group").select(id_key("id").alias("__id"), F.col("node").alias("__node"), (~least.eqNullSafe(F.col("first"))).alias("__goes"))
    return without(docs, told, id_col, text_digest(text_col))


def without(docs: DataFrame, told: DataFrame, id_col: str, digest) -> DataFrame:
    """docs without the rows that told(__id, __node, __goes) sends away; of equal rows that it lets stay, one. Rows that it does not name stay as they are."""
    own = docs.withColumn("__key", id_key(id_col)).withColumn("__text", digest)
    marked = own.join(if_few(saved(told, "told")), (F.col("__key") == F.col("__id")) & (F.col("__text") == F.col("__node")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = marked.where("__goes is null").select(*columns)
    return alone.unionByName(marked.where("not __goes").dropDuplicates(["__key", "__text"]).select(*columns))


@atexit.register
def _at_exit() -> None:
    """What is still there goes when the driver ends, as far as Spark still runs."""
    with contextlib.suppress(Exception):
        if spark := SparkSession.getActiveSession():
            release(spark)
