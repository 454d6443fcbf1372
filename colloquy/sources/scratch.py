"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local master, as in tests, may leave it unset; a temporary folder is made there."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="colloquy-"))
        at = _own[0]
    _paths.append(f"{at.rstrip('/')}/colloquy/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def release(spark: SparkSession) -> int:
    """Removes all scratch of this process, once no DataFrame needs it any more. Returns how many paths there were."""
    n = len(_paths)
    while _paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def materialized(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    """What is still there goes when the driver ends, as far as Spark still runs."""
    with contextlib.suppress(Exception):
        if spark := SparkSession.getActiveSession():
            release(spark)
