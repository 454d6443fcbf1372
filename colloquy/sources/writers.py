"""Sinks: metrics, transcripts, probes with a head row, models, and appending that can be taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(summary: DataFrame, path: str) -> None:
    """A summary of a few rows as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_transcripts(shown: DataFrame, messages: DataFrame, targets: DataFrame, path: str) -> None:
    """Per session all turns with their results: shown(sample_id, turn, doc, rnk), messages(sample_id, turn, text), targets(sample_id, target)."""
    marked = shown.join(targets, "sample_id").withColumn("is_target", F.col("doc") == F.col("target"))
    results = marked.groupBy("sample_id", "turn").agg(F.array_sort(F.collect_list(F.struct("rnk", "doc", "is_target"))).alias("results"))
    turns = messages.join(results, ["sample_id", "turn"], "left")
    turns.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "results"))).alias("turns")).write.mode("overwrite").json(path)


def write_probes(probes: DataFrame, meta: str, path: str) -> None:
    """Probes as JSON lines, and a sidecar folder with the head row."""
    probes.write.mode("overwrite").json(path)
    probes.sparkSession.createDataFrame([(meta,)], "_meta string").coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_meta")


def write_sheet(sheet: DataFrame, meta: str, path: str) -> None:
    """A sheet of operators/probes.py as JSON lines to be filled in, and a sidecar folder with what it is about."""
    write_probes(sheet.coalesce(1), meta, path)


def write_model(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not yet at path; a run that broke off is taken up where it was. Returns the number at path."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.schema(rows.schema).parquet(path).select(key)
        rows = rows.join(done, key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count()
