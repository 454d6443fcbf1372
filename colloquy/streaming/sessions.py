"""Streams: a dialogue's state by session, and counts in windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.scratch import scratch_path

SEEN = StructType([StructField("turns", LongType()), StructField("user_turns", LongType()), StructField("chars", LongType()), StructField("last_turn", LongType())])
OUT = StructType([StructField("conv_id", LongType()), StructField("turns", LongType()), StructField("user_turns", LongType()), StructField("chars", LongType()), StructField("last_turn", LongType())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversation(StatefulProcessor):
    """Running totals of a conversation, kept for ttl_ms after its last message, or for good."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", SEEN, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        turns, user, chars, last = self.seen.get() if self.seen.exists() else (0, 0, 0, -1)
        for batch in rows:
            turns += len(batch)
            user += int((batch["role"] == "user").sum())
            chars += int(batch["text"].fillna("").str.len().sum())
            last = max(last, int(batch["turn"].max()))
        self.seen.update((turns, user, chars, last))
        yield pd.DataFrame([(key[0], turns, user, chars, last)], columns=["conv_id", "turns", "user_turns", "chars", "last_turn"])

    def close(self) -> None:
        pass


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a folder as a stream of its files. A table that is one file is read through its folder, as streams need one."""
    path = f"{folder}/{table}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder) if single else reader.parquet(path)


def conversation_state(spark: SparkSession, folder: str, ttl_ms: int | None = None) -> DataFrame:
    """(conv_id, turns, user_turns, chars, last_turn): the latest state of each conversation once all that is there has streamed by.

    With a ttl_ms the stream keeps time and runs on for new rows until it is stopped; without one it ends by itself.
    """
    out, mark = scratch_path(spark, "states"), scratch_path(spark, "progress")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        rows = stream_of(spark, folder, "conversations").where("conv_id is not null").groupBy("conv_id")
        states = rows.transformWithStateInPandas(Conversation(ttl_ms), OUT, "Update", "None" if ttl_ms is None else "ProcessingTime")
        states.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    every = spark.read.schema(StructType([*OUT.fields, StructField("batch", IntegerType())])).parquet(out)
    return every.groupBy("conv_id").agg(F.max_by(F.struct("turns", "user_turns", "chars", "last_turn"), F.struct("batch", "turns")).alias("s")).select("conv_id", "s.*")


def windowed_counts(spark: SparkSession, folder: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, value): counts and sums in windows of event time; each batch replaces the windows that it has changed."""
    out, mark = scratch_path(spark, "windows"), scratch_path(spark, "progress")
    rows = stream_of(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    sums = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    flat = sums.select(F.col("w.start").alias("start"), "event_type", "events", "value")
    flat.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(StructType([*flat.schema.fields, StructField("batch", IntegerType())])).parquet(out)
    last = every.groupBy("start", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("s"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "s.events", "s.value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, events, value): a user's runs of events with no gap that long; the same on streams and tables."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", gap) if events.isStreaming else events
    return out.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")
