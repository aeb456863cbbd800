"""Streaming forms: request counts by tumbling window, activity ranges by session window, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def request_counts(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, kind, n, ms): requests and their durations by window; rows later than `late` are dropped, so state stays bounded."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
    return w.select(F.col("window.start").alias("start"), "kind", "n", "ms")


def activity_sessions(log: DataFrame, by: str, gap: str = "1 minute", least_seconds: int = 180, late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n) of closed sessions. As in session windows, end lies one gap after the last row, which is taken off."""
    s = log.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("end"))
    return s.select(by, F.col("w.start").alias("start"), "end", "n").filter(F.unix_micros("end") - F.unix_micros("start") >= least_seconds * 1_000_000)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Everything new in source since the last run, appended to target; ends when it is done."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
