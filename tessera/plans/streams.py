"""Registered queries that run streams over the events table until all of it is read, and give what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.records import scratch
from tessera.streaming import streams


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of log rows (ts, kind, ms)."""
    path = f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # as a pattern, as a stream's own path can't be one file
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.floor("value").alias("ms"))


def _finished(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """What the stream has written once its source is read."""
    target, state = scratch(spark, name), scratch(spark, f"{name}-state")
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


def _text(at: str) -> F.Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stream_request_counts(spark, sf):
    """Requests by kind and five minutes; windows that could still get rows, ten minutes before the last one, stay open."""
    counts = _finished(spark, streams.request_counts(_stream(spark, sf)), "request-counts")
    return counts.select(_text("start").alias("start"), "kind", "n", "ms")


def stream_sessions(spark, sf):
    """Stretches of each kind of at least ten minutes, without a gap of ten."""
    sessions = _finished(spark, streams.activity_sessions(_stream(spark, sf), "kind", "10 minutes", 600), "sessions")
    return sessions.select("kind", _text("start").alias("start"), _text("end").alias("end"), "n")


def stream_ingest(spark, sf):
    """Events that arrive in two parts, errors later; the third run finds nothing new: what the target holds."""
    source, target, state = scratch(spark, "arrivals"), scratch(spark, "ingested"), scratch(spark, "ingest-state")
    e = spark.read.parquet(f"{sf}/events.parquet")
    schema = ", ".join(f"{c} {t}" for c, t in e.dtypes)
    for part in (e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        streams.ingest(spark, source, schema, target, state).awaitTermination()
    return spark.read.schema(e.schema).parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum("user_id").alias("users"))


QUERIES = {f.__name__: f for f in (stream_request_counts, stream_sessions, stream_ingest)}

_SEEN = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"

ORACLE_SQL = {
    "stream_request_counts": f"SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS start, kind, n, ms FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, event_type AS kind, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS ms FROM events GROUP BY ALL) WHERE w + INTERVAL 5 MINUTE <= {_SEEN}",
    "stream_sessions": f"""WITH g AS (SELECT event_type AS kind, ts, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) > INTERVAL 10 MINUTE, true)::INT AS opens FROM events),
s AS (SELECT kind, ts, sum(opens) OVER (PARTITION BY kind ORDER BY ts) AS stretch FROM g),
w AS (SELECT kind, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY kind, stretch)
SELECT kind, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(z, '%Y-%m-%d %H:%M:%S.%f') AS "end", n FROM w WHERE z - a >= INTERVAL 10 MINUTE AND z + INTERVAL 10 MINUTE <= {_SEEN}""",
    "stream_ingest": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type",
}
