"""Analytics of request logs and metric series. Logs are DataFrames as sources.logs reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What endpoints requests are counted as.
REQUEST_TYPES = {
    "Search": r"/ds/[^/]+/search\.mjs(\?|$)",
    "Facet": r"/ds/[^/]+/facets\.mjs(\?|$)",
    "Related List": r"/ds/[^/]+/relatedlist\.mjs(\?|$)",
    "Search Will Match": r"/ds/[^/]+/searchwillmatch\.mjs(\?|$)",
    "Search Estimate": r"/ds/[^/]+/searchestimate\.mjs(\?|$)",
    "Document": r"/ds/[^/]+/document/read\.mjs(\?|$)",
    "Translate": r"/ds/[^/]+/translate\.mjs(\?|$)",
}
#: Upper bounds in ms and names of duration buckets; the last is open.
BUCKETS = [
    (10, "0ms-9ms"), (100, "10ms-99ms"), (1000, "100ms-999ms"), (2000, "1s-2s"), (3000, "2s-3s"), (4000, "3s-4s"), (5000, "4s-5s"), (6000, "5s-6s"), (7000, "6s-7s"),
    (8000, "7s-8s"), (9000, "8s-9s"), (10000, "9s-10s"), (15000, "10s-15s"), (20000, "15s-20s"), (25000, "20s-25s"), (30000, "25s-30s"), (None, ">30s"),
]
PROFILES = ("location", "name", "relationship", "results")


def request_type(uri: Column) -> Column:
    kind, lowered = F.lit("Other"), F.lower(uri)
    for name, pattern in reversed(REQUEST_TYPES.items()):
        kind = F.when(lowered.rlike(pattern), name).otherwise(kind)
    return kind


def _in(log: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    if start is not None:
        log = log.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    return log.filter(F.col(ts) < F.lit(end).cast("timestamp")) if end is not None else log


def requests_by(log: DataFrame, *by: str, start=None, end=None) -> DataFrame:
    """Requests and bytes by type, node, status or any of them together, within [start, end). log: access log with kind."""
    return _in(log, start, end).groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))


def facets_per_search(log: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return log.groupBy("node").agg((n("Facet") / F.when(n("Search") > 0, n("Search"))).alias("facets_per_search"))


def duration_bucket(ms: Column) -> Column:
    out = None
    for most, name in BUCKETS:
        if most is None:
            return out.otherwise(name)
        out = F.when(ms < most, name) if out is None else out.when(ms < most, name)
    return out


def duration_histogram(log: DataFrame, seconds: float) -> DataFrame:
    """(kind, bucket, n, subtotal, per_second): all buckets of each kind, empty ones too; per_second over `seconds`."""
    spark = log.sparkSession
    buckets = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(BUCKETS)], "place int, bucket string")
    n = log.groupBy("kind", duration_bucket(F.col("ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    all_ = n.select("kind").distinct().crossJoin(F.broadcast(buckets))  # as many rows as there are buckets
    out = all_.join(n, ["kind", "bucket"], "left").select("kind", "place", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    out = out.withColumn("subtotal", F.sum("n").over(Window.partitionBy("kind")))
    return out.withColumn("per_second", F.round(F.col("subtotal") / seconds, 6))


def whole_seconds(log: DataFrame) -> DataFrame:
    """(kind, seconds, n): requests by whole seconds of duration, 100 and more together."""
    return log.groupBy("kind", F.least(F.floor(F.col("ms") / 1000), F.lit(100)).cast("int").alias("seconds")).agg(F.count(F.lit(1)).alias("n"))


def wide_durations(log: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row a request, its duration in the column of its kind."""
    return log.select("request_id", *[F.when(F.col("kind") == k, F.col("ms")).alias(k) for k in kinds])


def slow_or_failed(log: DataFrame, least_ms: float = 20_000, failed: Column | None = None) -> DataFrame:
    slow = F.col("ms") >= least_ms
    return log.filter(slow | failed) if failed is not None else log.filter(slow)


def profile_counts(log: DataFrame, profile: str = "profile") -> DataFrame:
    p = F.col(profile)
    return log.groupBy(F.when(p.isNull(), "none").when(p.isin(*PROFILES), p).otherwise("other").alias("profile")).agg(F.count(F.lit(1)).alias("n"))


def related_checks(lines: DataFrame) -> DataFrame:
    """(name, scope, uri, has, ms) of lines that report a related-list check; others drop out."""
    g = lambda p: F.regexp_extract("line", p, 1)
    rows = lines.filter(F.col("line").rlike(r"relatedListName: "))
    return rows.select(
        g(r"relatedListName: ([^;]*)").alias("name"), g(r"scope: ([^;]*)").alias("scope"), g(r"uri: ([^;]*)").alias("uri"), (g(r"has: ([^;]*)") == "true").alias("has"), g(r"milliseconds: (\d+)").try_cast("long").alias("ms")
    )


def regex_counts(lines: DataFrame, pattern: str, column: str = "line", group: int = 0) -> DataFrame:
    """(match, n): unique matches of a pattern, or of one of its groups."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(group))).alias("match"))
    return found.groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def activity_ranges(log: DataFrame, by: str, gap_seconds: int = 60, least_seconds: int = 180) -> DataFrame:
    """(by, start, end, n): stretches without a gap longer than gap_seconds, of least_seconds or more."""
    def numbered(rows: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(begin, end)
        gap = F.coalesce((F.unix_micros(begin) - F.unix_micros(F.lag(end).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
        return rows.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(w))

    # stretches of each hour first, so that a busy kind is sorted by many tasks; then only these are joined
    hours = log.select(by, F.floor(F.unix_seconds("ts") / 3600).alias("hour"), "ts")
    parts = numbered(hours, [by, "hour"], "ts", "ts").groupBy(by, "hour", "stretch").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    out = numbered(parts.drop("hour", "stretch"), [by], "start", "end").groupBy(by, "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return out.filter(F.unix_micros("end") - F.unix_micros("start") >= least_seconds * 1_000_000).drop("stretch")


def in_ranges(log: DataFrame, ranges: DataFrame, width_seconds: int = 3600) -> DataFrame:
    """Rows of log within any of the ranges (start, end), each once: an equi-join on time buckets that a range overlaps."""
    bucket = lambda c: F.floor(F.unix_seconds(c) / width_seconds)
    r = ranges.select("start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"))
    l = log.withColumn("bucket", bucket(F.col("ts")))
    return l.join(r, (l["bucket"] == r["bucket"]) & (l["ts"] >= r["start"]) & (l["ts"] <= r["end"]), "left_semi").drop("bucket")


def queue_summary(metrics: DataFrame) -> DataFrame:
    """(server, top, times_at_top, above_zero, points, total) of a series (server, ts, value)."""
    n = metrics.groupBy("server", "value").agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy("server").agg(
        F.max("value").alias("top"), F.max_by("c", "value").alias("times_at_top"), F.coalesce(F.sum(F.when(F.col("value") > 0, F.col("c"))), F.lit(0)).cast("long").alias("above_zero"),
        F.sum("c").alias("points"), F.sum(F.col("value") * F.col("c")).alias("total"),
    )


def odd_related_lists(checks: DataFrame, slow_ms: int = 10_000) -> DataFrame:
    """(name, checks, found, unknown, slow) of related-list checks: unknown ones report no duration, slow ones hit the cap."""
    return checks.groupBy("name").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("has").alias("found"), F.count_if(F.col("ms").isNull()).alias("unknown"), F.count_if(F.col("ms") >= slow_ms).alias("slow")
    )


def restarts(lines: DataFrame, column: str = "line", pattern: str = r"\bStarting\b") -> DataFrame:
    """(node, restarts) of server logs (node, line)."""
    return lines.groupBy("node").agg(F.count_if(F.col(column).rlike(pattern)).alias("restarts"))


def severe(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.filter(~F.col(column).rlike(r"\b(Debug|Info):"))


def merge_rate(merges: DataFrame) -> DataFrame:
    """(minute, mb, seconds, mb_per_second) of merge events (node, ts, mb, seconds, rate)."""
    return merges.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("mb").alias("mb"), F.sum("seconds").alias("seconds"), F.avg("rate").alias("mb_per_second"))


def mined_searches(trace: DataFrame) -> DataFrame:
    """Distinct (scope, criteria) of a search trace, for replay."""
    return trace.select("scope", "criteria").distinct()


def meter_slice(meters: DataFrame, start, end, path: str | None = None, per_file: int = 3000) -> DataFrame:
    """Meters that begin after start and end before end; written to path in files of per_file rows if one is given."""
    out = meters.filter((F.col("start_time") > F.lit(start).cast("timestamp")) & (F.col("end_time") < F.lit(end).cast("timestamp")))
    if path is not None:
        out.write.option("maxRecordsPerFile", per_file).parquet(path)
    return out
