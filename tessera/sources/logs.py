"""Log sources and report sinks. Lines that don't parse are left out of the tables, and counted where that is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.logs import request_type

_ACCESS = r'^\S+ - (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)'
#: Columns that come first in a request log, in this order; the others follow by name.
COMMON = ("time", "url", "user", "elapsedTime", "requests", "runTime")


def _lines(spark: SparkSession, paths: str | Sequence[str], by_folder: bool = False) -> DataFrame:
    """(line, node): of files from several nodes, with the name of the file, or of the folder that holds it, as node."""
    name = r"([^/]+)/[^/]+$" if by_folder else r"([^/]+)$"
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("value").alias("line"), F.regexp_extract(F.input_file_name(), name, 1).alias("node"))


def access_log(lines: DataFrame) -> DataFrame:
    """(node, ts, user, method, uri, status, bytes, kind)."""
    g = lambda i: F.regexp_extract("line", _ACCESS, i)
    rows = lines.filter(F.col("line").rlike(_ACCESS))
    out = rows.select("node", F.try_to_timestamp(g(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), g(1).alias("user"), g(3).alias("method"), g(4).alias("uri"), g(5).cast("int").alias("status"), g(6).try_cast("long").alias("bytes"))
    return out.filter("ts is not null").withColumn("kind", request_type(F.col("uri")))


def read_access_log(spark: SparkSession, paths: str | Sequence[str], by_folder: bool = False) -> DataFrame:
    return access_log(_lines(spark, paths, by_folder))


def trace_log(lines: DataFrame) -> DataFrame:
    """(ts, request_id, context, filtered, total_ms, search_ms, estimate, returned, scope, criteria) of search traces."""
    g = lambda p: F.regexp_extract("line", p, 1)
    rows = lines.filter(F.col("line").rlike(r"requestId: .*searchCriteria: \["))
    n = lambda p: g(p).try_cast("long")
    return rows.select(
        F.try_to_timestamp(g(r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:\.\d+)?)")).alias("ts"), g(r"requestId: ([^;]*);").alias("request_id"), g(r"requestContext: ([^;]*);").alias("context"),
        (g(r"filterResults: ([^;]*);") == "true").alias("filtered"), n(r"totalElapsed: (\d+)").alias("total_ms"), n(r"searchElapsed: (\d+)").alias("search_ms"), n(r"estimate: (\d+)").alias("estimate"),
        n(r"returned: (\d+)").cast("int").alias("returned"), g(r"scope: \[([^\]]*)\]").alias("scope"), g(r"searchCriteria: \[(.*)\]\s*$").alias("criteria"),
    )


def read_trace_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return trace_log(_lines(spark, paths))


def read_request_log(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(wide table, one-row count of bad lines): JSON lines with varying keys; common columns first, missing values ''."""
    raw = spark.read.json(paths if isinstance(paths, str) else list(paths), mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", primitivesAsString=True)
    bad = F.col("_bad").isNotNull() if "_bad" in raw.columns else F.lit(False)
    names = [c for c in COMMON if c in raw.columns] + sorted(c for c in raw.columns if c not in COMMON and c != "_bad")
    flat = {f.name: F.col(f.name) if f.dataType.simpleString() == "string" else F.to_json(f.name) for f in raw.schema}
    wide = raw.filter(~bad).select(*[F.coalesce(flat[c], F.lit("")).alias(c) for c in names])
    lines = _lines(spark, paths).filter(F.trim("line") != "")
    return wide, lines.agg(F.count_if(F.try_parse_json("line").isNull()).alias("bad_lines"))


def merges(lines: DataFrame) -> DataFrame:
    """(node, ts, mb, seconds, rate) of merge events."""
    p = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\S*).*Merged (\d+) MB in (\d+) sec at (\d+) MB/sec"
    g = lambda i: F.regexp_extract("line", p, i)
    return lines.filter(F.col("line").rlike(p)).select("node", F.try_to_timestamp(g(1)).alias("ts"), g(2).cast("long").alias("mb"), g(3).cast("long").alias("seconds"), g(4).cast("long").alias("rate"))


def read_merges(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return merges(_lines(spark, paths))


def read_metrics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(server, ts, value) of metric files: an array of {name, data: {entry: [{dt, value}]}}."""
    schema = "name string, data struct<entry: array<struct<dt: string, value: long>>>"
    rows = spark.read.json(paths if isinstance(paths, str) else list(paths), schema=schema, multiLine=True)
    return rows.select(F.col("name").alias("server"), F.explode("data.entry").alias("e")).select("server", F.col("e.dt").try_cast("timestamp").alias("ts"), "e.value")


def write_report(df: DataFrame, path: str, kind: str = "tsv") -> None:
    w = df.write
    w.json(path) if kind == "json" else w.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
