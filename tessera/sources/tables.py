"""The driver tables seen as records, triples, fields and vectors.

Every function reads only the tables and columns that the asked predicates, fields or types need, so that a query scans
what it uses. On a real corpus the same frames come from sources.records, as Parquet partitioned by predicate or field.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE_TYPES = {
    "agent": ["Person", "Group"],
    "concept": ["Type"],
    "event": ["Activity"],
    "item": ["HumanMadeObject"],
    "place": ["Place"],
    "work": ["LinguisticObject"],
    "reference": ["Group", "Person", "Place", "Activity", "Type"],
}
#: User-interface order of scopes.
SCOPE_ORDER = ["item", "work", "set", "agent", "place", "concept", "event"]


def uri(kind: str, *keys: str) -> Column:
    return F.concat(F.lit(kind + "/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str, *tables: str) -> DataFrame:
    """(uri, data_type, name) of the records that the tables stand for; rows of lineitem that share all keys are one record."""
    parts = {
        "region": ("Place", lambda: uri("region", "r_regionkey"), "r_name"),
        "nation": ("Place", lambda: uri("nation", "n_nationkey"), "n_name"),
        "customer": ("Person", lambda: uri("customer", "c_custkey"), "c_name"),
        "supplier": ("Group", lambda: uri("supplier", "s_suppkey"), "s_name"),
        "part": ("Type", lambda: uri("part", "p_partkey"), "p_name"),
        "orders": ("LinguisticObject", lambda: uri("order", "o_orderkey"), None),
        "lineitem": ("HumanMadeObject", lambda: uri("item", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), None),
        "events": ("Activity", lambda: uri("event", "event_id"), None),
    }
    chosen = tables or tuple(parts)
    frames = [
        _table(spark, sf, t).select(parts[t][1]().alias("uri"), F.lit(parts[t][0]).alias("data_type"), (F.col(parts[t][2]) if parts[t][2] else F.lit(None).cast("string")).alias("name"))
        for t in chosen
    ]
    return reduce(DataFrame.unionByName, [f.distinct() if t == "lineitem" else f for t, f in zip(chosen, frames, strict=True)])


_TRIPLES: dict[str, list[tuple[str, Callable, Callable]]] = {
    "P89_falls_within": [("nation", lambda: uri("nation", "n_nationkey"), lambda: uri("region", "n_regionkey"))],
    "placeOfActivity": [
        ("customer", lambda: uri("customer", "c_custkey"), lambda: uri("nation", "c_nationkey")),
        ("supplier", lambda: uri("supplier", "s_suppkey"), lambda: uri("nation", "s_nationkey")),
    ],
    "agentOfCreation": [("orders", lambda: uri("order", "o_orderkey"), lambda: uri("customer", "o_custkey"))],
    "carries_or_shows": [("lineitem", lambda: uri("item", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lambda: uri("order", "l_orderkey"))],
    "itemClassifiedAs": [("lineitem", lambda: uri("item", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lambda: uri("part", "l_partkey"))],
    "agentOfProduction": [("lineitem", lambda: uri("item", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lambda: uri("supplier", "l_suppkey"))],
    "eventCarriedOutBy": [("events", lambda: uri("event", "event_id"), lambda: uri("customer", "user_id"))],
}


def triples(spark: SparkSession, sf: str, *predicates: str) -> DataFrame:
    """(subject, predicate, object, src_uri) of the predicates asked for, all by default."""
    frames = [
        _table(spark, sf, t).select(s().alias("subject"), F.lit(p).alias("predicate"), o().alias("object"), s().alias("src_uri"))
        for p in predicates or tuple(_TRIPLES)
        for t, s, o in _TRIPLES[p]
    ]
    return reduce(DataFrame.unionByName, frames)


def _field(name: str, u: Column, s: Column | None = None, n: Column | None = None, f: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [
        u.alias("uri"), F.lit(name).alias("field"), (s if s is not None else none).cast("string").alias("v_str"),
        (n if n is not None else none).cast("long").alias("v_long"), (f if f is not None else none).cast("double").alias("v_float"),
    ]


def fields(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """(uri, field, v_str, v_long, v_float) of the fields asked for, all by default."""
    order, item = (lambda: uri("order", "o_orderkey")), (lambda: uri("item", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    doc = lambda: uri("document", "doc_id")
    made = {
        "workCreationStartDateLong": [("orders", order, None, lambda: seconds("o_orderdate"), None)],
        "workCreationEndDateLong": [("orders", order, None, lambda: seconds("o_orderdate") + 86399, None)],
        "itemProductionStartDateLong": [("lineitem", item, None, lambda: seconds("l_shipdate"), None)],
        "itemDimensionValue": [("lineitem", item, None, None, lambda: F.col("l_quantity"))],
        "workTypeId": [("orders", order, lambda: F.col("o_orderpriority"), None, None)],
        "workStatusId": [("orders", order, lambda: F.col("o_orderstatus"), None, None)],
        "conceptPrimaryName": [("part", lambda: uri("part", "p_partkey"), lambda: F.col("p_name"), None, None)],
        "conceptTypeId": [("part", lambda: uri("part", "p_partkey"), lambda: F.col("p_type"), None, None)],
        "agentPrimaryName": [
            ("customer", lambda: uri("customer", "c_custkey"), lambda: F.col("c_name"), None, None),
            ("supplier", lambda: uri("supplier", "s_suppkey"), lambda: F.col("s_name"), None, None),
        ],
        "agentActivePlaceId": [
            ("customer", lambda: uri("customer", "c_custkey"), lambda: uri("nation", "c_nationkey"), None, None),
            ("supplier", lambda: uri("supplier", "s_suppkey"), lambda: uri("nation", "s_nationkey"), None, None),
        ],
        "placePrimaryName": [
            ("region", lambda: uri("region", "r_regionkey"), lambda: F.col("r_name"), None, None),
            ("nation", lambda: uri("nation", "n_nationkey"), lambda: F.col("n_name"), None, None),
        ],
        "workLanguageId": [("documents", doc, lambda: F.col("lang"), None, None)],
        "workSource": [("documents", doc, lambda: F.col("source"), None, None)],
        "workAnyText": [("documents", doc, lambda: F.col("text"), None, None)],
        "workQualityBoolean": [("labels", doc, None, lambda: F.col("quality"), None)],
        "workToxicBoolean": [("labels", doc, None, lambda: F.col("toxic"), None)],
        "workIdentifier": [("pages", lambda: uri("page", "page_id"), lambda: F.col("url"), None, None)],
    }
    call = lambda f: f() if f is not None else None
    frames = [
        _table(spark, sf, t).select(*_field(n, u(), call(s), call(i), call(f)))
        for n in names or tuple(made)
        for t, u, s, i, f in made[n]
    ]
    out = reduce(DataFrame.unionByName, frames)
    return out.filter("v_str is not null or v_long is not null or v_float is not null")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(uri("vector", "vec_id").alias("uri"), F.col("label").cast("string").alias("data_type"), F.col("embedding").alias("main"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a request log: (request_id, kind, ts, ms, params)."""
    return _table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ms"), F.col("props").alias("params"), F.col("user_id"))
