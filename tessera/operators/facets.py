"""Facets: frequencies of field values among matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import from_seconds
from tessera.operators.match import and_, compare
from tessera.operators.page import top_k

MAX_PAGE = 10_000


def facet(match: DataFrame, fields: DataFrame, names: str | Sequence[str], order: str = "frequency", column: str = "v_str", page: int | None = None, length: int = MAX_PAGE) -> DataFrame:
    """(value, n): in how many matching records a value of the field stands; of several fields, their union.

    order: frequency (then value), ascending or descending value. Without a page, all values in no order.
    """
    names = [names] if isinstance(names, str) else list(names)
    one = fields.filter(F.col("field").isin(names) & F.col(column).isNotNull()).join(match, "uri", "left_semi").select("uri", F.col(column).alias("value"))
    out = one.distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if page is None:
        return out
    by = {"frequency": [F.desc("n"), F.asc("value")], "ascending": [F.asc("value")], "descending": [F.desc("value")]}[order]
    return out.orderBy(*by).offset((page - 1) * length).limit(length)


def date_facet(match: DataFrame, fields: DataFrame, name: str) -> DataFrame:
    """A facet of seconds, as dateTime text or bare years."""
    f = facet(match, fields, name, column="v_long")
    return f.select(from_seconds(F.col("value")).alias("value"), "n")


def all_facets(match: DataFrame, fields: DataFrame, names: Sequence[str], k: int = 20) -> DataFrame:
    """(field, value, n, rank): the k most frequent values of each field, in one pass over the fields."""
    mine = fields.filter(F.col("field").isin(list(names)))
    value = F.coalesce("v_str", F.col("v_long").cast("string"), F.col("v_float").cast("string"))
    n = mine.join(match, "uri", "left_semi").select("field", "uri", value.alias("value")).distinct().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["field"], [F.desc("n"), F.asc("value")], k)


def candidate_facet(match: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """(value, n) over pairs (uri, value): how many matching records go with each candidate; zero counts don't appear."""
    n = pairs.join(match, "uri", "left_semi").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "value").limit(limit) if limit else n


def member_pairs(triples: DataFrame, candidates: DataFrame, member_of: str) -> DataFrame:
    """(uri, value): members of candidate sets."""
    t = triples.filter(F.col("predicate") == member_of)
    return t.join(candidates, t["object"] == candidates["uri"], "left_semi").select(F.col("subject").alias("uri"), F.col("object").alias("value"))


def unit_pairs(triples: DataFrame, sets: DataFrame, departments: DataFrame, member_of: str, curated_by: str, part_of: str) -> DataFrame:
    """(uri, value): records and the units responsible for them, by the sets they are members of.

    A set's unit is the group that curates it if that is no department, and the groups a curating department is part of.
    """
    curated = triples.filter(F.col("predicate") == curated_by).join(sets.select(F.col("uri").alias("subject")), "subject", "left_semi").select(F.col("subject").alias("set"), F.col("object").alias("group"))
    dep = departments.select(F.col("uri").alias("group"))
    direct = curated.join(dep, "group", "left_anti").select("set", F.col("group").alias("value"))
    up = triples.filter(F.col("predicate") == part_of).select(F.col("subject").alias("group"), F.col("object").alias("value"))
    above = curated.join(dep, "group", "left_semi").join(up, "group").select("set", "value")
    units = direct.union(above).distinct()
    members = triples.filter(F.col("predicate") == member_of).select(F.col("subject").alias("uri"), F.col("object").alias("set"))
    return members.join(units, "set").select("uri", "value").union(units.select(F.col("set").alias("uri"), "value")).distinct()


def narrow(match: DataFrame, fields: DataFrame, names: str | Sequence[str], value, kind: str = "value") -> DataFrame:
    """match ANDed with a facet's value: equality in any of the fields; kind date: within the day of these seconds."""
    names = [names] if isinstance(names, str) else list(names)
    mine = fields.filter(F.col("field").isin(names))
    if kind == "date":
        hit = compare(F.col("v_long"), ">=", F.lit(value)) & compare(F.col("v_long"), "<=", F.lit(value + 86399))
    else:
        hit = F.col("v_str") == value if isinstance(value, str) else F.coalesce(F.col("v_float"), F.col("v_long").cast("double")) == float(value)
    return and_(match, mine.filter(hit).select("uri").distinct().withColumn("score", F.lit(0.0)))
