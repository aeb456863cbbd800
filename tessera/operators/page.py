"""Pages of results, counts and orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE, PAGE_WITH_WINDOW = 100, 100_000


def order_by_field(match: DataFrame, fields: DataFrame, names: Sequence[str], ascending: bool = True, column: str = "v_str", key: str = "key") -> DataFrame:
    """match with a sort key: the smallest value of the fields if ascending, else the largest; null if there is none."""
    values = fields.filter(F.col("field").isin(list(names))).join(match, "uri", "left_semi")
    one = values.groupBy("uri").agg((F.min if ascending else F.max)(column).alias(key))
    return match.join(one, "uri", "left")


def order_by_hop(match: DataFrame, triples: DataFrame, predicate: str, names: DataFrame, ascending: bool = True, key: str = "key") -> DataFrame:
    """match with the name of a linked record as sort key: of several, the first if ascending, else the last. names: (uri, name)."""
    t = triples.filter(F.col("predicate") == predicate).join(match.select(F.col("uri").alias("subject")), "subject", "left_semi")
    linked = t.join(names.select(F.col("uri").alias("object"), "name"), "object", "left")
    one = linked.groupBy(F.col("subject").alias("uri")).agg((F.min if ascending else F.max)("name").alias(key))
    return match.join(one, "uri", "left")


def random_key(seed: int = 0) -> Column:
    """A repeatable random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("uri")))


def _order(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    return [*(F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in keys), F.col("uri")]


def search_page(match: DataFrame, docs: DataFrame, keys: Sequence[tuple[str, bool]] = (("score", False),), page: int = 1, length: int = 20, most: int = MAX_PAGE) -> DataFrame:
    """(uri, data_type, keys...) of one page. The order is total: ties go by uri, records without a key come last."""
    if page < 1 or not 1 <= length <= most:
        raise ValueError(f"a page has 1 to {most} rows and counts from 1")
    rows = match.orderBy(*_order(keys)).offset((page - 1) * length).limit(length)
    return rows.join(docs.select("uri", "data_type"), "uri", "left").select("uri", "data_type", *[k for k, _ in keys]).orderBy(*_order(keys))


def page_summary(match: DataFrame, page: int = 1, length: int = 20) -> DataFrame:
    """One row: total, has_prev, has_next."""
    return match.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(page > 1).alias("has_prev"), (F.col("total") > page * length).alias("has_next"))


def total_from_page(page: int, length: int, got: int) -> int | None:
    """The exact total if the page isn't full, without counting; None if it is, or if the page is empty and not the first."""
    return (page - 1) * length + got if 0 < got < length or (page == 1 and got < length) else None


def page_with(match: DataFrame, uri: str, keys: Sequence[tuple[str, bool]] = (("score", False),), length: int = 20, within: int | None = PAGE_WITH_WINDOW) -> DataFrame:
    """(uri, place, page) of the record, if it is among the first `within` results (None: among all of them).

    The place is one more than the number of results before it: a comparison with one row and a count, without sorting.
    """
    it = match.filter(F.col("uri") == uri).select(F.struct(*[F.col(k) for k, _ in keys], "uri").alias("it"))
    before, same = F.lit(False), F.lit(True)
    for k, up in [*keys, ("uri", True)]:
        a, b = F.col(k), F.col(f"it.{k}")
        first = (a < b) if up else (a > b)
        before |= same & F.coalesce(first, a.isNotNull() & b.isNull())
        same &= a.eqNullSafe(b)
    placed = match.crossJoin(F.broadcast(it)).groupBy(F.col("it.uri").alias("uri")).agg((F.count_if(before) + 1).alias("place"))  # it: at most one row
    near = placed if within is None else placed.filter(F.col("place") <= within)
    return near.select("uri", "place", F.ceil(F.col("place") / length).cast("long").alias("page"))


def estimate(match: DataFrame, exact: bool = True) -> DataFrame:
    return match.agg((F.count(F.lit(1)) if exact else F.approx_count_distinct("uri")).alias("estimate"))


def scope_counts(match: DataFrame, docs: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """(scope, n): matches of each scope; a type that is in several scopes counts in each."""
    spark = match.sparkSession
    types = spark.createDataFrame([(s, t) for s, ts in scopes.items() for t in ts], "scope string, data_type string")
    found = match.select("uri").join(docs.select("uri", "data_type"), "uri").groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))
    return types.join(found, "data_type", "left").groupBy("scope").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def first_nonempty_scope(counts: DataFrame, asked: str, order: Sequence[str]) -> DataFrame:
    """The scope asked for if it has matches, else the first in order that has."""
    place = F.array_position(F.array(*[F.lit(s) for s in [asked, *[o for o in order if o != asked]]]), F.col("scope"))
    return counts.filter("n > 0").filter(place > 0).orderBy(place).limit(1)


def will_match(searches: dict[str, DataFrame]) -> DataFrame:
    """(name, matches): 1 if the search has any result, else 0."""
    spark = next(iter(searches.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in searches], "name string")
    any_ = reduce(DataFrame.union, [m.limit(1).select(F.lit(n).alias("hit")) for n, m in searches.items()])
    return names.join(any_, names["name"] == any_["hit"], "left").select("name", F.col("hit").isNotNull().cast("int").alias("matches"))


def scope_stats(docs: DataFrame, scopes: dict[str, list[str]], user_made: Column | None = None) -> DataFrame:
    """(scope, n): records of each scope, user-made ones left out."""
    kept = docs.filter(~user_made) if user_made is not None else docs
    return scope_counts(kept, kept, scopes)


def tagged_count(docs: DataFrame, *collections: str) -> DataFrame:
    has = reduce(lambda a, b: a & b, [F.array_contains("collections", c) for c in collections])
    return docs.filter(has).agg(F.count(F.lit(1)).alias("n"))


def verified(candidates: DataFrame, exact: DataFrame) -> DataFrame:
    """Candidates of an index that an exact predicate confirms."""
    return candidates.join(exact, "uri", "left_semi")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
