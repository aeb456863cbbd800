"""Audits of a data set, and differences between releases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.page import random_key, top_k
from tessera.sources.scratch import kept


def dead_ends(triples: DataFrame, visible: DataFrame, predicates: Sequence[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(predicate, object, sources): objects that are no visible record; with existing, only those that exist in the full set."""
    t = triples.filter(F.col("predicate").isin(list(predicates))) if predicates else triples
    # dealt once by object, which serves the joins and the counts; what is visible goes before sources are told apart
    dead = t.select("predicate", "object", "src_uri").repartition("object").join(visible.select(F.col("uri").alias("object")), "object", "left_anti")
    if existing is not None:
        dead = dead.join(existing.select(F.col("uri").alias("object")), "object", "left_semi")
    return dead.distinct().groupBy("predicate", "object").agg(F.count("src_uri").alias("sources"))


def predicate_coverage(triples: DataFrame, configured: Sequence[str], only_empty: bool = False) -> DataFrame:
    """(predicate, records): records with at least one triple of each configured predicate."""
    spark = triples.sparkSession
    names = spark.createDataFrame([(p,) for p in configured], "predicate string")
    n = triples.groupBy("predicate").agg(F.count_distinct("src_uri").alias("records"))
    out = names.join(n, "predicate", "left").select("predicate", F.coalesce("records", F.lit(0).cast("long")).alias("records"))
    return out.filter("records = 0") if only_empty else out


def difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(on, side): distinct values only on one side."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def count_difference(previous: DataFrame, latest: DataFrame, key: str = "key") -> DataFrame:
    """(key, change): latest minus previous count of each key; (key, n) frames, a missing key counts 0."""
    p, q = previous.select(key, F.col("n").alias("p")), latest.select(key, F.col("n").alias("q"))
    zero = F.lit(0).cast("long")
    return p.join(q, key, "full").select(key, (F.coalesce("q", zero) - F.coalesce("p", zero)).alias("change"))


def highly_related(triples: DataFrame, n: int, prefix: str = "") -> DataFrame:
    """(src_uri, links): the n records with most links to records with the prefix."""
    t = triples.filter(F.col("object").startswith(prefix)) if prefix else triples
    return t.groupBy("src_uri").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "src_uri").limit(n)


def _value():
    return F.coalesce("v_str", F.col("v_long").cast("string"), F.col("v_float").cast("string"))


def value_counts(fields: DataFrame, names: Sequence[str], only_empty: bool = False) -> DataFrame:
    """(field, n_values) of every named field; fields without values have 0."""
    spark = fields.sparkSession
    spec = spark.createDataFrame([(f,) for f in names], "field string")
    n = fields.groupBy("field").agg(F.count_distinct(_value()).alias("n_values"))
    out = spec.join(n, "field", "left").select("field", F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"))
    return out.filter("n_values = 0") if only_empty else out


def top_values(fields: DataFrame, names: Sequence[str], k: int = 10, most: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """(field, value, n, rank): the k most or least frequent text values of each field; labels (uri, name) resolve ids."""
    n = fields.filter(F.col("field").isin(list(names)) & F.col("v_str").isNotNull()).groupBy("field", F.col("v_str").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = top_k(n, ["field"], [F.desc("n") if most else F.asc("n"), F.asc("value")], k)
    return out.join(labels.select(F.col("uri").alias("value"), "name"), "value", "left") if labels is not None else out


def types_per_predicate(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """(predicate, data_types): the types of the records that carry each predicate, in order, joined by commas."""
    t = triples.select("predicate", F.col("src_uri").alias("uri")).join(docs.select("uri", "data_type"), "uri")
    return t.groupBy("predicate").agg(F.array_join(F.sort_array(F.collect_set("data_type")), ",").alias("data_types"))


def types_along_paths(paths: DataFrame, types: DataFrame) -> DataFrame:
    """paths with the types that carry the first and the second predicate; a path with a hop that nothing carries drops out."""
    a, b = types.toDF("first", "first_types"), types.toDF("second", "second_types")
    return paths.join(a, "first").join(b, "second")


def sample_by_collection(docs: DataFrame, combinations: dict[str, Sequence[str]], k: int, seed: int = 0) -> DataFrame:
    """(name, uri, total): k records of each combination of collections, chosen by a seeded hash, and how many there are."""
    rows = []
    for name, all_of in combinations.items():
        has = reduce(lambda a, b: a & b, [F.array_contains("collections", c) for c in all_of])
        rows.append(docs.filter(has).select(F.lit(name).alias("name"), "uri"))
    every = reduce(DataFrame.union, rows)
    totals = every.groupBy("name").agg(F.count(F.lit(1)).alias("total"))
    return top_k(every, ["name"], [random_key(seed), F.col("uri")], k).drop("rank").join(totals, "name")


def false_positives(candidates: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: candidates of an index, and how many of them an exact check rejects."""
    e = exact.select("uri").distinct().withColumn("good", F.lit(True))
    return candidates.select("uri").join(e, "uri", "left").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("good").isNull()).alias("rejected"))


def estimate_vs_actual(unfiltered: DataFrame, filtered: DataFrame, all_rows: bool = False) -> DataFrame:
    """(search_id, estimate, actual) of the searches whose counts differ."""
    a = unfiltered.groupBy("search_id").agg(F.count(F.lit(1)).alias("estimate"))
    b = filtered.groupBy("search_id").agg(F.count(F.lit(1)).alias("actual"))
    zero = F.lit(0).cast("long")
    out = a.join(b, "search_id", "full").select("search_id", F.coalesce("estimate", zero).alias("estimate"), F.coalesce("actual", zero).alias("actual"))
    return out if all_rows else out.filter("estimate <> actual")


def explain_keywords(postings: DataFrame, triples: DataFrame, uri: str, keywords: Sequence[str], predicate: str) -> DataFrame:
    """(keyword, own, linked, found): whether the record has the word, and how many of the records it links to have it."""
    spark = postings.sparkSession
    words = spark.createDataFrame([(k, k.lower()) for k in keywords], "keyword string, folded string")
    links = triples.filter((F.col("subject") == uri) & (F.col("predicate") == predicate)).select(F.col("object").alias("uri")).distinct()
    around = links.select("uri", F.lit(False).alias("self")).union(spark.createDataFrame([(uri, True)], "uri string, self boolean"))
    hits = postings.join(around, "uri").join(words.select("folded"), "folded", "left_semi").groupBy("folded").agg(F.max("self").alias("own"), F.count_distinct(F.when(~F.col("self"), F.col("uri"))).alias("linked"))
    return words.join(hits, "folded", "left").select("keyword", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("linked", F.lit(0).cast("long")).alias("linked"), F.col("own").isNotNull().alias("found"))


def reachable(triples: DataFrame, predicate: str, start: DataFrame, hops: int, visible: DataFrame | None = None) -> DataFrame:
    """(start, uri, hops, visible): what a chain of up to `hops` triples of the predicate reaches, with its shortest length.

    Each level holds only what no level before it reached, and is written; the first empty one is the last. A start is
    among its own results if a chain leads back to it.
    """
    t = triples.filter(F.col("predicate") == predicate).select(F.col("subject").alias("uri"), F.col("object").alias("next"))
    level = start.select(F.col("uri").alias("start"), "uri").distinct()
    found = level.withColumn("hops", F.lit(0)).limit(0)
    for i in range(1, hops + 1):
        further = level.join(t, "uri").select("start", F.col("next").alias("uri")).distinct()
        further = further if i == 1 else further.join(found, ["start", "uri"], "left_anti")
        level = kept(further, "reached")
        if level.isEmpty():
            break
        found = found.union(level.withColumn("hops", F.lit(i)))
    if visible is None:
        return found.withColumn("visible", F.lit(True))
    v = visible.select("uri").distinct().withColumn("seen", F.lit(True))
    return found.join(v, "uri", "left").select("start", "uri", "hops", F.coalesce("seen", F.lit(False)).alias("visible"))


def field_use(used: Sequence[str], fields: DataFrame) -> DataFrame:
    """(field, side): used but without data (left), or with data and unused (right)."""
    spark = fields.sparkSession
    return difference(spark.createDataFrame([(f,) for f in used], "field string"), fields.select("field"), "field")


def term_support(catalog: DataFrame, triples: DataFrame, fields: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """catalog (term, predicate, field) with the triples and field values that a term has, and whether it has any.

    With docs, terms that follow from the data are added: for each id field of a record type that occurs, "<type>.<field>",
    and for each predicate that leads to records of a type, its inverse, "<type>.inverse.<predicate>".
    """
    p = triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n_triples"))
    f = fields.groupBy("field").agg(F.count(F.lit(1)).alias("n_values"))
    zero = F.lit(0).cast("long")
    out = catalog.join(p, "predicate", "left").join(f, "field", "left").select("term", F.coalesce("n_triples", zero).alias("n_triples"), F.coalesce("n_values", zero).alias("n_values"))
    if docs is not None:
        types = docs.select("uri", "data_type")
        ids = fields.filter(F.col("field").endswith("Id")).groupBy("uri", "field").agg(F.count(F.lit(1)).alias("n"))
        ids = ids.join(types, "uri").groupBy(F.concat_ws(".", "data_type", "field").alias("term")).agg(F.sum("n").alias("n_values")).select("term", zero.alias("n_triples"), "n_values")
        # counted for each object first, so that a hub is one row of the join
        ends = triples.groupBy(F.col("object").alias("uri"), "predicate").agg(F.count(F.lit(1)).alias("n"))
        inverse = ends.join(types, "uri").groupBy(F.concat_ws(".", "data_type", F.lit("inverse"), "predicate").alias("term")).agg(F.sum("n").alias("n_triples")).select("term", "n_triples", zero.alias("n_values"))
        out = out.union(ids).union(inverse)
    return out.withColumn("supported", (F.col("n_triples") > 0) | (F.col("n_values") > 0))


def two_patterns(triples: DataFrame, first: str, second: str) -> DataFrame:
    """(subject, one, two): subjects that have both predicates, with the objects."""
    a = triples.filter(F.col("predicate") == first).select("subject", F.col("object").alias("one"))
    return a.join(triples.filter(F.col("predicate") == second).select("subject", F.col("object").alias("two")), "subject")


def routes_agree(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes of two matches, of what they share, and whether they are the same set."""
    a, b = left.select("uri").distinct(), right.select("uri").distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "uri", "full").agg(F.count("l").alias("left"), F.count("r").alias("right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
    return both.withColumn("agree", (F.col("left") == F.col("shared")) & (F.col("right") == F.col("shared")))


def field_sketches(fields: DataFrame, part: Column, lg_k: int = 12, items: int = 1000) -> DataFrame:
    """(field, part, n, distinct, frequent): for each part of a release, sketches of a field's values, to be stored and merged.

    distinct is a HyperLogLog sketch of 2^lg_k cells (standard error 1.04 / 2^(lg_k / 2)), frequent one of the `items` most
    frequent values: no count is off by more than n / (0.75 * items), and none at all while a field has fewer values.
    """
    value = F.coalesce("v_str", F.col("v_long").cast("string"), F.col("v_float").cast("string"))
    rows = fields.select("field", part.alias("part"), value.alias("value"))
    return rows.groupBy("field", "part").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("value", F.lit(lg_k)).alias("distinct"), F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(items)).alias("frequent"))


def merged_sketches(sketches: DataFrame, k: int = 10) -> DataFrame:
    """(field, n, distinct, top) over all parts: about how many values, and the k most frequent with about how many records."""
    merged = sketches.groupBy("field").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.call_function("approx_top_k_combine", F.col("frequent")).alias("frequent"))
    return merged.select("field", "n", "distinct", F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k)).alias("top"))
