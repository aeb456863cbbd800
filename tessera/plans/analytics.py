"""Registered queries: facets, related records, similarity, completion, audits, logs and record batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import facets as C
from tessera.operators import logs as L
from tessera.operators import match as M
from tessera.operators import records as D
from tessera.operators import related as R
from tessera.operators import similar as V
from tessera.operators.complete import complete_names
from tessera.plans.search import ITEM_SQL
from tessera.sources import tables as S
from tessera.sources.scratch import kept


def _late_works(spark, sf):
    return M.field_range(S.fields(spark, sf, "workCreationStartDateLong"), "workCreationStartDateLong", ">=", 978307200)


def facet_value(spark, sf):
    return C.facet(_late_works(spark, sf), S.fields(spark, sf, "workTypeId"), "workTypeId", page=1)


def facet_union(spark, sf):
    return C.facet(_late_works(spark, sf), S.fields(spark, sf, "workTypeId", "workStatusId"), ["workTypeId", "workStatusId"])


def facet_date(spark, sf):
    return C.date_facet(_late_works(spark, sf), S.fields(spark, sf, "workCreationStartDateLong"), "workCreationStartDateLong")


def facet_all(spark, sf):
    return C.all_facets(_late_works(spark, sf), S.fields(spark, sf, "workTypeId", "workStatusId", "workCreationStartDateLong"), ["workTypeId", "workStatusId", "workCreationStartDateLong"], 5)


def facet_candidates(spark, sf):
    """Regions as candidates, counting agents active in a place of theirs."""
    t = S.triples(spark, sf, "placeOfActivity", "P89_falls_within")
    pairs = C.member_pairs(t, S.docs(spark, sf, "nation"), "placeOfActivity").withColumnRenamed("value", "n")
    up = t.filter("predicate = 'P89_falls_within'").select(F.col("subject").alias("n"), F.col("object").alias("value"))
    return C.candidate_facet(S.docs(spark, sf, "customer", "supplier").select("uri"), pairs.join(up, "n").select("uri", "value"))


def facet_candidates_two_level(spark, sf):
    """Units responsible for items by their works: the customers who made them, or where these are 'departments' their places."""
    t = S.triples(spark, sf, "carries_or_shows", "agentOfCreation", "placeOfActivity")
    departments = M.hop_forward(S.triples(spark, sf, "placeOfActivity"), ["placeOfActivity"], M.iri(spark, ["nation/1", "nation/2"]))
    pairs = C.unit_pairs(t, S.docs(spark, sf, "orders"), departments, "carries_or_shows", "agentOfCreation", "placeOfActivity")
    return C.candidate_facet(S.docs(spark, sf, "lineitem").select("uri"), pairs)


def facet_narrow(spark, sf):
    return C.narrow(_late_works(spark, sf), S.fields(spark, sf, "workTypeId"), "workTypeId", "3-MEDIUM")


_PATHS = [
    ("maker-of-same", "agentOfProduction", False, "itemClassifiedAs", True),
    ("work-item", "agentOfCreation", False, "carries_or_shows", False),
]


def related_list(spark, sf):
    t = S.triples(spark, sf, "agentOfProduction", "itemClassifiedAs")
    return R.related(t, _PATHS[:1], M.iri(spark, ["supplier/1"])).select("uri", "key", "n", "total")


def related_all_pairs(spark, sf):
    """Concepts related to every supplier by what they produced, and items to every customer by works."""
    t = S.triples(spark, sf, "agentOfProduction", "itemClassifiedAs", "agentOfCreation", "carries_or_shows")
    return R.related(t, _PATHS, S.docs(spark, sf, "supplier", "customer").select("uri"))


def related_cap(spark, sf):
    t = S.triples(spark, sf, "agentOfProduction", "itemClassifiedAs")
    return R.related(t, _PATHS[:1], S.docs(spark, sf, "supplier").select("uri"), cap=3).select("start", "uri", "n", "total")


def related_any(spark, sf):
    t = S.triples(spark, sf, "agentOfCreation", "carries_or_shows")
    return R.has_related(t, _PATHS[1:], S.docs(spark, sf, "customer").select("uri"))


def _edges(spark, sf):
    t = S.triples(spark, sf, "P89_falls_within", "placeOfActivity", "agentOfCreation", "itemClassifiedAs")
    return R.schema_edges(t, S.docs(spark, sf, "region", "nation", "customer", "supplier", "part", "orders", "lineitem"))


def schema_edges(spark, sf):
    return _edges(spark, sf)


def related_paths(spark, sf):
    p = R.relation_paths(_edges(spark, sf), ["Person", "Group"], ["LinguisticObject", "Place"], ["Place", "Person", "Group"])
    return R.path_labels(p).select("key", "label")


def related_statistics(spark, sf):
    return R.path_statistics(R.relation_paths(_edges(spark, sf), ["Person", "Group", "Place"], ["LinguisticObject", "Place", "Person"], ["Place", "Person", "Type"]))


def release_sketches(spark, sf):
    """Sketches of order fields, stored for works before and after 1998 and merged: whether they are as near the exact counts as they must be."""
    f = S.fields(spark, sf, "workTypeId", "workStatusId", "workCreationStartDateLong")
    early = S.fields(spark, sf, "workCreationStartDateLong").filter("v_long < 883612800").select("uri", F.lit("early").alias("half")).distinct()
    halves = f.join(early, "uri", "left")
    stored = kept(A.field_sketches(halves, F.coalesce("half", F.lit("late"))), "sketches")
    merged = A.merged_sketches(stored, 3)
    exact = f.groupBy("field").agg(F.count_distinct(F.coalesce("v_str", F.col("v_long").cast("string"))).alias("exact"))
    top = F.transform("top", lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count")))
    counts = f.filter("v_str is not null").groupBy("field", F.col("v_str").alias("item")).agg(F.count(F.lit(1)).alias("real"))
    near = merged.select("field", F.explode(top).alias("t")).select("field", "t.*").join(counts, ["field", "item"]).groupBy("field").agg(F.bool_and(F.col("count") == F.col("real")).alias("top_exact"))
    within = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return merged.join(exact, "field").join(near, "field", "left").select("field", "n", "exact", within.alias("within_bound"), F.coalesce("top_exact", F.lit(True)).alias("top_exact"))


def similar_topwords(spark, sf):
    return V.top_words(S.fields(spark, sf, "workAnyText"), ["workAnyText"])


def similar_weighted(spark, sf):
    spec = {"name": (["conceptPrimaryName"], 2.0, False), "type": (["conceptTypeId"], 1.0, True)}
    v = V.aspect_values(S.fields(spark, sf, "conceptPrimaryName", "conceptTypeId"), spec, S.docs(spark, sf, "part"))
    seeds = S.docs(spark, sf, "part").filter(F.substring_index("uri", "/", -1).try_cast("long") % 100 == 0)
    return V.similar(v, seeds, 5)


def similar_dates(spark, sf):
    """Concepts with spans of 1 to 491 years, by their numbers and sizes; every hundredth is a seed."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    year = lambda y: F.unix_seconds(F.make_timestamp(y.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    begun = F.lit(1500) + F.pmod("p_partkey", F.lit(400))
    f = [p.select(S.uri("part", "p_partkey").alias("uri"), F.lit(n).alias("field"), year(y).alias("v_long")) for n, y in (("conceptStartDateLong", begun), ("conceptEndDateLong", begun + F.col("p_size") * 10 - 9))]
    seeds = S.docs(spark, sf, "part").filter(F.substring_index("uri", "/", -1).try_cast("long") % 100 == 0)
    return V.similar_dates(f[0].union(f[1]), "conceptStartDateLong", "conceptEndDateLong", seeds)


def vector_topk(spark, sf):
    v = S.vectors(spark, sf)
    return V.nearest_vectors(v, v.filter(F.substring_index("uri", "/", -1).try_cast("long") % 100 == 0), 5).select("query", "uri", F.round("cosine", 6).alias("cosine"), "rank")


def name_completion(spark, sf):
    return complete_names(S.fields(spark, sf, "agentPrimaryName"), "agentPrimaryName", "Customer#00000001")


def name_completion_context(spark, sf):
    f = S.fields(spark, sf, "placePrimaryName", "agentActivePlaceId")
    return complete_names(f, "placePrimaryName", "nation", "agentActivePlaceId")


def dead_end_triples(spark, sf):
    t = S.triples(spark, sf, "carries_or_shows", "itemClassifiedAs")
    seen = S.docs(spark, sf, "orders", "part").filter(~F.col("uri").endswith("7"))
    return A.dead_ends(t, seen)


def predicate_coverage(spark, sf):
    return A.predicate_coverage(S.triples(spark, sf), ["agentOfCreation", "agentOfProduction", "placeOfActivity", "member_of"])


def predicate_diff(spark, sf):
    known = spark.createDataFrame([(p,) for p in ("agentOfCreation", "agentOfProduction", "member_of")], "predicate string")
    return A.difference(known, S.triples(spark, sf), "predicate")


def release_diff(spark, sf):
    """Works by type and quarter before and after a date, as two releases."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("key"), "o_orderdate", "o_orderkey")
    count = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return A.count_difference(count(o.filter("o_orderdate < '1998-01-01'")), count(o.filter("o_orderdate >= '1998-01-01'")))


def highly_related(spark, sf):
    t = S.triples(spark, sf, "carries_or_shows").select(F.col("object").alias("src_uri"), F.col("subject").alias("object"))
    return A.highly_related(t, 15, "item/")


def field_value_counts(spark, sf):
    names = ["workTypeId", "workStatusId", "conceptPrimaryName", "itemDimensionValue"]
    return A.value_counts(S.fields(spark, sf, *names), [*names, "setPrimaryName"])


def top_values(spark, sf):
    places = S.fields(spark, sf, "placePrimaryName").select("uri", F.col("v_str").alias("name"))
    return A.top_values(S.fields(spark, sf, "agentActivePlaceId", "workTypeId"), ["agentActivePlaceId", "workTypeId"], 4, labels=places)


def record_types_per_predicate(spark, sf):
    return A.types_per_predicate(S.triples(spark, sf, "placeOfActivity", "agentOfCreation", "P89_falls_within"), S.docs(spark, sf, "nation", "customer", "supplier", "orders"))


def record_types_along_paths(spark, sf):
    t = S.triples(spark, sf, "placeOfActivity", "agentOfCreation", "P89_falls_within")
    types = A.types_per_predicate(t, S.docs(spark, sf, "nation", "customer", "supplier", "orders"))
    p = R.relation_paths(_edges(spark, sf), ["LinguisticObject"], ["Person"], ["Place"]).select("key", "first", "second")
    return A.types_along_paths(p, types)


def sample_by_collection(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(S.uri("document", "doc_id").alias("uri"), F.array("lang", "source").alias("collections"))
    return A.sample_by_collection(d, {"english": ["en"], "english of src0": ["en", "src0"], "french of src1": ["fr", "src1"]}, 5)


def _loose(spark, sf):
    p = M.build_postings(S.fields(spark, sf, "workAnyText"))
    return M.field_word(p, ["workAnyText"], "license"), M.field_word(p, ["workAnyText"], "License", M.MatchOptions(exact=True))


def false_positives(spark, sf):
    return A.false_positives(*_loose(spark, sf))


def estimate_vs_actual(spark, sf):
    """For every order status: works of the index against works of it that have an item."""
    o = S.fields(spark, sf, "workStatusId").select(F.col("v_str").alias("search_id"), "uri")
    used = S.triples(spark, sf, "carries_or_shows").select(F.col("object").alias("uri"))
    return A.estimate_vs_actual(o, o.join(used, "uri", "left_semi"))


def keyword_explain(spark, sf):
    """Words of the names that one item's concepts have, and two others."""
    first = S.triples(spark, sf, "itemClassifiedAs").agg(F.min("subject")).first()[0]
    p = M.build_postings(S.fields(spark, sf, "conceptPrimaryName"))
    return A.explain_keywords(p, S.triples(spark, sf, "itemClassifiedAs"), first, ["small", "red", "blue", "ring", "widget"], "itemClassifiedAs")


def reach_n_hops(spark, sf):
    """Chains item -> work -> agent -> place -> region, as one predicate."""
    t = S.triples(spark, sf, "carries_or_shows", "agentOfCreation", "placeOfActivity", "P89_falls_within").withColumn("predicate", F.lit("any"))
    start = S.docs(spark, sf, "orders").filter(F.col("uri").endswith("00") | (F.col("uri") == "order/0"))
    return A.reachable(t, "any", start, 3, S.docs(spark, sf, "customer", "nation"))


def term_support(spark, sf):
    catalog = spark.createDataFrame([("work.createdBy", "agentOfCreation", None), ("item.classification", "itemClassifiedAs", "itemTypeId"), ("work.classification", "workClassifiedAs", "workTypeId"), ("set.memberOf", "member_of", None)], "term string, predicate string, field string")
    return A.term_support(catalog, S.triples(spark, sf), S.fields(spark, sf, "workTypeId"))


def term_support_by_type(spark, sf):
    """Besides one declared term, the id terms of each type and the inverse hops that the data have."""
    catalog = spark.createDataFrame([("work.createdBy", "agentOfCreation", None)], "term string, predicate string, field string")
    fields = S.fields(spark, sf, "workTypeId", "agentActivePlaceId", "conceptPrimaryName")
    return A.term_support(catalog, S.triples(spark, sf, "agentOfCreation", "placeOfActivity"), fields, S.docs(spark, sf, "nation", "customer", "supplier", "orders", "part"))


def two_patterns(spark, sf):
    t = S.triples(spark, sf, "itemClassifiedAs", "agentOfProduction")
    return A.two_patterns(t, "itemClassifiedAs", "agentOfProduction")


def field_use(spark, sf):
    return A.field_use(["workTypeId", "workLanguageId", "setPartOfId"], S.fields(spark, sf, "workTypeId", "workStatusId", "workLanguageId"))


def _log(spark, sf):
    return S.request_log(spark, sf)


def req_by_type(spark, sf):
    log = _log(spark, sf).withColumn("bytes", F.col("user_id"))
    return L.requests_by(log, "kind", start="2024-01-03", end="2024-01-20")


def duration_histogram(spark, sf):
    return L.duration_histogram(_log(spark, sf).withColumn("ms", F.col("ms") * 100), 86400.0)


def whole_second_hist(spark, sf):
    return L.whole_seconds(_log(spark, sf).withColumn("ms", F.col("ms") * 1000))


def wide_durations(spark, sf):
    return L.wide_durations(_log(spark, sf), ["view", "click", "error"])


def failed_requests(spark, sf):
    return L.slow_or_failed(_log(spark, sf).select("request_id", "kind", "ms"), 250, F.col("kind") == "error").select("request_id", "ms")


def activity_ranges(spark, sf):
    return L.activity_ranges(_log(spark, sf), "kind", 600, 1800)


def trimmed_to_ranges(spark, sf):
    """Requests during the busy stretches of errors."""
    ranges = L.activity_ranges(_log(spark, sf).filter("kind = 'error'"), "kind", 600, 1800)
    return L.in_ranges(_log(spark, sf), ranges.select("start", "end")).select("request_id", "kind")


def queue_summary(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return L.queue_summary(e.select(F.col("event_type").alias("server"), "ts", F.floor("value").alias("value")))


def regex_counts(spark, sf):
    return L.regex_counts(spark.read.parquet(f"{sf}/pages.parquet"), r"https?://([^/]+)/", "url", 1)


def mined_searches(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return L.mined_searches(e.select(F.col("event_type").alias("scope"), F.col("props").alias("criteria")))


def apply_changes(spark, sf):
    """Each customer's orders before 1998 are a set; later ones are batched into a change."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("set/"), F.col("o_custkey").cast("string")).alias("uri"), F.concat(F.lit("user"), (F.col("o_custkey") % 7).cast("string")).alias("username"), S.uri("order", "o_orderkey").alias("m"), "o_orderdate")
    group = lambda d: d.groupBy("uri", "username").agg(F.sort_array(F.collect_list("m")).alias("members"), F.max("o_orderdate").cast("timestamp").alias("at"))
    old = group(o.filter("o_orderdate < '1998-01-01'")).select("uri", "username", "members", F.array(F.struct(F.col("username").alias("user"), "at")).alias("history"))
    out = D.apply_changes(old, group(o.filter("o_orderdate >= '1998-01-01'")))
    return out.select("uri", "username", F.size("members").alias("n_members"), F.size("history").alias("n_history"))


def validate_records(spark, sf):
    """Documents as sets: their lines are notes, their first line the name, their source the label."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    lines = F.split("text", "\n")
    kind = F.when(F.col("lang") == "es", "Thing").otherwise("Set")
    return D.violations(d.select(S.uri("document", "doc_id").alias("uri"), kind.alias("kind"), F.slice(lines, 1, 1).alias("names"), lines.alias("notes"), F.col("source").alias("label")))


QUERIES = {
    f.__name__: f
    for f in (
        facet_value, facet_union, facet_date, facet_all, facet_candidates, facet_candidates_two_level, facet_narrow, related_list, related_all_pairs, related_cap, related_any, schema_edges,
        related_paths, related_statistics, release_sketches, similar_topwords, similar_weighted, similar_dates, vector_topk, name_completion, name_completion_context, dead_end_triples, predicate_coverage,
        predicate_diff, release_diff, highly_related, field_value_counts, top_values, record_types_per_predicate, record_types_along_paths, sample_by_collection, false_positives,
        estimate_vs_actual, keyword_explain, reach_n_hops, term_support, term_support_by_type, two_patterns, field_use, req_by_type, duration_histogram, whole_second_hist, wide_durations, failed_requests,
        activity_ranges, trimmed_to_ranges, queue_summary, regex_counts, mined_searches, apply_changes, validate_records,
    )
}

_LATE = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')"
_PRODUCED = "SELECT 'supplier/' || l_suppkey AS start, 'part/' || l_partkey AS uri, count(*) AS n FROM lineitem GROUP BY ALL"
_STRETCHES = """SELECT event_type AS kind, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (
  SELECT *, sum(gap) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS stretch FROM (
    SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) > 600000000)::INT, 0) AS gap FROM events))
  GROUP BY event_type, stretch HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 1800000000"""
_BUCKET_CASE = "CASE " + " ".join(f"WHEN ms < {b} THEN {i}" for i, (b, _) in enumerate(L.BUCKETS) if b) + f" ELSE {len(L.BUCKETS) - 1} END"
_BUCKET_ROWS = ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(L.BUCKETS))
_EDGE_SQL = """SELECT 'Place' AS from_type, 'P89_falls_within' AS predicate, 'Place' AS to_type, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'Person', 'placeOfActivity', 'Place', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'Group', 'placeOfActivity', 'Place', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'LinguisticObject', 'agentOfCreation', 'Person', count(*) FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'HumanMadeObject', 'itemClassifiedAs', 'Type', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey"""


def _paths_sql(start: str, middle: str, end: str) -> str:
    return f"""e AS ({_EDGE_SQL}), b AS (SELECT from_type AS x, predicate, true AS fw, to_type AS y FROM e UNION ALL SELECT to_type, predicate, false, from_type FROM e),
  p AS (SELECT a.x AS start_type, a.predicate AS first, b.predicate AS second, b.y AS end_type FROM b a JOIN b ON a.y = b.x
        WHERE a.x IN ({start}) AND a.y IN ({middle}) AND b.y IN ({end}) AND NOT (a.predicate = b.predicate AND a.fw <> b.fw AND a.x <> b.y))"""


ORACLE_SQL = {
    "facet_value": f"SELECT o_orderpriority AS value, count(*) AS n FROM {_LATE} GROUP BY ALL",
    "facet_union": f"SELECT value, count(DISTINCT o_orderkey) AS n FROM (SELECT o_orderkey, o_orderpriority AS value FROM {_LATE} UNION ALL SELECT o_orderkey, o_orderstatus FROM {_LATE}) GROUP BY ALL",
    "facet_date": f"SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS value, count(*) AS n FROM {_LATE} GROUP BY ALL",
    "facet_all": f"SELECT field, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM (SELECT 'workTypeId' AS field, o_orderpriority AS value, count(*) AS n FROM {_LATE} GROUP BY ALL UNION ALL SELECT 'workStatusId', o_orderstatus, count(*) FROM {_LATE} GROUP BY ALL UNION ALL SELECT 'workCreationStartDateLong', (epoch(o_orderdate)::BIGINT)::VARCHAR, count(*) FROM {_LATE} GROUP BY ALL)) WHERE rank <= 5",
    "facet_candidates": "SELECT 'region/' || n_regionkey AS value, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON n_nationkey = k GROUP BY ALL",
    "facet_candidates_two_level": f"WITH c AS (SELECT o_orderkey, CASE WHEN c_nationkey IN (1, 2) THEN 'nation/' || c_nationkey ELSE 'customer/' || c_custkey END AS value FROM orders JOIN customer ON c_custkey = o_custkey) SELECT value, count(DISTINCT {ITEM_SQL}) AS n FROM c JOIN lineitem ON l_orderkey = o_orderkey GROUP BY value",
    "facet_narrow": f"SELECT 'order/' || o_orderkey AS uri, 1.0::DOUBLE AS score FROM {_LATE} WHERE o_orderpriority = '3-MEDIUM'",
    "related_list": f"SELECT uri, 'maker-of-same' AS key, n, n AS total FROM ({_PRODUCED}) WHERE start = 'supplier/1'",
    "related_all_pairs": f"SELECT start, uri, 'maker-of-same' AS key, n, n AS total FROM ({_PRODUCED}) UNION ALL SELECT DISTINCT 'customer/' || o_custkey, {ITEM_SQL}, 'work-item', 1, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "related_cap": f"SELECT start, uri, n, n AS total FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, uri) AS r FROM ({_PRODUCED})) WHERE r <= 3",
    "related_any": "SELECT 'customer/' || c_custkey AS start, c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS related FROM customer",
    "schema_edges": _EDGE_SQL,
    "related_paths": f"WITH {_paths_sql(chr(39) + 'Person' + chr(39) + ', ' + chr(39) + 'Group' + chr(39), chr(39) + 'LinguisticObject' + chr(39) + ', ' + chr(39) + 'Place' + chr(39), chr(39) + 'Place' + chr(39) + ', ' + chr(39) + 'Person' + chr(39) + ', ' + chr(39) + 'Group' + chr(39))} SELECT start_type || '-' || first || '-' || second || '-' || end_type AS key, CASE first WHEN 'placeOfActivity' THEN 'place of activity' WHEN 'agentOfCreation' THEN 'agent of creation' ELSE 'falls_within' END AS label FROM p",
    "related_statistics": f"WITH {_paths_sql(repr('Person') + ', ' + repr('Group') + ', ' + repr('Place'), repr('LinguisticObject') + ', ' + repr('Place') + ', ' + repr('Person'), repr('Place') + ', ' + repr('Person') + ', ' + repr('Type'))} SELECT start_type, end_type, count(*) AS paths FROM p GROUP BY ALL",
    "release_sketches": "SELECT 'workTypeId' AS field, count(*) AS n, count(DISTINCT o_orderpriority) AS exact, true AS within_bound, true AS top_exact FROM orders UNION ALL SELECT 'workStatusId', count(*), count(DISTINCT o_orderstatus), true, true FROM orders UNION ALL SELECT 'workCreationStartDateLong', count(*), count(DISTINCT o_orderdate), true, true FROM orders",
    "similar_topwords": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN (" + ", ".join(f"'{x}'" for x in V.STOP_WORDS) + ") GROUP BY ALL) SELECT 'document/' || doc_id AS uri, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 5",
    "similar_weighted": "SELECT seed, uri, score, rank FROM (SELECT 'part/' || a.p_partkey AS seed, 'part/' || b.p_partkey AS uri, 2.0::DOUBLE + CASE WHEN a.p_name = b.p_name THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS score, row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN a.p_name = b.p_name THEN 3 ELSE 1 END DESC, 'part/' || b.p_partkey) AS rank FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0) WHERE rank <= 5",
    "similar_dates": "WITH p AS (SELECT p_partkey AS k, 1500 + p_partkey % 400 AS s, 1500 + p_partkey % 400 + p_size * 10 - 9 AS e FROM part) SELECT 'part/' || a.k AS seed, 'part/' || b.k AS uri FROM p a JOIN p b ON b.s < a.s - CASE WHEN a.s > 1900 THEN 10 WHEN a.s > 1700 THEN 20 ELSE 35 END AND b.e > a.e + CASE WHEN a.e > 1900 THEN 10 WHEN a.e > 1700 THEN 20 ELSE 35 END WHERE a.k % 100 = 0 AND a.k <> b.k",
    "vector_topk": "SELECT query, uri, round(cosine, 6) AS cosine, rank FROM (SELECT 'vector/' || q.vec_id AS query, 'vector/' || v.vec_id AS uri, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, 'vector/' || v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5",
    "name_completion": "SELECT 'customer/' || c_custkey AS uri, c_name AS names FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY names LIMIT 10",
    "name_completion_context": "SELECT 'nation/' || n_nationkey AS uri, n_name AS names FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY names LIMIT 10",
    "dead_end_triples": f"SELECT 'carries_or_shows' AS predicate, 'order/' || l_orderkey AS object, count(DISTINCT {ITEM_SQL}) AS sources FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 7) GROUP BY ALL UNION ALL SELECT 'itemClassifiedAs', 'part/' || l_partkey, count(DISTINCT {ITEM_SQL}) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 7) GROUP BY ALL",
    "predicate_coverage": f"SELECT 'agentOfCreation' AS predicate, count(*) AS records FROM orders UNION ALL SELECT 'agentOfProduction', count(DISTINCT {ITEM_SQL}) FROM lineitem UNION ALL SELECT 'placeOfActivity', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'member_of', 0",
    "predicate_diff": "SELECT * FROM (VALUES ('member_of', 'left'), ('P89_falls_within', 'right'), ('placeOfActivity', 'right'), ('carries_or_shows', 'right'), ('itemClassifiedAs', 'right'), ('eventCarriedOutBy', 'right')) t(predicate, side)",
    "release_diff": "SELECT o_orderpriority || '/' || o_orderstatus AS key, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') - count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS change FROM orders GROUP BY ALL",
    "highly_related": "SELECT 'order/' || l_orderkey AS src_uri, count(*) AS links FROM lineitem GROUP BY ALL ORDER BY links DESC, src_uri LIMIT 15",
    "field_value_counts": "SELECT 'workTypeId' AS field, count(DISTINCT o_orderpriority) AS n_values FROM orders UNION ALL SELECT 'workStatusId', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'conceptPrimaryName', count(DISTINCT p_name) FROM part UNION ALL SELECT 'itemDimensionValue', count(DISTINCT l_quantity) FROM lineitem UNION ALL SELECT 'setPrimaryName', 0",
    "top_values": "WITH v AS (SELECT 'agentActivePlaceId' AS field, 'nation/' || k AS value, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL UNION ALL SELECT 'workTypeId', o_orderpriority, count(*) FROM orders GROUP BY ALL) SELECT value, field, n, rank, n_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM v) LEFT JOIN nation ON value = 'nation/' || n_nationkey WHERE rank <= 4",
    "record_types_per_predicate": "SELECT * FROM (VALUES ('placeOfActivity', 'Group,Person'), ('agentOfCreation', 'LinguisticObject'), ('P89_falls_within', 'Place')) t(predicate, data_types)",
    "record_types_along_paths": "SELECT 'agentOfCreation' AS first, 'placeOfActivity' AS second, 'LinguisticObject-agentOfCreation-placeOfActivity-Place' AS key, 'LinguisticObject' AS first_types, 'Group,Person' AS second_types",
    "sample_by_collection": "WITH d AS (SELECT 'document/' || doc_id AS uri, lang, source FROM documents), m AS (SELECT 'english' AS name, uri FROM d WHERE 'en' IN (lang, source) UNION ALL SELECT 'english of src0', uri FROM d WHERE 'en' IN (lang, source) AND 'src0' IN (lang, source) UNION ALL SELECT 'french of src1', uri FROM d WHERE 'fr' IN (lang, source) AND 'src1' IN (lang, source)) SELECT name, uri, total FROM (SELECT *, count(*) OVER (PARTITION BY name) AS total, row_number() OVER (PARTITION BY name ORDER BY md5('0:' || uri), uri) AS rn FROM m) WHERE rn <= 5",
    "false_positives": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM documents), d AS (SELECT doc_id, bool_or(w = 'License') AS exact FROM t WHERE strip_accents(lower(w)) = 'license' GROUP BY doc_id) SELECT count(*) AS candidates, count(*) FILTER (NOT exact) AS rejected FROM d",
    "estimate_vs_actual": "SELECT o_orderstatus AS search_id, count(*) AS estimate, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS actual FROM orders GROUP BY ALL HAVING count(*) <> count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem))",
    "keyword_explain": f"WITH f AS (SELECT p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {ITEM_SQL} = (SELECT min({ITEM_SQL}) FROM lineitem)) SELECT k AS keyword, false AS own, (SELECT count(DISTINCT p_name) FROM f WHERE list_contains(string_split(p_name, ' '), k)) AS linked, (SELECT count(*) FROM f WHERE list_contains(string_split(p_name, ' '), k)) > 0 AS found FROM (VALUES ('small'), ('red'), ('blue'), ('ring'), ('widget')) t(k)",
    "reach_n_hops": "WITH s AS (SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 100 = 0) SELECT 'order/' || o_orderkey AS start, 'customer/' || o_custkey AS uri, 1 AS hops, true AS visible FROM s UNION ALL SELECT 'order/' || o_orderkey, 'nation/' || c_nationkey, 2, true FROM s UNION ALL SELECT 'order/' || o_orderkey, 'region/' || n_regionkey, 3, false FROM s",
    "term_support": "SELECT 'work.createdBy' AS term, (SELECT count(*) FROM orders) AS n_triples, 0 AS n_values, true AS supported UNION ALL SELECT 'item.classification', (SELECT count(*) FROM lineitem), 0, true UNION ALL SELECT 'work.classification', 0, (SELECT count(*) FROM orders), true UNION ALL SELECT 'set.memberOf', 0, 0, false",
    "term_support_by_type": "WITH c AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS made, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s) SELECT 'work.createdBy' AS term, o AS n_triples, 0 AS n_values, true AS supported FROM c UNION ALL SELECT 'LinguisticObject.workTypeId', 0, o, true FROM c UNION ALL SELECT 'Person.agentActivePlaceId', 0, c, true FROM c UNION ALL SELECT 'Group.agentActivePlaceId', 0, s, true FROM c UNION ALL SELECT 'Person.inverse.agentOfCreation', made, 0, true FROM c UNION ALL SELECT 'Place.inverse.placeOfActivity', c + s, 0, true FROM c",
    "two_patterns": f"SELECT a.uri AS subject, 'part/' || a.p AS one, 'supplier/' || b.s AS two FROM (SELECT {ITEM_SQL} AS uri, l_partkey AS p FROM lineitem) a JOIN (SELECT {ITEM_SQL} AS uri, l_suppkey AS s FROM lineitem) b USING (uri)",
    "field_use": "SELECT * FROM (VALUES ('setPartOfId', 'left'), ('workStatusId', 'right')) t(field, side)",
    "req_by_type": "SELECT event_type AS kind, count(*) AS requests, sum(user_id)::BIGINT AS bytes FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL",
    "duration_histogram": f"WITH e AS (SELECT event_type AS kind, {_BUCKET_CASE} AS place FROM (SELECT event_type, value * 100 AS ms FROM events)), c AS (SELECT kind, place, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT kind, count(*) AS subtotal FROM e GROUP BY kind) SELECT s.kind, b.place, b.bucket, coalesce(c.n, 0) AS n, subtotal, round(subtotal / 86400.0::DOUBLE, 6) AS per_second FROM s CROSS JOIN (VALUES {_BUCKET_ROWS}) b(place, bucket) LEFT JOIN c ON c.kind = s.kind AND c.place = b.place",
    "whole_second_hist": "SELECT event_type AS kind, least(floor(value * 1000 / 1000), 100)::INT AS seconds, count(*) AS n FROM events GROUP BY ALL",
    "wide_durations": "SELECT event_id AS request_id, CASE WHEN event_type = 'view' THEN value END AS view, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_type = 'error' THEN value END AS error FROM events",
    "failed_requests": "SELECT event_id AS request_id, value AS ms FROM events WHERE value >= 250 OR event_type = 'error'",
    "activity_ranges": _STRETCHES,
    "trimmed_to_ranges": f"WITH r AS ({_STRETCHES}) SELECT event_id AS request_id, event_type AS kind FROM events WHERE EXISTS (SELECT 1 FROM r WHERE r.kind = 'error' AND ts >= start AND ts <= r.\"end\")",
    "queue_summary": "WITH v AS (SELECT event_type AS server, floor(value)::BIGINT AS value FROM events) SELECT server, max(value) AS top, count(*) FILTER (value = m) AS times_at_top, count(*) FILTER (value > 0) AS above_zero, count(*) AS points, sum(value)::BIGINT AS total FROM (SELECT *, max(value) OVER (PARTITION BY server) AS m FROM v) GROUP BY server",
    "regex_counts": 'SELECT regexp_extract(url, \'https?://([^/]+)/\', 1) AS "match", count(*) AS n FROM pages WHERE regexp_matches(url, \'https?://([^/]+)/\') GROUP BY ALL',
    "mined_searches": "SELECT DISTINCT event_type AS scope, props AS criteria FROM events",
    "apply_changes": "WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS old, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS new FROM orders GROUP BY ALL) SELECT 'set/' || o_custkey AS uri, 'user' || (o_custkey % 7) AS username, (CASE WHEN new > 0 THEN new ELSE old END)::INT AS n_members, ((old > 0)::INT + (new > 0)::INT)::INT AS n_history FROM c",
    "validate_records": "WITH d AS (SELECT 'document/' || doc_id AS uri, lang, string_split(text, chr(10)) AS l FROM documents) SELECT uri, 'kind must be Set or Person' AS rule FROM d WHERE lang = 'es' UNION ALL SELECT uri, 'a name has at most 200 characters' FROM d WHERE length(l[1]) > 200 UNION ALL SELECT uri, 'at most 30 notes' FROM d WHERE len(l) > 30 UNION ALL SELECT uri, 'a note has at most 500 characters' FROM d WHERE len(list_filter(l, lambda x: length(x) > 500)) > 0",
}
