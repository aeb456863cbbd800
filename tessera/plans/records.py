"""Registered queries: records as JSON, slices, profiles, log lines, counts and small functions.

The driver tables are turned into JSON records and log lines by expressions, so the work grows with them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.dates import at_seconds
from tessera.operators import logs as L
from tessera.operators import match as M
from tessera.operators import page as P
from tessera.operators import properties as J
from tessera.operators import records as D
from tessera.operators import related as R
from tessera.operators import similar as V
from tessera.operators.complete import complete_names
from tessera.sources import logs as SL
from tessera.sources import records as SR
from tessera.sources import tables as S
from tessera.sources.scratch import scratch


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def _names(*contents: Column) -> Column:
    """identified_by: names, the first in English, the second in French."""
    language = lambda code: F.array(F.struct(F.lit(code).alias("id"), F.lit(code).alias("_label")))
    return F.array(*[F.struct(F.lit("Name").alias("type"), c.alias("content"), language(code).alias("language")) for c, code in zip(contents, ("en", "fr"))])


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in parts of about 10,000: a row is short, so that a few tasks would read them all, and much work on JSON follows."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.repartition(max(1, -(-c.count() // 10_000)), "c_custkey")


def agents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON records (uri, data_type, sources, json), with triples and a vector of three numbers."""
    c = _customers(spark, sf)
    u = S.uri("customer", "c_custkey")
    record = F.struct(
        u.alias("id"), F.lit("Person").alias("type"), _names(F.col("c_name"), F.concat(F.lit("Client "), F.col("c_custkey").cast("string"))).alias("identified_by"),
        F.array(F.struct(F.col("c_mktsegment").alias("id"))).alias("classified_as"), F.array(F.struct(S.uri("nation", "c_nationkey").alias("id"))).alias("member_of"),
        F.array(F.lit("rights/open")).alias("subject_to"), F.struct(F.struct(F.concat((F.lit(1900) + F.pmod("c_custkey", F.lit(90))).cast("string"), F.lit("-01-01T00:00:00Z")).alias("begin_of_the_begin")).alias("timespan")).alias("born"),
        F.round("c_acctbal", 2).alias("balance"),
    )
    triple = F.struct(F.struct(u.alias("subject"), F.lit("placeOfActivity").alias("predicate"), S.uri("nation", "c_nationkey").alias("object")).alias("triple"))
    vector = F.struct(F.array(*[F.col(x).cast("float") for x in ("c_custkey", "c_nationkey")], F.lit(1.0).cast("float")).alias("main"))
    sources = F.array(F.lit("Unit"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return c.select(u.alias("uri"), F.lit("Person").alias("data_type"), sources.alias("sources"), _json(json=record, triples=F.array(triple), vectors=vector, admin=F.struct(sources.alias("sources"))).alias("json"))


def record_load(spark, sf):
    """Records written as JSON lines, those of indebted customers cut short, and loaded again: loaded and corrupt lines."""
    path = scratch(spark, "lines")
    debt = F.get_json_object("json", "$.json.balance").cast("double") < 0
    agents(spark, sf).select(F.when(debt, F.substring("json", 1, 40)).otherwise(F.col("json")).alias("value")).write.option("compression", "gzip").text(path)
    docs, corrupt = SR.read_records(spark, path)
    return docs.groupBy("data_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sources")).alias("n_sources")).union(corrupt.select(F.lit("corrupt")).agg(F.first(F.lit("corrupt")), F.count(F.lit(1)), F.lit(0).cast("long")))


def slices(spark, sf):
    d = SR.assign_slices(agents(spark, sf))
    return d.select(F.explode("collections").alias("name")).union(d.select(F.explode("readers"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def field_extraction(spark, sf):
    spec = [SR.FieldSpec("agentName", ("json.identified_by.content",)), SR.FieldSpec("agentTypeId", ("json.classified_as.id", "json.member_of.id"), "id"), SR.FieldSpec("agentBorn", ("json.born.timespan.begin_of_the_begin",), "date"), SR.FieldSpec("agentBalance", ("json.balance", "json.classified_as.id"), "number")]
    return SR.extract_fields(agents(spark, sf), spec)


def embedded_triples(spark, sf):
    return SR.record_triples(agents(spark, sf)).select("subject", "predicate", "object")


def set_triples(spark, sf):
    """A set for each order: about its customer and, by influence, the nation; classified by priority, holding its items' parts."""
    o = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    person = F.struct(S.uri("customer", "o_custkey").alias("id"), F.lit("Person").alias("type"), F.struct(F.array(F.struct(S.uri("nation", "c_nationkey").alias("id"), F.lit("Place").alias("type"))).alias("influenced_by")).alias("created_by"))
    ref = lambda c: F.array(F.struct(c.alias("id")))
    u = S.uri("set", "o_orderkey")
    record = F.struct(u.alias("id"), F.lit("Set").alias("type"), F.array(person).alias("about"), ref(F.col("o_orderpriority")).alias("classified_as"), ref(S.uri("order", "o_orderkey")).alias("containing"), F.struct(ref(S.uri("customer", "o_custkey")).alias("carried_out_by")).alias("created_by"))
    return SR.set_triples(o.select(u.alias("uri"), _json(json=record).alias("json")), S.SCOPE_TYPES).select("subject", "predicate", "object")


def vector_view(spark, sf):
    return SR.vector_view(agents(spark, sf), 3).select("uri", "data_type", F.col("main")[0].cast("double").alias("x"), F.col("main")[1].cast("double").alias("y"))


def slice_round_trip(spark, sf):
    """Exported, dropped and put back: what each slice of a nation has afterwards."""
    d = SR.assign_slices(agents(spark, sf))
    path = scratch(spark, "slice")
    SR.export_slice(d, ["n3", "n4"], path)
    left = SR.drop_slice(d, ["n3", "n4"])
    back = SR.import_slice(left, path)
    count = lambda x, when: x.select(F.lit(when).alias("when"), F.explode("collections").alias("name")).groupBy("when", "name").agg(F.count(F.lit(1)).alias("n"))
    return count(left, "left").union(count(back, "back"))


def _profile(name):
    def query(spark, sf):
        p = D.profile(agents(spark, sf), name)
        return p.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in p.dtypes])

    query.__name__ = f"profile_{name}"
    return query


profile_name, profile_location, profile_relationship, profile_rights = (_profile(n) for n in ("name", "location", "relationship", "rights"))


def profile_results(spark, sf):
    return D.profile(agents(spark, sf), "results").select("uri", F.get_json_object("json", "$.json.type").alias("type"))


def primary_names_french(spark, sf):
    return D.profile(agents(spark, sf), "name", "fr").select("id", "name")


def merged_profiles(spark, sf):
    a = agents(spark, sf)
    one = lambda d, c: d.select(F.col("id").alias("uri"), F.col("type"), F.array(c).alias("names"))
    m = D.merge_profiles(one(D.profile(a, "name"), "name"), one(D.profile(a, "name", "fr"), "name"))
    return m.select("uri", "type", F.array_join("names", "|").alias("names"))


def record_paths(spark, sf):
    """Sub-trees, classifications and properties that records are asked for by name."""
    j = F.col("json")
    # each step is a column of its own, so that it is worked out once
    a = agents(spark, sf).select("uri", F.get_json_object(D.sub_tree(j, "classified_as"), "$[0].id").alias("segment"), F.size(D.classified_with(j, "none")).alias("n_none"), F.get_json_object(j, "$.json").alias("inner"))
    kept = a.select("uri", "segment", "n_none", D.keep_properties(F.col("inner"), ["type", "id"]).alias("kept"))
    return kept.select("uri", "segment", "n_none", "kept", D.sorted_keys(F.col("kept")).alias("in_order"))


def deleted_records(spark, sf):
    """Sets of customers: those of indebted ones are defaults, those of nation 3 aren't user-made; one that isn't there is asked for, too."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    u = S.uri("set", "c_custkey").alias("uri")
    docs = c.select(u, (F.col("c_nationkey") != 3).alias("user_made"), (F.col("c_acctbal") < 0).alias("is_default"))
    wanted = c.select(u, "c_mktsegment").filter("c_mktsegment = 'BUILDING'").select("uri").union(c.agg(F.concat(F.lit("set/none-"), F.count(F.lit(1)).cast("string"))))
    left, rejected = D.delete_records(docs, wanted)
    return left.select("uri", F.lit("left").alias("state")).union(rejected)


def visible_records(spark, sf):
    d = SR.assign_slices(agents(spark, sf)).withColumn("username", F.when(F.col("uri").endswith("7"), "user7").when(F.col("uri").endswith("8"), "user8"))
    return D.visible(d, ["n3", "n8"], "user7").groupBy("seen_as").agg(F.count(F.lit(1)).alias("n"))


def new_sets(spark, sf):
    """Changes without a uri, half of them breaking a rule once they have one: what is created."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    changes = c.select(S.uri("set", "c_custkey").alias("uri"), F.concat(F.lit("user"), F.col("c_nationkey").cast("string")).alias("username"), F.array(F.col("c_mktsegment"), F.col("c_name"), F.col("c_mktsegment")).alias("members"), F.timestamp_seconds(F.col("c_custkey") * 60).alias("at"))
    records = c.select(S.uri("set", "c_custkey").alias("uri"), F.lit("Set").alias("kind"), F.when(F.col("c_acctbal") >= 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("names"), F.array().cast("array<string>").alias("notes"), F.lit("x").alias("label"))
    sets = changes.limit(0).select("uri", "username", "members", F.array(F.struct(F.col("username").alias("user"), "at")).alias("history"))
    out = D.apply_changes(sets, changes, records)
    return out.select("uri", "username", F.array_join("members", "|").alias("members"), F.size("history").alias("n_history"))


_URLS = {"click": "/ds/app/search.mjs", "view": "/ds/app/document/read.mjs", "purchase": "/ds/app/facets.mjs", "signup": "/ds/app/relatedList.mjs"}


def _url(kind: Column) -> Column:
    url = F.lit("/other")
    for k, u in _URLS.items():
        url = F.when(kind == k, F.lit(u)).otherwise(url)
    return F.concat(url, F.lit("?q=1"))


def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    """events as access-log lines (node, line): one node for each of three users, errors with status 500, every purchase unparsable in part."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    line = F.concat(F.lit("10.0.0.1 - u"), F.col("user_id").cast("string"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), _url(F.col("event_type")), F.lit(' HTTP/1.1" '), status, F.lit(" "), F.floor("value").cast("string"), F.lit(" - -"))
    return e.select(F.concat(F.lit("node"), F.pmod("user_id", F.lit(3)).cast("string")).alias("node"), line.alias("line"))


def requests_by_node(spark, sf):
    return L.requests_by(SL.access_log(access_lines(spark, sf)), "node", "kind")


def facets_per_search(spark, sf):
    return L.facets_per_search(SL.access_log(access_lines(spark, sf))).select("node", F.round("facets_per_search", 6).alias("facets_per_search"))


def status_counts(spark, sf):
    return L.requests_by(SL.access_log(access_lines(spark, sf)), "status").select("status", "requests")


def search_traces(spark, sf):
    """events as search-trace lines, read back; lines of errors have no criteria and drop out."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = lambda c: c.cast("string")
    ms = F.floor("value")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" Info: requestId: r"), n(F.col("event_id")), F.lit("; requestContext: c; filterResults: true; totalElapsed: "), n(ms), F.lit("; searchElapsed: "), n(F.floor(ms / 2)), F.lit("; estimate: "), n(F.col("user_id")), F.lit("; returned: 20; scope: ["), F.col("event_type"), F.lit("]"), F.when(F.col("event_type") != "error", F.concat(F.lit("; searchCriteria: ["), F.col("props"), F.lit("]"))).otherwise(F.lit("")))
    t = SL.trace_log(e.select(F.lit("n").alias("node"), line.alias("line")))
    return t.select("request_id", "filtered", "total_ms", "search_ms", "estimate", "returned", "scope", "criteria")


def request_log_table(spark, sf):
    """events as JSON lines, one in each kind of user broken, read as a table: filled cells of the columns, and broken lines."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    path = scratch(spark, "requests")
    row = _json(url=_url(F.col("event_type")), elapsedTime=F.floor("value"), user=F.when(F.col("event_type") != "view", F.col("user_id")), zone=F.col("event_type"))
    e.select(F.when(F.col("event_type") == "error", F.substring(row, 1, 12)).otherwise(row).alias("value")).write.text(path)
    wide, bad = SL.read_request_log(spark, path)
    filled = wide.agg(*[F.count_if(F.col(c) != "").alias(c) for c in ("url", "user", "elapsedTime", "zone")])
    return filled.crossJoin(bad)  # one row each


def report_round_trip(spark, sf):
    """A report by kind written as TSV and read again."""
    path = scratch(spark, "report")
    SL.write_report(spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.csv(path, sep="\t", header=True, schema="event_type string, n long")


def report_as_json(spark, sf):
    """A report by kind written as JSON lines and read again."""
    path = scratch(spark, "report")
    SL.write_report(spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path, "json")
    return spark.read.json(path, schema="event_type string, n long")


def logs_of_nodes(spark, sf):
    """Access logs written to a folder for each node and read back from all of them: requests by node and kind."""
    path = scratch(spark, "access")
    access_lines(spark, sf).select("node", F.col("line").alias("value")).write.partitionBy("node").text(path)
    log = SL.read_access_log(spark, [f"{path}/node=node{i}" for i in range(3)], by_folder=True)
    return L.requests_by(log, "node", "kind").select("node", "kind", "requests")


def metric_series(spark, sf):
    """events as metric files, one for each node and day, read back: values, their sum and the first by node."""
    path = scratch(spark, "metrics")
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("name", F.concat(F.lit("node"), F.pmod("user_id", F.lit(3)).cast("string")))
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dt"), F.floor("value").alias("value"))
    days = e.groupBy("name", F.to_date("ts").alias("day")).agg(F.collect_list(entry).alias("entry"))
    days.select(F.to_json(F.array(F.struct("name", F.struct("entry").alias("data")))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    m = SL.read_metrics(spark, path)
    return m.groupBy("server").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"))


def total_without_count(spark, sf):
    """The total of a search from its last page, which isn't full."""
    m = M.record_type(S.docs(spark, sf, "nation"), ["place"], S.SCOPE_TYPES)
    got = P.search_page(m, S.docs(spark, sf, "nation"), page=2, length=20).count()
    return spark.createDataFrame([(P.total_from_page(2, 20, got),)], "total long")


def other_scope(spark, sf):
    """Where the scope asked for has no match, the first in order that has some."""
    names = S.fields(spark, sf, "agentPrimaryName", "placePrimaryName")
    m = names.filter(F.col("v_str").endswith("1")).select("uri").distinct()
    counts = P.scope_counts(m, S.docs(spark, sf, "region", "nation", "customer", "supplier"), S.SCOPE_TYPES)
    return P.first_nonempty_scope(counts, "event", S.SCOPE_ORDER)


def all_getters(spark, sf):
    """All sub-trees by name of records made of customers; those with even keys have what events hold in their parts only."""
    events: dict[str, dict[str, str]] = {}
    for name, (event, what) in D.GETTERS.items():
        events.setdefault(event, {})[what] = name

    def record(in_parts: bool) -> str:
        sub = lambda whats: whats[""] if "" in whats else ({"part": [whats]} if in_parts else whats)
        return json.dumps({"json": {e: sub(w) for e, w in events.items()}})

    c = _customers(spark, sf)
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit(record(True))).otherwise(F.lit(record(False)))
    r = c.select(S.uri("customer", "c_custkey").alias("uri"), text.alias("json"))
    got = F.explode(F.array(*[F.struct(F.lit(n).alias("getter"), F.regexp_replace(D.sub_tree(F.col("json"), n), r'[\[\]"]', "").alias("found")) for n in D.GETTERS])).alias("g")
    return r.select("uri", got).select("uri", "g.*")


def merge_rates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" Info: Merged "), F.col("user_id").cast("string"), F.lit(" MB in "), (F.pmod("event_id", F.lit(9)) + 1).cast("string"), F.lit(" sec at "), F.floor("value").cast("string"), F.lit(" MB/sec"))
    r = L.merge_rate(SL.merges(e.select(F.lit("n").alias("node"), line.alias("line"))))
    return r.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "mb", "seconds", F.round("mb_per_second", 6).alias("mb_per_second"))


def profile_requests(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    p = F.when(F.col("event_type") == "click", "name").when(F.col("event_type") == "view", "location").when(F.col("event_type") == "error", "strange")
    return L.profile_counts(e.select(p.alias("profile")))


def related_list_checks(spark, sf):
    """events as lines of related-list checks; errors report no duration."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    ms = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat(F.lit("; milliseconds: "), (F.floor("value") * 100).cast("string")))
    line = F.concat(F.lit("Info: relatedListName: "), F.col("event_type"), F.lit("; scope: agent; uri: customer/"), F.col("user_id").cast("string"), F.lit("; has: "), (F.col("value") > 50).cast("string"), ms)
    return L.odd_related_lists(L.related_checks(e.select(line.alias("line"))))


def severe_lines(spark, sf):
    """Lines of server logs above Info, and restarts, by node."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    level = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Warning").otherwise("Info")
    what = F.when(F.col("event_type") == "signup", "Starting server").otherwise("request")
    lines = e.select(F.concat(F.lit("node"), F.pmod("user_id", F.lit(3)).cast("string")).alias("node"), F.concat(F.lit("2024-01-01 "), level, F.lit(": "), what).alias("line"))
    return L.severe(lines).groupBy("node").agg(F.count(F.lit(1)).alias("severe")).join(L.restarts(lines), "node")


def meter_slice(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("start_time"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("value").cast("long") * 1_000_000).alias("end_time"))
    middle = e.agg(F.min("start_time").alias("a"), F.max("start_time").alias("b")).first()
    return L.meter_slice(e, middle["a"], middle["b"]).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


def documents_by_id(spark, sf):
    return M.by_uri(S.docs(spark, sf, "customer", "part"), ["customer/3", "part/5", "part/none"], 2.0)


def estimates(spark, sf):
    """Counts of a search, its verified results, and of records with all of several tags."""
    m = M.field_value(S.fields(spark, sf, "workTypeId"), ["workTypeId"], ["1-URGENT"])
    open_ = M.field_value(S.fields(spark, sf, "workStatusId"), ["workStatusId"], ["O"])
    tagged = P.tagged_count(SR.assign_slices(agents(spark, sf)), "unit", "n3")
    rows = [(P.estimate(m), "exact"), (P.estimate(P.verified(m, open_)), "verified"), (tagged.toDF("estimate"), "tagged")]
    out = None
    for df, name in rows:
        part = df.select(F.lit(name).alias("name"), F.col("estimate"))
        out = part if out is None else out.union(part)
    return out


def random_order(spark, sf):
    """All places in a repeatable random order, with the key they are sorted by."""
    m = M.record_type(S.docs(spark, sf, "region", "nation"), ["place"], S.SCOPE_TYPES).withColumn("key", P.random_key(7))
    return P.search_page(m, S.docs(spark, sf, "region", "nation"), [("key", True)], length=100)


def related_as_filter(spark, sf):
    """Works made by the makers who are active in nation/3, as a filter."""
    t = S.triples(spark, sf, "placeOfActivity", "agentOfCreation")
    return M.related_filter(t, {"works of the place": [("placeOfActivity", False), ("agentOfCreation", False)]}, "nation/3")


def related_because(spark, sf):
    """The customers through whom nation/3 and order/77's nation meet: middles of a path from each work to its place."""
    t = S.triples(spark, sf, "placeOfActivity", "agentOfCreation")
    return R.connecting(t, ("works", "agentOfCreation", True, "placeOfActivity", True), "order/77", _place_of(spark, sf))


def _place_of(spark: SparkSession, sf: str) -> str:
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    return "nation/%d" % o.filter("o_orderkey = 77").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey").first()[0]


def similar_as_filter(spark, sf):
    """Concepts similar to part/1 that are rings, too."""
    spec = {"name": (["conceptPrimaryName"], 2.0, False), "type": (["conceptTypeId"], 1.0, True)}
    names = S.fields(spark, sf, "conceptPrimaryName", "conceptTypeId")
    return M.and_(V.similar_match(V.aspect_values(names, spec), "part/1"), M.field_word(M.build_postings(S.fields(spark, sf, "conceptPrimaryName")), ["conceptPrimaryName"], "ring", weight=0.5))


def completion_of_a_middle_word(spark, sf):
    return complete_names(S.fields(spark, sf, "conceptPrimaryName"), "conceptPrimaryName", "wid")


def completion_by_alternatives(spark, sf):
    f = S.fields(spark, sf, "conceptPrimaryName")
    other = S.fields(spark, sf, "conceptTypeId").withColumn("field", F.lit("conceptName"))
    return complete_names(f.unionByName(other), "conceptPrimaryName", "standard", alternatives=True)


def property_in_arrays(spark, sf):
    """Orders as JSON with the numbers of their lines in an array: those that have a line 3 or 7."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("lines"))
    return J.property_value(J.property_rows(l.select(S.uri("order", "l_orderkey").alias("uri"), _json(json=F.struct(F.col("lines").alias("line"))).alias("json")), names=["line"]), ["line"], [3, 7])


def link_functions(spark, sf):
    """Links, arrays, templates and casts of values of the tables."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    q, base = F.concat(F.lit("name "), F.col("c_name")), F.lit("https://h")
    a, b = F.array("c_mktsegment", F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    return c.select(
        "c_custkey", T.page_link(base, "search", F.lit("agent"), q, F.lit(2), F.lit(20)).alias("page"), T.facet_link(base, F.lit("agent"), F.lit("agentTypeId"), q, F.lit(1)).alias("facet"),
        T.estimate_link(base, F.lit("agent"), q).alias("estimate"), T.list_link(base, F.lit("agent"), F.lit("works of"), q).alias("list"), F.array_join(T.array_merge(a, b), "|").alias("merged"),
        F.array_join(T.array_remove_all(a, b), "|").alias("removed"), F.array_join(T.array_difference(a, b), "|").alias("differing"), T.arrays_equal(a, F.array(F.lit("y"), F.col("c_mktsegment"), F.lit("x"))).alias("same"),
        F.array_join(T.array_swap(a, F.lit("x"), F.lit("w")), "|").alias("swapped"), T.fill(F.lit("%who in %where"), who=F.col("c_name"), where=F.col("c_mktsegment")).alias("filled"),
        T.escape_regex(F.concat(F.col("c_name"), F.lit("(1)."))).alias("escaped"), T.to_number(F.col("c_nationkey").cast("string")).alias("number"), at_seconds(F.lit("2020-01-02T03:04:05.678")).alias("cut"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        record_load, slices, field_extraction, embedded_triples, set_triples, vector_view, slice_round_trip, profile_name, profile_location, profile_relationship, profile_rights, profile_results,
        primary_names_french, merged_profiles, record_paths, deleted_records, visible_records, new_sets, requests_by_node, facets_per_search, status_counts, search_traces, request_log_table,
        report_round_trip, merge_rates, profile_requests, related_list_checks, severe_lines, meter_slice, documents_by_id, estimates, random_order, related_as_filter, related_because,
        report_as_json, logs_of_nodes, metric_series, total_without_count, other_scope, all_getters, similar_as_filter, completion_of_a_middle_word, completion_by_alternatives, property_in_arrays, link_functions,
    )
}

_C = "'customer/' || c_custkey"
_KIND = "CASE event_type WHEN 'click' THEN 'Search' WHEN 'view' THEN 'Document' WHEN 'purchase' THEN 'Facet' WHEN 'signup' THEN 'Related List' ELSE 'Other' END"
_PATH = "CASE event_type WHEN 'click' THEN '/ds/app/search.mjs' WHEN 'view' THEN '/ds/app/document/read.mjs' WHEN 'purchase' THEN '/ds/app/facets.mjs' WHEN 'signup' THEN '/ds/app/relatedList.mjs' ELSE '/other' END || '?q=1'"

_NAMES = ", ".join(f"('{n}')" for n in D.GETTERS)
ORACLE_SQL = {
    "report_as_json": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "logs_of_nodes": f"SELECT 'node=node' || user_id % 3 AS node, {_KIND} AS kind, count(*) AS requests FROM events GROUP BY ALL",
    "metric_series": "SELECT 'node' || user_id % 3 AS server, count(*) AS n, sum(floor(value))::BIGINT AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM events GROUP BY ALL",
    "total_without_count": "SELECT count(*) AS total FROM nation",
    "other_scope": "SELECT 'agent' AS scope, (SELECT count(*) FROM customer WHERE c_name LIKE '%1') + (SELECT count(*) FROM supplier WHERE s_name LIKE '%1') AS n",
    "all_getters": f"SELECT 'customer/' || c_custkey AS uri, getter, getter AS found FROM customer, (VALUES {_NAMES}) g(getter)",
    "record_load": "SELECT 'Person' AS data_type, count(*) AS n, 2 * count(*) AS n_sources FROM customer WHERE round(c_acctbal, 2) >= 0 UNION ALL SELECT 'corrupt', count(*), 0 FROM customer WHERE round(c_acctbal, 2) < 0",
    "slices": "SELECT name, count(*) AS n FROM (SELECT unnest(['unit', 'n' || c_nationkey, 'all', 'unit-reader', 'n' || c_nationkey || '-reader']) AS name FROM customer) GROUP BY name",
    "field_extraction": f"SELECT {_C} AS uri, 'agentName' AS field, unnest([c_name, 'Client ' || c_custkey]) AS v_str, NULL::BIGINT AS v_long, NULL::DOUBLE AS v_float FROM customer UNION ALL SELECT {_C}, 'agentTypeId', unnest([c_mktsegment, 'nation/' || c_nationkey]), NULL, NULL FROM customer UNION ALL SELECT {_C}, 'agentBorn', NULL, epoch(make_timestamp(1900 + c_custkey % 90, 1, 1, 0, 0, 0))::BIGINT, NULL FROM customer UNION ALL SELECT {_C}, 'agentBalance', NULL, NULL, round(c_acctbal, 2) FROM customer",
    "embedded_triples": f"SELECT {_C} AS subject, 'placeOfActivity' AS predicate, 'nation/' || c_nationkey AS object FROM customer",
    "set_triples": "WITH o AS (SELECT 'set/' || o_orderkey AS s, * FROM orders JOIN customer ON c_custkey = o_custkey) SELECT s AS subject, 'about_or_depicts_agent' AS predicate, 'customer/' || o_custkey AS object FROM o UNION ALL SELECT s, 'about_or_depicts_place', 'nation/' || c_nationkey FROM o UNION ALL SELECT s, 'setClassifiedAs', o_orderpriority FROM o UNION ALL SELECT 'order/' || o_orderkey, 'member_of', s FROM o UNION ALL SELECT s, 'agentOfCreation', 'customer/' || o_custkey FROM o",
    "vector_view": f"SELECT {_C} AS uri, 'Person' AS data_type, c_custkey::FLOAT::DOUBLE AS x, c_nationkey::FLOAT::DOUBLE AS y FROM customer",
    "slice_round_trip": "WITH n AS (SELECT unnest(['unit', 'n' || c_nationkey, 'all']) AS name, c_nationkey IN (3, 4) AS out FROM customer) SELECT 'left' AS \"when\", name, count(*) AS n FROM n WHERE NOT out GROUP BY name UNION ALL SELECT 'back', name, count(*) FROM n GROUP BY name",
    "profile_name": f"SELECT {_C} AS id, 'Person' AS type, c_name AS name, NULL::VARCHAR AS defined_by FROM customer",
    "profile_location": f"SELECT {_C} AS id, 'Person' AS type, '' AS identifiers, 'nation/' || c_nationkey AS member_of FROM customer",
    "profile_relationship": f"SELECT {_C} AS id, 'Person' AS type, c_name AS name, NULL::VARCHAR AS produced_by, NULL::VARCHAR AS supertypes, c_mktsegment AS classified_as, NULL::VARCHAR AS image FROM customer",
    "profile_rights": f"SELECT {_C} AS id, 'Person' AS type, 'rights/open' AS subject_to FROM customer",
    "profile_results": f"SELECT {_C} AS uri, 'Person' AS type FROM customer",
    "primary_names_french": f"SELECT {_C} AS id, 'Client ' || c_custkey AS name FROM customer",
    "merged_profiles": f"SELECT {_C} AS uri, 'Person' AS type, c_name || '|Client ' || c_custkey AS names FROM customer",
    "record_paths": f"SELECT {_C} AS uri, c_mktsegment AS segment, 0 AS n_none, '{{\"type\":\"Person\",\"id\":\"' || {_C} || '\"}}' AS kept, '{{\"id\":\"' || {_C} || '\",\"type\":\"Person\"}}' AS in_order FROM customer",
    "deleted_records": "SELECT 'set/' || c_custkey AS uri, 'left' AS state FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey = 3 OR c_acctbal < 0 UNION ALL SELECT 'set/' || c_custkey, CASE WHEN c_nationkey = 3 THEN 'not user-made' ELSE 'default set' END FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_nationkey = 3 OR c_acctbal < 0) UNION ALL SELECT 'set/none-' || count(*), 'no such record' FROM customer",
    "visible_records": "SELECT CASE WHEN c_custkey % 10 = 8 THEN 'name' ELSE 'record' END AS seen_as, count(*) AS n FROM customer WHERE c_nationkey IN (3, 8) GROUP BY ALL",
    "new_sets": "SELECT 'set/' || c_custkey AS uri, 'user' || c_nationkey AS username, c_mktsegment || '|' || c_name AS members, 1 AS n_history FROM customer WHERE c_acctbal >= 0",
    "requests_by_node": f"SELECT 'node' || (user_id % 3) AS node, {_KIND} AS kind, count(*) AS requests, sum(floor(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY ALL",
    "facets_per_search": f"SELECT node, round(count(*) FILTER (kind = 'Facet') / nullif(count(*) FILTER (kind = 'Search'), 0), 6) AS facets_per_search FROM (SELECT 'node' || (user_id % 3) AS node, {_KIND} AS kind FROM events) GROUP BY node",
    "status_counts": "SELECT CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, count(*) AS requests FROM events GROUP BY ALL",
    "search_traces": "SELECT 'r' || event_id AS request_id, true AS filtered, floor(value)::BIGINT AS total_ms, floor(floor(value) / 2)::BIGINT AS search_ms, user_id AS estimate, 20 AS returned, event_type AS scope, props AS criteria FROM events WHERE event_type <> 'error'",
    "request_log_table": "SELECT count(*) FILTER (event_type <> 'error') AS url, count(*) FILTER (event_type NOT IN ('error', 'view')) AS user, count(*) FILTER (event_type <> 'error') AS elapsedTime, count(*) FILTER (event_type <> 'error') AS zone, count(*) FILTER (event_type = 'error') AS bad_lines FROM events",
    "report_round_trip": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "merge_rates": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, sum(user_id)::BIGINT AS mb, sum(event_id % 9 + 1)::BIGINT AS seconds, round(avg(floor(value)::BIGINT), 6) AS mb_per_second FROM events GROUP BY minute",
    "profile_requests": "SELECT CASE event_type WHEN 'click' THEN 'name' WHEN 'view' THEN 'location' WHEN 'error' THEN 'other' ELSE 'none' END AS profile, count(*) AS n FROM events GROUP BY ALL",
    "related_list_checks": "SELECT event_type AS name, count(*) AS checks, count(*) FILTER (value > 50) AS found, count(*) FILTER (event_type = 'error') AS unknown, count(*) FILTER (event_type <> 'error' AND floor(value) * 100 >= 10000) AS slow FROM events GROUP BY event_type",
    "severe_lines": "SELECT 'node' || (user_id % 3) AS node, count(*) FILTER (event_type IN ('error', 'click')) AS severe, count(*) FILTER (event_type = 'signup') AS restarts FROM events GROUP BY ALL",
    "meter_slice": "WITH e AS (SELECT event_id, ts, ts + to_seconds(floor(value)::BIGINT) AS e FROM events) SELECT count(*) AS n, min(event_id) AS least FROM e WHERE ts > (SELECT min(ts) FROM e) AND e < (SELECT max(ts) FROM e)",
    "documents_by_id": "SELECT 'customer/' || c_custkey AS uri, 2.0::DOUBLE AS score FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'part/' || p_partkey, 2.0::DOUBLE FROM part WHERE p_partkey = 5",
    "estimates": "SELECT 'exact' AS name, count(*) AS estimate FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'verified', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION ALL SELECT 'tagged', count(*) FROM customer WHERE c_nationkey = 3",
    "random_order": "SELECT uri, 'Place' AS data_type, md5('7:' || uri) AS key FROM (SELECT 'region/' || r_regionkey AS uri FROM region UNION ALL SELECT 'nation/' || n_nationkey FROM nation)",
    "related_as_filter": "SELECT 'order/' || o_orderkey AS uri, 1.0::DOUBLE AS score FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3",
    "related_because": "SELECT 'customer/' || o_custkey AS uri FROM orders WHERE o_orderkey = 77",
    "similar_as_filter": "SELECT 'part/' || p.p_partkey AS uri, CASE WHEN p.p_name = s.p_name THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + 1.5::DOUBLE AS score FROM part p, (SELECT * FROM part WHERE p_partkey = 1) s WHERE p.p_partkey <> 1 AND p.p_type = s.p_type AND regexp_matches(lower(p.p_name), '(^| )ring( |$)')",
    "completion_of_a_middle_word": "SELECT 'part/' || p_partkey AS uri, p_name AS names FROM part WHERE regexp_matches(lower(p_name), '(^| )wid') ORDER BY names, uri LIMIT 10",
    "completion_by_alternatives": "SELECT 'part/' || p_partkey AS uri, p_name AS names FROM part WHERE regexp_matches(lower(p_type), '(^| )standard') ORDER BY names, uri LIMIT 10",
    "property_in_arrays": "SELECT DISTINCT 'order/' || l_orderkey AS uri, 1.0::DOUBLE AS score FROM lineitem WHERE l_linenumber IN (3, 7)",
    "link_functions": "WITH c AS (SELECT *, 'name%20' || replace(c_name, '#', '%23') AS q FROM customer) SELECT c_custkey, 'https://h/search/agent?q=' || q || '&page=2&pageLength=20' AS page, 'https://h/facets/agent/agentTypeId?q=' || q || '&page=1' AS facet, 'https://h/search-estimate/agent?q=' || q AS estimate, 'https://h/related-list/agent?name=works%20of&uri=' || q AS list, c_mktsegment || '|x|y|z' AS merged, c_mktsegment || '|x' AS removed, c_mktsegment || '|x|z' AS differing, true AS same, c_mktsegment || '|w|y' AS swapped, c_name || ' in ' || c_mktsegment AS filled, c_name || '\\(1\\)\\.' AS escaped, c_nationkey::DOUBLE AS number, '2020-01-02T03:04:05' AS cut FROM c",
}
