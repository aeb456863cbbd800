import pytest
from pyspark.sql import functions as F

from tessera.operators import batch as B
from tessera.operators import facets as C
from tessera.operators import match as M
from tessera.operators import page as P
from tessera.operators import properties as J

DAY = 86400


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([("w1", "Work"), ("w2", "Work"), ("w3", "Work"), ("a1", "Person"), ("a2", "Group"), ("p1", "Place")], "uri string, data_type string")
    triples = spark.createDataFrame(
        [("w1", "by", "a1", "w1"), ("w1", "by", "a1", "w1"), ("w2", "by", "a2", "w2"), ("w2", "by", "a1", "w2"), ("w3", "by", "gone", "w3"), ("a1", "in", "p1", "a1"), ("w3", "like", "w3", "w3")],
        "subject string, predicate string, object string, src_uri string",
    )
    f = [
        ("w1", "name", "Élan Vital of the Night", None, None), ("w2", "name", "A night's tale", None, None), ("w2", "name", "A night's tale", None, None), ("w3", "name", "Running foxes run", None, None),
        ("w1", "start", None, 0, None), ("w1", "end", None, 10 * DAY, None), ("w2", "start", None, 5 * DAY, None), ("w2", "end", None, 6 * DAY, None), ("w3", "start", None, 20 * DAY, None),
        ("w1", "size", None, None, 2.5), ("w2", "size", None, None, 7.0), ("w1", "by_id", "a1", None, None), ("w2", "by_id", "a1", None, None),
    ]
    fields = spark.createDataFrame(f, "uri string, field string, v_str string, v_long long, v_float double")
    return docs, triples, fields, M.build_postings(fields).cache()


def uris(m):
    return sorted(r.uri for r in m.collect())


def scores(m):
    return {r.uri: r.score for r in m.collect()}


def test_hops(frames):
    docs, t, fields, _ = frames
    a1 = M.by_uri(docs, ["a1"])
    assert uris(M.hop_forward(t, ["by"], a1)) == ["w1", "w2"]
    assert uris(M.hop_inverse(t, ["by"], M.by_uri(docs, ["w2"]))) == ["a1", "a2"]
    assert uris(M.hop_forward(t, ["by"], M.hop_forward(t, ["in"], M.by_uri(docs, ["p1"])))) == ["w1", "w2"]
    assert uris(M.hop_forward(t, ["by", "in"], M.iri(docs.sparkSession, ["a1", "p1"]), docs, ["Person"])) == ["a1"]
    assert uris(M.hop_by_id(fields, ["by_id"], "a1")) == uris(M.hop_forward(t, ["by"], a1))
    assert uris(M.hop_forward(t, ["by"], M.by_uri(docs, ["nobody"]))) == []


def test_inverse_of_inverse_holds_the_start(frames):
    docs, t, _, _ = frames
    start = M.by_uri(docs, ["w1"])
    assert set(uris(start)) <= set(uris(M.hop_forward(t, ["by"], M.hop_inverse(t, ["by"], start))))


def test_composition(frames):
    docs, *_ = frames
    x, y = M.by_uri(docs, ["w1", "w2"], 2.0), M.by_uri(docs, ["w2", "w3"], 0.5)
    assert scores(M.and_(x, y)) == scores(M.and_(y, x)) == {"w2": 2.5}
    assert scores(M.or_(x, y)) == {"w1": 2.0, "w2": 2.5, "w3": 0.5}
    assert uris(M.not_(docs, x, y)) == ["a1", "a2", "p1"]
    assert uris(M.not_(docs, M.not_(docs, x))) == uris(x)
    assert scores(M.boost(x, y)) == {"w1": 2.0, "w2": 2.5}
    assert M.or_(x) is x
    for f in (M.and_, M.or_):
        with pytest.raises(ValueError):
            f()
    assert uris(M.multi_scope({"agent": M.by_uri(docs, ["a1", "w1"]), "work": M.by_uri(docs, ["w3", "p1"])}, docs, {"agent": ["Person"], "work": ["Work"]})) == ["a1", "w3"]


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [("=", "1970-01-06T01:00:00;1970-01-06T02:00:00", ["w1", "w2"]), ("=", "1970-01-03T00:00:00;1970-01-06T02:00:00", ["w1"]), ("<", "1970-01-02", ["w1"]), (">=", "1970-01-07", ["w1"]), (">", ";1970-01-06", ["w1", "w2"]), ("!=", "1970-01-03", ["w1", "w2"])],
)
def test_date_ranges(frames, op, value, want):
    assert uris(M.date_range(frames[2], "start", "end", value, op)) == want


def test_ranges_and_types(frames):
    docs, _, fields, _ = frames
    assert uris(M.field_range(fields, "size", ">", 2.5)) == ["w2"] and uris(M.field_range(fields, "size", "!=", 0)) == ["w1", "w2"]
    assert uris(M.record_type(docs, ["agent"], {"agent": ["Person", "Group"]})) == ["a1", "a2"] and uris(M.record_type(docs, ["person"], {"agent": ["Person"]})) == ["a1"]
    with pytest.raises(ValueError):
        M.field_range(fields, "size", "~", 1)


def test_words(frames):
    p = frames[3]
    o = M.MatchOptions
    assert uris(M.field_word(p, ["name"], "elan")) == ["w1"] and uris(M.field_word(p, ["name"], "Elan", o(exact=True))) == []
    assert uris(M.field_word(p, ["name"], "vital of the night")) == ["w1"] and uris(M.field_word(p, ["name"], "night the")) == []
    assert uris(M.field_word(p, ["name"], "nig*t")) == ["w1", "w2"] and uris(M.field_word(p, ["name"], "?ale")) == ["w2"]
    for short in ("a*", "a*bc", "ni*t", "nig* a?"):  # a wildcard needs three other characters beside it
        with pytest.raises(ValueError):
            M.field_word(p, ["name"], short)
    assert uris(M.field_word(p, ["name"], "fox", o(stemmed=True))) == ["w3"]
    assert uris(M.field_word(p, ["name"], "a night s tale", o(complete=True))) == ["w2"] and uris(M.field_word(p, ["name"], "night", o(complete=True))) == []
    assert uris(M.keyword(p, ["name"], 'night "elan vital"')) == ["w1"]
    assert M.keyword(p, ["name"], "the") is None and M.keyword(p, ["name"], "!?") is None


def test_options_one_by_one(spark):
    rows = [("a", "The C++ Night's tale"), ("b", "the c nights Tale"), ("c", "THE NIGHT S  TALE, élan"), ("d", "night's-tale of ELAN"), ("e", None), ("f", "")]
    p = M.build_postings(spark.createDataFrame([(u, "n", v) for u, v in rows], "uri string, field string, v_str string"), gaps=True)
    find = lambda value, **o: uris(M.field_word(p, ["n"], value, M.MatchOptions(**o)))
    assert find("night's tale") == ["a", "c", "d"] and find("Night's tale", case=True) == ["a"]
    assert find("night's tale", punctuation=True) == ["a"] and find("night s tale", spacing=True) == [] and find("night's tale", spacing=True) == ["a"]
    assert find("night s  tale", spacing=True, punctuation=True) == ["c"]
    assert find("elan") == ["c", "d"] and find("elan", accents=True) == ["d"] and find("élan", accents=True) == ["c"] and find("elan", case=True) == ["c"]
    assert find("C++") == ["a", "b"] and find("C++", punctuation=True) == ["a"] and find("tale,", punctuation=True) == ["c"]
    assert find("the c++ night's tale", complete=True, punctuation=True) == ["a"] and find("c++ night's tale", complete=True, punctuation=True) == []
    assert find("NIG?T", case=True) == ["c"] and find("nig?t") == ["a", "c", "d"] and find("nights", stemmed=True) == ["a", "b", "c", "d"]
    assert find("tale_of") == ["d"] and find("Tale", exact=True) == ["b"]


def test_terms_that_are_left_out(frames):
    docs, t, _, p = frames
    gone, x = M.keyword(p, ["name"], "the"), M.by_uri(docs, ["w1"])
    assert gone is None and M.and_(gone, x) is x and M.or_(x, gone) is x and M.boost(x, gone) is x
    for f in (lambda: M.and_(gone), lambda: M.or_(gone, None), lambda: M.boost(gone, x), lambda: M.text_match(p, t, "name", "by", "the", "name")):
        with pytest.raises(ValueError):
            f()


def test_batch_of_words_links_and_dates(frames, spark):
    _, t, fields, p = frames
    rows = [("s1", 0, "name", "word", "Night", 1.0, False), ("s1", 1, "by", "linked", "a2", 2.0, False), ("s2", 0, "start", ">=", "1970-01-05", 1.0, False), ("s2", 1, "name", "word", "foxes", 1.0, True), ("s3", 0, "end", ">", "1970-01-07", 1.0, False), ("s3", 0, "start", "<=", "1970-01-01", 1.0, False), ("s4", 0, "end", ">", "no date", 1.0, False)]
    got = B.match_batch(spark.createDataFrame(rows, "search_id string, group_id int, field string, op string, value string, weight double, negated boolean"), fields, p, t)
    assert sorted((r.search_id, r.uri, r.score) for r in got.collect()) == [("s1", "w2", 3.0), ("s2", "w2", 1.0), ("s3", "w1", 1.0)]


def test_batch_equals_single_searches(frames, spark):
    docs, _, fields, _ = frames
    rows = [("s1", 0, "by_id", "=", "a1", 1.0, False), ("s1", 1, "size", ">", "3", 2.0, False), ("s2", 0, "size", ">=", "0", 1.0, False), ("s2", 1, "by_id", "=", "a1", 1.0, True), ("s3", 0, "size", "=", "2.5", 1.0, False), ("s3", 0, "size", "=", "7", 1.0, False)]
    got = B.match_batch(spark.createDataFrame(rows, "search_id string, group_id int, field string, op string, value string, weight double, negated boolean"), fields)
    assert sorted((r.search_id, r.uri, r.score) for r in got.collect()) == [("s1", "w2", 3.0), ("s3", "w1", 1.0), ("s3", "w2", 1.0)]


def test_pages(frames):
    docs, _, fields, _ = frames
    m = P.order_by_field(M.by_uri(docs, ["w1", "w2", "w3", "p1"]), fields, ["name"])
    first = [r.uri for r in P.search_page(m, docs, [("key", True)], 1, 3).collect()]
    assert first == ["w2", "w3", "w1"] and [r.uri for r in P.search_page(m, docs, [("key", True)], 2, 3).collect()] == ["p1"]
    assert P.page_with(m, "p1", [("key", True)], 3).collect()[0][1:] == (4, 2)
    assert P.page_with(m, "w3", [("key", False)], 3).collect()[0][1:] == (2, 1)
    assert P.page_with(m, "zz", [("key", True)], 3).count() == 0
    assert tuple(P.page_summary(m, 1, 3).first()) == (4, False, True)
    assert P.total_from_page(2, 20, 5) == 25 and P.total_from_page(1, 20, 20) is None and P.total_from_page(1, 20, 0) == 0
    with pytest.raises(ValueError):
        P.search_page(m, docs, [("key", True)], 0)


def test_hop_order_takes_first_or_last_name(frames):
    docs, t, _, _ = frames
    names = docs.select("uri", F.upper("uri").alias("name"))
    got = {r.uri: r.key for r in P.order_by_hop(M.by_uri(docs, ["w1", "w2", "w3"]), t, "by", names, ascending=False).collect()}
    assert got == {"w1": "A1", "w2": "A2", "w3": None}


def test_scopes(frames):
    docs, *_ = frames
    scopes = {"work": ["Work"], "agent": ["Person", "Group"], "reference": ["Person", "Place"], "set": ["Set"]}
    got = {r.scope: r.n for r in P.scope_counts(M.by_uri(docs, ["w1", "w2", "a1"]), docs, scopes).collect()}
    assert got == {"work": 2, "agent": 1, "reference": 1, "set": 0}
    counts = P.scope_counts(M.by_uri(docs, ["a1"]), docs, scopes)
    assert P.first_nonempty_scope(counts, "work", ["set", "agent", "work"]).first().scope == "agent"
    assert {r.name: r.matches for r in P.will_match({"x": M.by_uri(docs, ["w1"]), "y": M.by_uri(docs, ["q"])}).collect()} == {"x": 1, "y": 0}


def test_facets(frames):
    docs, t, fields, _ = frames
    m = M.by_uri(docs, ["w1", "w2", "w3"])
    assert {r.value: r.n for r in C.facet(m, fields, "name").collect()}["A night's tale"] == 1
    assert [tuple(r) for r in C.facet(m, fields, ["by_id"], page=1).collect()] == [("a1", 2)]
    assert uris(C.narrow(m, fields, "by_id", "a1")) == ["w1", "w2"] and uris(C.narrow(m, fields, "start", 0, "date")) == ["w1"]
    every = C.all_facets(m, fields, ["by_id", "size"], 1).collect()
    assert {(r.field, r.n) for r in every} == {("by_id", 2), ("size", 1)}
    units = C.unit_pairs(
        docs.sparkSession.createDataFrame([("i1", "member", "s1", "i1"), ("s1", "curated", "d1", "s1"), ("s1", "curated", "g1", "s1"), ("d1", "part", "u1", "d1")], "subject string, predicate string, object string, src_uri string"),
        docs.sparkSession.createDataFrame([("s1",)], "uri string"), docs.sparkSession.createDataFrame([("d1",)], "uri string"), "member", "curated", "part",
    )
    assert sorted(tuple(r) for r in units.collect()) == [("i1", "g1"), ("i1", "u1"), ("s1", "g1"), ("s1", "u1")]


def test_plans_have_no_python_and_no_cartesian_product(spark, sf_dir):
    from tessera.plans import search

    for name in ("hop_two_level_page", "hop_forward_items", "bool_and_or_not_boost", "batch_match"):
        plan = search.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan
    scan = M.field_range(search.S.fields(spark, sf_dir, "itemDimensionValue"), "itemDimensionValue", ">=", 48)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in scan


DEEP = '{"a": ' * 20 + '{"k": "bottom"}' + "}" * 20
RECORDS = [
    ("a", '{"k": [7, 8]}'), ("b", '{"x": {"k": ["u,v", "7", 9]}}'), ("c", '{"k": 77}'), ("d", '{"k": 7}'), ("e", '{"k": [[7]]}'), ("f", '{"t": "\\"k\\": 7"}'), ("g", None), ("h", '{"k": [{"z": 1}, 7]}'),
    ("i", '{"k": 7.0}'), ("j", '{"k": {"z": 7}}'), ("l", "no JSON"), ("m", DEEP), ("n", '{"k": null, "e": {}, "l": []}'), ("o", '[{"k": true}, {"k": "Été, 1999"}]'), ("p", "7"),
]


def test_property_index(spark):
    docs = spark.createDataFrame(RECORDS, "uri string, json string").repartition(3)
    index = J.property_index(docs).cache()
    has = lambda *values, exact=True: uris(J.property_value(index, ["k"], values, exact=exact))
    assert has(7) == ["a", "d", "e", "h", "i"] and has(9, "7") == ["b"] and has("bottom") == ["m"] and has(None) == ["n"] and has(True) == ["o"]
    assert has("ete 1999") == [] and has("ete 1999", exact=False) == ["o"] and uris(J.property_value(index, ["z"], [1, 7])) == ["h", "j"]
    assert {(r.property, r.kind) for r in index.filter("uri = 'n'").collect()} == {("k", "null"), ("e", "object"), ("l", "array")}
    with pytest.raises(ValueError):
        J.property_value(index, ["k"], [])


def test_property_search(spark):
    docs = spark.createDataFrame([(u, "A" if u < "i" else "B", j) for u, j in RECORDS], "uri string, data_type string, json string")
    index = J.property_index(docs).cache()
    find = lambda *args: uris(J.property_search(docs, index, *args))
    assert find(["A"], ["k"], {"k": 7}) == ["a", "d", "e", "h"] and find([], ["k", "z"], {}) == ["h", "j"] and find([], [], {"k": [7, 8]}) == ["a"]
    assert find(["B"], ["e", "l"], {"k": None}) == ["n"] and find(["C"]) == [] and len(find()) == len(RECORDS)


def test_longs_keep_their_digits(spark):
    f = spark.createDataFrame([("a", "n", None, (1 << 53) + 1, None), ("b", "n", None, 4, None), ("c", "n", None, None, 4.5)], "uri string, field string, v_str string, v_long long, v_float double")
    assert uris(M.field_range(f, "n", ">", 1 << 53)) == ["a"]
    assert uris(M.field_range(f, "n", ">", 4.2)) == ["a", "c"] and uris(M.field_range(f, "n", "<=", 4.2)) == ["b"] and uris(M.field_range(f, "n", "=", 4.5)) == ["c"]


def test_property_index_odd_texts(spark):
    """What Spark's parser takes is walked, however deep or odd; what it doesn't take has no rows."""
    deep = "[" * 40 + "5" + "]" * 40
    texts = {
        "deep": '{"a": %s}' % deep, "twice": '{"a": 1, "a": 2}', "big": '{"a": 123456789012345678901234567890, "b": -0.0, "c": 1e3}', "blank": '  {"a": "\\ud800x"}', "text": '"a"',
        "cut": '{"a": 1', "nan": '{"a": NaN}', "list": '[{"a": [true, null]}, {"a": {}}]', "none": None,
    }
    docs = spark.createDataFrame(list(texts.items()), "uri string, json string")
    rows = {tuple(r) for r in J.property_index(docs).collect()}
    number = lambda u, p, v: (u, p, "number", None, v, None)
    assert {r for r in rows if r[0] == "deep"} == {("deep", "a", "array", None, None, None), number("deep", "a", 5.0)}
    assert {r for r in rows if r[0] == "big"} == {number("big", "a", 123456789012345678901234567890.0), number("big", "b", 0.0), number("big", "c", 1000.0)}
    assert {r for r in rows if r[0] == "blank"} == {("blank", "a", "text", "?x", None, None)}
    assert {r[1:] for r in rows if r[0] == "list"} == {("a", "array", None, None, None), ("a", "boolean", None, None, True), ("a", "null", None, None, None), ("a", "object", None, None, None)}
    assert {r[0] for r in rows} == {"deep", "big", "blank", "list"}
    assert {r[1] for r in J.property_index(docs, names=["c"]).collect()} == {"c"}


def test_page_with_record_far_back(spark, tmp_path):
    """The query's place of a record counts all results, not the first 100,000 only."""
    from tessera.plans.search import page_with_record

    o = spark.range(100_030).selectExpr("id as o_orderkey", "timestamp_seconds(if(id = 77, 900000000, 800000000)) as o_orderdate")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in page_with_record(spark, str(tmp_path)).collect()] == [("order/77", 100_030, 5002)]
