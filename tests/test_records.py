import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import records as D
from tessera.sources import records as R


def record(i, **more):
    return {"json": {"id": f"r{i}", "type": "Person", **more}, "admin": {"sources": ["YUAG", "Ypm"]}, "triples": [{"triple": {"subject": f"r{i}", "predicate": "knows", "object": "r1"}}]}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    lines = [
        json.dumps(record(1, identified_by=[{"type": "Name", "content": "Un", "language": [{"id": "fr"}]}, {"type": "Name", "content": "One", "language": [{"id": "en"}]}, {"type": "Identifier", "content": "ID-1"}], height="12.5", born={"timespan": {"begin_of_the_begin": "1910-01-01"}})),
        json.dumps(record(2, identified_by=[{"type": "Name", "content": "Zwei"}], height="tall", about=[{"id": "r1", "type": "Person"}])),
        json.dumps({"json": {"id": "s1", "type": "Set", "about": [{"id": "r1", "type": "Person", "created_by": {"influenced_by": [{"id": "p1", "type": "Place"}]}}], "classified_as": [{"id": "c1"}], "containing": [{"id": "r2"}], "created_by": {"carried_out_by": [{"id": "r1"}]}}, "vectors": {"main": [0.5, 1, 2]}}),
        "not json", '{"json": {}}', "",
    ]
    path = tmp_path_factory.mktemp("records") / "a.jsonl.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    good, corrupt = R.read_records(spark, str(path))
    assert sorted(r.value for r in corrupt.collect()) == ["not json", '{"json": {}}']
    return good.cache()


def test_load_and_slices(docs):
    got = {r.uri: r for r in R.assign_slices(docs).collect()}
    assert got["r1"].collections == ["yuag", "ypm", "all"] and got["r1"].readers == ["yuag-reader", "ypm-reader"] and got["s1"].collections == ["all"]


def test_fields_are_typed_and_bad_values_left_out(docs):
    spec = [R.FieldSpec("name", ("json.identified_by.content",)), R.FieldSpec("height", ("json.height",), "number"), R.FieldSpec("born", ("json.born.timespan.begin_of_the_begin",), "date"), R.FieldSpec("about", ("json.about.id",), "id")]
    got = sorted((r.uri, r.field, r.v_str, r.v_long, r.v_float) for r in R.extract_fields(docs, spec).collect())
    assert got == sorted([("r1", "name", "Un", None, None), ("r1", "name", "One", None, None), ("r1", "name", "ID-1", None, None), ("r2", "name", "Zwei", None, None), ("r1", "height", None, None, 12.5), ("r1", "born", None, -1893456000, None), ("r2", "about", "r1", None, None), ("s1", "about", "r1", None, None)])


def test_triples_and_vectors(docs):
    assert {tuple(r)[:3] for r in R.record_triples(docs).collect()} == {("r1", "knows", "r1"), ("r2", "knows", "r1")}
    got = {tuple(r)[:3] for r in R.set_triples(docs, {"agent": ["Person"], "place": ["Place"], "reference": ["Person"]}).collect()}
    assert got == {("s1", "about_or_depicts_agent", "r1"), ("s1", "about_or_depicts_place", "p1"), ("s1", "setClassifiedAs", "c1"), ("r2", "member_of", "s1"), ("s1", "agentOfCreation", "r1")}
    assert [r.main for r in R.vector_view(docs, 3).collect()] == [[0.5, 1.0, 2.0]]
    with pytest.raises(Exception, match="right length"):
        R.vector_view(docs, 4).collect()


def test_export_import_drop(docs, tmp_path):
    d = R.assign_slices(docs)
    R.export_slice(d, ["ypm"], str(tmp_path / "x"))
    left = R.drop_slice(d, ["ypm"])
    assert [r.uri for r in left.collect()] == ["s1"]
    assert sorted(r.uri for r in R.import_slice(left, str(tmp_path / "x")).collect()) == ["r1", "r2", "s1"]


def test_profiles(docs):
    name = lambda lang: {r.id: r.name for r in D.profile(docs, "name", lang).collect()}
    assert name("fr") == {"r1": "Un", "r2": "Zwei", "s1": None} and name("de")["r1"] == "One" and name(None)["r1"] == "One"
    assert {r.id: r.identifiers for r in D.profile(docs, "location").collect()}["r1"] == ["ID-1"]
    assert D.profile(docs, None).columns == docs.columns and set(D.profile(docs, "rights").columns) == {"id", "type", "subject_to"}
    assert {r.id: r.classified_as for r in D.profile(docs, "relationship").collect()}["s1"] == ["c1"]
    with pytest.raises(ValueError):
        D.profile(docs, "nonsense")


def test_merge(spark):
    a = spark.createDataFrame([("x", [1], "n"), ("y", None, None)], "uri string, l array<int>, s string")
    b = spark.createDataFrame([("x", [2], "n", 5), ("z", [3], "m", 6)], "uri string, l array<int>, s string, k int")
    assert sorted(map(tuple, D.merge_profiles(a, b).collect())) == [("x", [1, 2], "n", 5), ("y", None, None, None), ("z", [3], "m", 6)]
    with pytest.raises(Exception, match="two values"):
        D.merge_profiles(a, b.withColumn("s", F.lit("other"))).collect()


def test_changes(spark):
    schema = "uri string, username string, members array<string>, history array<struct<user: string, at: timestamp>>"
    base = spark.sql("select 's1' uri, 'ann' username, array('a') members, array(struct('ann' as user, timestamp'2024-01-01 00:00:05' as at)) history union all select 's2', 'bob', array('b'), array(struct('bob', timestamp'2024-01-01 00:00:00'))").to(spark.createDataFrame([], schema).schema)
    change = spark.sql("select 's1' uri, 'ann' username, array('x', 'x', 's1', 'y') members, timestamp'2024-01-01 00:00:05.7' at union all select null, 'eve', array('q'), timestamp'2024-02-01 00:00:00' union all select 's2', 'zed', array('c'), timestamp'2024-02-01 00:00:00'")
    got = {r.uri: r for r in D.apply_changes(base, change).collect()}
    assert got["s1"].members == ["x", "y"] and len(got["s1"].history) == 1
    assert got["s2"].username == "bob" and got["s2"].members == ["c"] and [h.user for h in got["s2"].history] == ["bob", "zed"]
    new = next(r for u, r in got.items() if u not in ("s1", "s2"))
    assert new.username == "eve" and new.uri.startswith("set/")


def test_delete_validate_visible(spark):
    docs = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", True, True)], "uri string, user_made boolean, is_default boolean")
    left, rejected = D.delete_records(docs, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "uri string"))
    assert sorted(r.uri for r in left.collect()) == ["b", "c"] and {r.uri for r in rejected.collect()} == {"b", "c", "d"}
    rows = [("ok", "Set", ["n"], ["x"], "l"), ("bad", "Thing", [], ["y" * 501] * 31, "l" * 201), ("null", None, None, None, None), ("long", "Person", ["n" * 201], [], None)]
    got = {}
    for r in D.violations(spark.createDataFrame(rows, "uri string, kind string, names array<string>, notes array<string>, label string")).collect():
        got.setdefault(r.uri, set()).add(r.rule)
    assert set(got) == {"bad", "null", "long"} and len(got["bad"]) == 5 and len(got["null"]) == 2 and len(got["long"]) == 1
    v = spark.createDataFrame([("a", ["s"], "ann"), ("b", ["s"], None), ("c", ["t"], None)], "uri string, collections array<string>, username string")
    assert {r.uri: r.seen_as for r in D.visible(v, ["s"], "bob").collect()} == {"a": "name", "b": "record"}


def test_sub_trees(spark):
    doc = {"json": {"id": "x", "produced_by": {"part": [{"carried_out_by": [{"id": "a"}]}, {"carried_out_by": [{"id": "b"}]}], "took_place_at": [{"id": "p"}]}, "classified_as": [{"id": "fr", "classified_as": [{"id": "n1", "equivalent": [{"id": "nationality"}]}]}, {"id": "z"}]}}
    row = spark.createDataFrame([(json.dumps(doc),)], "json string").select(
        D.sub_tree(F.col("json"), "produced_by").alias("by"), D.sub_tree(F.col("json"), "produced_at").alias("at"), D.sub_tree(F.col("json"), "birth_place").alias("born"),
        D.classified_with(F.col("json"), "nationality").alias("nat"), D.classified_with(F.col("json"), "gender").alias("gen"),
    ).first()
    assert [x["id"] for part in json.loads(row.by) for x in (part if isinstance(part, list) else [part])] == ["a", "b"]
    assert json.loads(row.at)[0]["id"] == "p" and row.born is None and row.nat == ["fr"] and row.gen == []
    kept = spark.createDataFrame([('{"b": "x\\"y", "a": 1, "c": [1, 2], "d": true}',)], "j string").select(D.keep_properties(F.col("j"), ["c", "b", "zz", "a"])).first()[0]
    assert json.loads(kept) == {"c": [1, 2], "b": 'x"y', "a": 1} and list(json.loads(kept)) == ["c", "b", "a"]


def test_fields_are_read_in_one_pass(spark, tmp_path):
    rows = [
        ("a", '{"json": {"n": [{"c": "x"}, {"c": ["y", "x"]}], "d": {"n": 2.5, "t": "1999-01-01T00:00:00Z"}, "o": {"k": 1}}}'), ("b", '{"json": {"n": {"c": null}, "d": [{"n": "7"}, {"n": "seven"}]}}'), ("c", "no JSON"), ("d", None),
    ]
    spark.createDataFrame(rows, "uri string, json string").write.parquet(str(tmp_path / "r"))
    docs = spark.read.parquet(str(tmp_path / "r"))
    spec = [R.FieldSpec("name", ("json.n.c",)), R.FieldSpec("number", ("json.d.n", "json.o.k"), "number"), R.FieldSpec("day", ("json.d.t",), "date"), R.FieldSpec("object", ("json.o",))]
    got = sorted(((r.uri, r.field, r.v_str, r.v_long, r.v_float) for r in R.extract_fields(docs, spec).collect()), key=repr)
    assert got == sorted([
        ("a", "name", "x", None, None), ("a", "name", "y", None, None), ("a", "number", None, None, 2.5), ("a", "number", None, None, 1.0), ("a", "day", None, 915148800, None), ("a", "object", '{"k":1}', None, None), ("b", "number", None, None, 7.0),
    ], key=repr)
    many = R.extract_fields(docs, [R.FieldSpec(f"f{i}", (f"json.n.c{i % 7}.d{i}", "json.o.k")) for i in range(50)])
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and "Exchange" not in plan
    assert many.count() == 50
