import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import related as R
from tessera.operators import similar as S
from tessera.operators.complete import complete_names


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("i1", "made", "a1"), ("i2", "made", "a1"), ("i1", "class", "c1"), ("i2", "class", "c1"), ("i2", "class", "c1"), ("i2", "class", "c2"), ("w1", "by", "a1"), ("i1", "shows", "w1"), ("i1", "shows", "w1"), ("a1", "class", "a1")]
    return spark.createDataFrame([(*r, r[0]) for r in rows], "subject string, predicate string, object string, src_uri string")


def test_related_counts(spark, triples):
    paths = [("p-c", "made", False, "class", True), ("w-i", "by", False, "shows", False)]
    start = spark.createDataFrame([("a1",), ("zz",)], "uri string")
    got = {(r.uri, r.key): (r.n, r.total) for r in R.related(triples, paths, start).collect()}
    assert got == {("c1", "p-c"): (3, 3), ("c2", "p-c"): (1, 1), ("i1", "w-i"): (1, 1)}
    assert {(r.uri) for r in R.related(triples, paths, start, cap=1).collect()} == {"c1", "i1"}
    assert [r.uri for r in R.related_page(R.related(triples, paths, start), 1, 2).collect()] == ["c1", "c2"]
    assert {r.start: r.related for r in R.has_related(triples, paths, start).collect()} == {"a1": True, "zz": False}
    assert sorted(r.uri for r in R.connecting(triples, paths[0], "a1", "c1").collect()) == ["i1", "i2"]


def test_audits(spark, triples):
    docs = spark.createDataFrame([("i1", "Item"), ("a1", "Agent"), ("c1", "Type")], "uri string, data_type string")
    dead = {(r.predicate, r.object): r.sources for r in A.dead_ends(triples, docs).collect()}
    assert dead == {("class", "c2"): 1, ("shows", "w1"): 1}
    assert {r.predicate: r.records for r in A.predicate_coverage(triples, ["made", "none"]).collect()} == {"made": 2, "none": 0}
    assert [r.predicate for r in A.predicate_coverage(triples, ["made", "none"], True).collect()] == ["none"]
    a, b = (spark.createDataFrame(x, "key string, n long") for x in ([("x", 3), ("y", 1)], [("x", 5), ("z", 2)]))
    assert {r.key: r.change for r in A.count_difference(a, b).collect()} == {"x": 2, "y": -1, "z": 2}
    assert {tuple(r) for r in A.difference(a, b, "key").collect()} == {("y", "left"), ("z", "right")}
    assert {r.predicate: r.data_types for r in A.types_per_predicate(triples, docs).collect()}["class"] == "Agent,Item"
    reach = {(r.uri, r.hops, r.visible) for r in A.reachable(triples.withColumn("predicate", F.lit("p")), "p", spark.createDataFrame([("i1",)], "uri string"), 3, docs).collect()}
    assert reach == {("a1", 1, True), ("c1", 1, True), ("w1", 1, False)}
    assert tuple(A.routes_agree(docs.select("uri"), docs.limit(3).select("uri")).first()) == (3, 3, 3, True)
    assert tuple(A.false_positives(docs, docs.filter("uri <> 'i1'")).first()) == (3, 1)


def test_similar(spark):
    f = spark.createDataFrame([("a", "t", "x"), ("b", "t", "x"), ("c", "t", "y"), ("a", "n", "m"), ("c", "n", "m"), ("b", "n", "q")], "uri string, field string, v_str string")
    v = S.aspect_values(f, {"type": (["t"], 1.0, True), "name": (["n"], 5.0, False)})
    got = [(r.uri, r.score) for r in S.similar(v, spark.createDataFrame([("a",)], "uri string")).collect()]
    assert got == [("b", 1.0)]
    words = spark.createDataFrame([("a", "t", "alpha alpha beta THE gamma delta eps zeta the the")], "uri string, field string, v_str string")
    assert [(r.word, r.n) for r in S.top_words(words, ["t"]).orderBy("rank").collect()] == [("alpha", 2), ("beta", 1), ("delta", 1), ("gamma", 1), ("zeta", 1)]


@pytest.mark.parametrize("mandatory", [False, True])
def test_similar_agrees_with_all_pairs(spark, mandatory):
    """With values that all records share, values of half of them, and rare ones; only rare values may open records."""
    import random

    rng = random.Random(7)
    rows = []
    for i in range(120):
        own = {("a", rng.choice("xyz"), 1.0, mandatory), ("b", f"b{rng.randrange(40)}", 3.0, False), ("c", f"c{rng.randrange(9)}", 0.5, mandatory), ("type", "T", 1.0, False)}
        rows += [(f"r{i:03}", *v) for v in own if v[0] == "type" or rng.random() < 0.8]
    values = spark.createDataFrame(rows, "uri string, aspect string, value string, weight double, mandatory boolean").repartition(4)
    seeds = [f"r{i:03}" for i in range(0, 120, 7)]
    of = {}
    for u, a, v, w, m in rows:
        of.setdefault(u, {})[a, v] = (w, m)
    want = set()
    for s in seeds:
        needed = {a for (a, _), (_, m) in of[s].items() if m}
        scored = []
        for u in of:
            both = of[s].keys() & of[u].keys()
            if u != s and both and {a for a, v in both if of[s][a, v][1]} == needed:
                scored.append((-sum(of[s][p][0] for p in both), u))
        want |= {(s, u, -n, r) for r, (n, u) in enumerate(sorted(scored)[:5], 1)}
    frame = spark.createDataFrame([(u,) for u in seeds], "uri string")
    for rare in (0, 6, 50, 1000):
        got = S.similar(values, frame, 5, rare)
        assert {(r.seed, r.uri, r.score, r["rank"]) for r in got.collect()} == want, rare
    split = {(r.aspect, r.value): r.common for r in S.split_by_frequency(values, values, 50).collect()}
    assert split["type", "T"] and not split["b", rows[0][2] if rows[0][1] == "b" else "b1"]


def test_values_of_all_records_open_none(spark):
    """2,000 records share one value, and all are seeds: 4,000,000 pairs, of which each seed is compared with a few."""
    rows = [(f"r{i:05}", "type", "T") for i in range(2000)] + [(f"r{i:05}", "name", f"n{i // 2}") for i in range(2000)]
    values = spark.createDataFrame([(*r, 1.0, False) for r in rows], "uri string, aspect string, value string, weight double, mandatory boolean")
    seeds = values.select("uri").distinct()
    got = S.similar(values, seeds, 3, 100)
    best = {(r.seed, r["rank"]): r.uri for r in got.collect()}
    assert best["r00000", 1] == "r00001" and best["r00000", 2] == "r00002" and best["r01999", 1] == "r01998" and best["r01999", 2] == "r00000" and len(best) == 6000


def test_reserved_aspect(spark):
    f = spark.createDataFrame([("a", "n", "m"), ("b", "n", "m"), ("c", "n", "m")], "uri string, field string, v_str string")
    docs = spark.createDataFrame([("a", "Person"), ("b", "Group"), ("c", "Person"), ("d", "Person")], "uri string, data_type string")
    spec, seed = {"name": (["n"], 2.0, False)}, spark.createDataFrame([("a",)], "uri string")
    assert [(r.uri, r.score) for r in S.similar(S.aspect_values(f, spec, docs), seed).orderBy("rank").collect()] == [("c", 3.0), ("b", 2.0), ("d", 1.0)]
    assert [(r.uri, r.score) for r in S.similar(S.aspect_values(f, spec, docs, type_mandatory=True), seed).orderBy("rank").collect()] == [("c", 3.0), ("d", 1.0)]


@pytest.mark.parametrize("forward", [True, False])
def test_capped_relations_agree_with_all_of_them(spark, forward):
    import random
    from collections import Counter, defaultdict

    rng = random.Random(11)
    first = {(f"s{rng.randrange(25):02}", rng.choice(["hub1", "hub2", "hub3", *[f"m{i}" for i in range(12)]])) for _ in range(90)}
    second = [(m, f"s{e:02}" if rng.random() < 0.5 else f"e{e:02}") for m in ("hub1", "hub2", "hub3") for e in range(30) for _ in range(rng.randrange(3))] + [(f"m{rng.randrange(12)}", f"e{rng.randrange(30):02}") for _ in range(60)]
    t = [(s, "one", m) for s, m in first] + [(m, "two", e) if forward else (e, "two", m) for m, e in second]
    frame = spark.createDataFrame(t, "subject string, predicate string, object string").repartition(3)
    counts = defaultdict(Counter)
    for s, m in first:
        for m2, e in second if forward else set(second):
            if m == m2 and e != s:
                counts[s][e] += 1
    for cap in (1, 3, 100):
        want = set()
        for s, c in counts.items():
            ranked = sorted(((-n if forward else -1, e) for e, n in c.items()))[:cap]
            want |= {(s, e, -n) for n, e in ranked}
        for heavy in (0, 4, 15, 1000):
            got = R.related(frame, [("k", "one", True, "two", forward)], spark.createDataFrame([(s,) for s in counts], "uri string"), cap, heavy)
            assert {(r.start, r.uri, r.n) for r in got.collect()} == want, (cap, heavy)
    every = R.related(frame, [("k", "one", True, "two", forward)], spark.createDataFrame([(s,) for s in counts], "uri string"))
    assert {(r.start, r.uri, r.n) for r in every.collect()} == {(s, e, n if forward else 1) for s, c in counts.items() for e, n in c.items()}


@pytest.mark.parametrize("few", [0, 1000])
def test_relations_of_some_starts_agree_with_all_pairs(spark, monkeypatch, few):
    """Middles with many starts or many ends, starts that aren't asked, duplicates, and an end that two paths lead to."""
    import random
    from collections import Counter

    monkeypatch.setattr(R, "HEAVY", 5)
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "BUCKETS", 4)
    rng = random.Random(5)
    mids = ["hub1", "hub2", *[f"m{i}" for i in range(15)]]
    first = [(f"s{rng.randrange(20):02}", rng.choice(mids[: rng.choice([2, 17])])) for _ in range(120)]
    second = [(rng.choice(mids[1 : rng.choice([2, 17])]), rng.choice([f"e{rng.randrange(20)}", f"s{rng.randrange(20):02}"])) for _ in range(150)]
    t = [(m, "made", s) for s, m in first] + [(m, "class", e) for m, e in second] + [(e, "shows", m) for m, e in second]
    frame = spark.createDataFrame(t, "subject string, predicate string, object string").repartition(3)
    asked = {f"s{i:02}" for i in range(0, 20, 3)} | {"none"}
    want = Counter()
    for s, m in set(first):
        for m2, e in second:
            if m == m2 and s in asked and e != s:
                want[s, e, "to"] += 1
                want[s, e, "back"] = 1
    paths = [("to", "made", False, "class", True), ("back", "made", False, "shows", False)]
    got = R.related(frame, paths, spark.createDataFrame([(s,) for s in asked], "uri string")).collect()
    assert {(r.start, r.uri, r.key): r.n for r in got} == dict(want) and len(got) == len(want)
    assert all(r.total == want[r.start, r.uri, "to"] + 1 for r in got)


def test_related_exchanges_each_hop_once(spark, triples, monkeypatch):
    monkeypatch.setattr(R, "FEW", 0)
    paths = [("p-c", "made", False, "class", True), ("w-i", "by", False, "shows", False)]
    for cap, most in ((None, 5), (1, 9)):  # a hop each, and one by start and end; with a cap by path, and then by start
        plan = R.related(triples, paths, spark.createDataFrame([("a1",)], "uri string"), cap)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, plan


def test_a_middle_with_many_starts_and_ends(spark):
    """10^5 starts and 10^5 ends meet in one middle: 10^10 pairs, of which none but the capped ones is made."""
    n = 100_000
    ids = spark.range(n).select(F.format_string("%06d", "id").alias("i"))
    t = ids.select(F.concat(F.lit("s"), "i").alias("subject"), F.lit("one").alias("predicate"), F.lit("hub").alias("object"))
    t = t.union(ids.select(F.lit("hub"), F.lit("two"), F.concat(F.lit("e"), "i"))).union(ids.filter("i < '000003'").select(F.lit("hub"), F.lit("two"), F.lit("e099999")))
    got = R.related(t, [("k", "one", True, "two", True)], ids.select(F.concat(F.lit("s"), "i").alias("uri")), cap=3)
    assert [tuple(r) for r in got.groupBy("uri", "n").count().orderBy(F.desc("n"), "uri").collect()] == [("e099999", 4, n), ("e000000", 1, n), ("e000001", 1, n)]


def test_completion(spark):
    rows = [("p1", "placePrimaryName", "New Haven"), ("p1", "placePrimaryName", "Nouveau"), ("p2", "placePrimaryName", "Havana"), ("p3", "placePrimaryName", "Paris"), ("p3", "placeName", "Haven of light"), ("x", "usedAt", "p1")]
    f = spark.createDataFrame(rows, "uri string, field string, v_str string")
    assert [tuple(r) for r in complete_names(f, "placePrimaryName", "hav").collect()] == [("p2", "Havana"), ("p1", "New Haven | Nouveau")]
    assert [r.uri for r in complete_names(f, "placePrimaryName", "hav", "usedAt").collect()] == ["p1"]
    assert [r.uri for r in complete_names(f, "placePrimaryName", "haven", alternatives=True).collect()] == ["p3"]


def test_nearest_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[11]
    v = spark.createDataFrame([(f"v{i:03}", r.tolist()) for i, r in enumerate(x)] + [("none", None)], "uri string, main array<float>").repartition(5)
    q = v.filter("uri like 'v%0'")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for i in range(0, 300, 10):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:5]
        want |= {(f"v{i:03}", f"v{j:03}", k + 1) for k, j in enumerate(order)}
    for block in (7, 2048):
        assert {(r.query, r.uri, r["rank"]) for r in S.nearest_vectors(v, q, 5, block).collect()} == want
    groups = np.repeat(rng.normal(size=(6, 8)) * 5, 50, axis=0) + rng.normal(size=(300, 8)) * 0.01  # tight groups: most pairs of blocks are skipped
    g = spark.createDataFrame([(f"v{i:03}", r.tolist()) for i, r in enumerate(groups)], "uri string, main array<double>").repartition(5)
    unit = groups / np.linalg.norm(groups, axis=1, keepdims=True)
    got = {(r.query, r["rank"]): r.uri for r in S.nearest_vectors(g, g, 3, 20).collect()}
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:3]
        assert [got[f"v{i:03}", k] for k in (1, 2, 3)] == [f"v{j:03}" for j in order]
    assert S.nearest_vectors(v, q.limit(0), 5).count() == 0 and S.nearest_vectors(v.limit(0), q, 5).count() == 0


def test_has_related_needs_another_record(spark):
    t = spark.createDataFrame([("a", "one", "m"), ("b", "one", "n"), ("c", "one", "o"), ("m", "two", "a"), ("n", "two", "b"), ("n", "two", "z")], "subject string, predicate string, object string")
    got = R.has_related(t, [("k", "one", True, "two", True)], spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "uri string"))
    assert {r.start: r.related for r in got.collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_a_long_cycle_ends_when_nothing_is_new(spark):
    """A cycle of 50 records with a chord: levels shrink to nothing long before 200 hops, and each record has its shortest way."""
    n = 50
    edges = [(f"r{i:02}", f"r{(i + 1) % n:02}") for i in range(n)] + [("r00", "r25")]
    t = spark.createDataFrame([(a, "p", b) for a, b in edges], "subject string, predicate string, object string").cache()
    got = {r.uri: r.hops for r in A.reachable(t, "p", spark.createDataFrame([("r00",)], "uri string"), 200).collect()}
    assert got == {f"r{i:02}": (i if i < 25 else i - 24) for i in range(1, n)} | {"r00": 26}


def test_name_index_gives_the_same_and_prunes(spark, tmp_path):
    from tessera.operators.complete import name_index, write_name_index

    names = [(f"p{i:03}", "placePrimaryName", f"{'abcdefghij'[i % 10]}ville New {'klmnopqrst'[i // 10 % 10]}haven {i}") for i in range(200)] + [("q", "placePrimaryName", "Café " + "long word " * 20 + "end"), ("x", "usedAt", "p001")]
    f = spark.createDataFrame(names, "uri string, field string, v_str string")
    write_name_index(name_index(f), str(tmp_path / "names"))
    index = spark.read.parquet(str(tmp_path / "names"))
    for prefix, context in (("khav", None), ("new k", None), ("bville", "usedAt"), ("haven", None), ("cafe", None), ("long word " * 8, None), ("nothing", None)):
        want = [tuple(r) for r in complete_names(f, "placePrimaryName", prefix, context).collect()]
        got = complete_names(f, "placePrimaryName", prefix, context, index=index)
        assert [tuple(r) for r in got.collect()] == want, prefix
    plan = got._jdf.queryExecution().toString()
    assert "StringStartsWith(start" in plan  # compared with the files' and row groups' statistics


def test_sketches_of_parts_merge(spark):
    f = spark.range(20_000).select(F.format_string("r%d", "id").alias("uri"), F.lit("f").alias("field"), F.format_string("v%d", F.col("id") % 5000).alias("v_str"), F.lit(None).cast("long").alias("v_long"), F.lit(None).cast("double").alias("v_float"))
    f = f.union(f.limit(500).withColumn("v_str", F.lit("hot")))
    merged = A.merged_sketches(A.field_sketches(f, (F.length("uri") % 2).cast("string")), 1).first()
    assert merged.n == 20_500 and abs(merged.distinct - 5001) < 250 and merged.top[0]["item"] == "hot" and abs(merged.top[0]["count"] - 500) <= 28


def test_similar_seeds_of_one_kind(spark):
    """Seeds that agree in their common values share a look for sets, and still leave themselves out of their own lists."""
    rows = [(f"r{i:02}", "type", f"t{i % 2}", 1.0, False) for i in range(20)] + [(f"r{i:02}", "name", f"n{i // 2}", 2.0, False) for i in range(20)]
    values = spark.createDataFrame(rows, "uri string, aspect string, value string, weight double, mandatory boolean")
    seeds = values.select("uri").distinct()
    got = {(r.seed, r.rank): (r.uri, r.score) for r in S.similar(values, seeds, 3, rare=5).collect()}
    for i in range(20):
        other = [(f"r{j:02}", (1.0 if i % 2 == j % 2 else 0.0) + (2.0 if i // 2 == j // 2 else 0.0)) for j in range(20) if j != i]
        want = sorted((o for o in other if o[1] > 0), key=lambda o: (-o[1], o[0]))[:3]
        assert [got[f"r{i:02}", n + 1] for n in range(3)] == want


def test_similar_dates_in_parts(spark, monkeypatch):
    """The pairs of a window that many records meet are made in several tasks, each pair once."""
    monkeypatch.setattr(S, "PAIRS", 10)
    year = lambda y: (y - 1970) * 31_557_600
    rows = [(f"r{i}", f, year(y)) for i in range(40) for f, y in (("s", 1500 if i % 2 else 1850), ("e", 2000 if i % 2 else 1900))]
    fields = spark.createDataFrame(rows, "uri string, field string, v_long long")
    seeds = spark.createDataFrame([(f"r{i}",) for i in range(0, 40, 10)], "uri string")
    df = S.similar_dates(fields, "s", "e", seeds)
    assert df.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, df.collect())) == sorted((f"r{i}", f"r{j}") for i in range(0, 40, 10) for j in range(1, 40, 2))
