import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_dedup, exact_groups, merge_runs


def brute(rows):
    """(doc_id, keep_id, group_size, kept count, sha) as a multiset of rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = False
        for m in members:
            first = m == keep and not kept
            kept |= first
            out.append((m[0], keep[0], len(members), first, sha))
    return sorted(out, key=repr)


def test_groups_match_brute_force(spark, messy, small):
    for docs in (messy, small):
        want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
        got = sorted((tuple(r) for r in exact_groups(docs, spark).collect()), key=repr)
        assert got == want


def test_empty_table(spark, nothing):
    assert exact_groups(nothing, spark).count() == 0
    assert exact_dedup(nothing, spark).count() == 0


def test_filter_keeps_one_row_and_all_columns(spark, messy):
    kept = exact_dedup(messy, spark)
    assert kept.columns == messy.columns
    want = sum(r[3] for r in brute([tuple(r) for r in messy.select("doc_id", "text").collect()]))
    assert kept.count() == want
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(8) == 1 and None in ids and 2 in ids and 1 not in ids


def test_same_id_with_shorter_and_longer_spacing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a  b"), (2, "ab")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup(docs, spark).collect()] == [(1, "a  b")]


def test_many_runs_need_several_rounds(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('t', id % 7, repeat(' ', cast(id % 5 as int))) as text").repartition(40)
    want = brute([tuple(r) for r in docs.collect()])
    from tessera.llm import exact_dedup as e

    digests = e._digests(docs, "doc_id", "text")
    merged = {r.digest: (r.best.id, r.copies) for r in merge_runs(digests, spark, fan_in=2).collect()}
    assert merged == {w[4]: (w[1], w[2]) for w in want}


def test_keys_that_span_batches_are_counted_once():
    import pyarrow as pa

    from tessera.llm.exact_dedup import _first_of_each

    digests = ["a", "a", "b", "b", "b", "b", "c", "d", "d"]
    rows = [{"digest": d, "check": 1, "n_bytes": 1, "run": 0, "slice": 0, "id": i, "tag": {"file": 1, "row": i}, "copies": i + 1} for i, d in enumerate(digests)]
    for size in range(1, len(rows) + 1):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)]
        out = [r for b in _first_of_each(iter([batches[0][:0], *batches])) for r in b.to_pylist()]
        assert [(r["digest"], r["id"], r["tag"]["row"], r["copies"]) for r in out] == [("a", 0, 0, 3), ("b", 2, 2, 18), ("c", 6, 6, 7), ("d", 7, 7, 17)]


def test_a_digest_is_once_in_each_merged_run(spark):
    from tessera.llm import exact_dedup as e

    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) as text").repartition(20)
    merged = e.merge_runs(e._digests(docs, "doc_id", "text"), spark, fan_in=4)
    assert merged.count() == merged.select("digest").distinct().count()
    assert merged.agg({"copies": "sum"}).first()[0] == 3000 and merged.filter("copies >= 1000").count() == 1


def test_rows_of_files_are_told_apart_without_a_copy(spark, messy, tmp_path):
    from tessera.llm.common import tagged
    from tessera.llm.simhash import near_dedup

    messy.repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows, tag = tagged(docs, spark)
    assert rows.select(tag).distinct().count() == docs.count() and "file" in rows.schema[tag].dataType.names
    for operator in (exact_dedup, near_dedup):
        kept = operator(docs, spark)
        assert kept.columns == docs.columns
        assert kept.count() == operator(messy, spark).count()


def test_rows_made_of_one_stored_row_are_rows_of_their_own(spark, tmp_path):
    """Exploded, united and joined frames repeat the place in the file that they come from."""
    from tessera.llm.common import tagged
    from tessera.llm.simhash import near_dedup

    spark.createDataFrame([(1, ["a b", "c d", "c  d"], 2)], "id long, texts array<string>, times int").write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    exploded = stored.select("id", F.explode("texts").alias("text"), "times").select(F.expr("xxhash64(text)").alias("doc_id"), "text", F.explode(F.sequence(F.lit(1), "times")).alias("i")).drop("i")
    one = stored.select(F.col("id").alias("doc_id"), F.element_at("texts", 1).alias("text"))
    frames = {"exploded": (exploded, 2), "united": (one.union(one), 1), "joined": (one.alias("x").join(one.alias("y"), "doc_id").select("doc_id", "x.text"), 1), "cross rows": (one.union(exploded), 2)}
    for name, (docs, want) in frames.items():
        assert tagged(docs, spark)[0].count() == docs.count(), name
        assert exact_dedup(docs, spark).count() == want, name
        assert near_dedup(docs.filter("text <> 'a b'") if name == "exploded" else docs.limit(100), spark).count() == (1 if name != "cross rows" else near_dedup(spark.createDataFrame(docs.collect(), docs.schema), spark).count()), name
