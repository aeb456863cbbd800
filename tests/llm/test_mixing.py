import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import n_words
from tessera.llm.mixing import mix, mixed_copies, source_targets


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, passes=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, capped = share * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(passes * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > passes * sizes[s]}
        if not over:
            return {s: passes * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_targets_match_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 500, "c": 90, None: 40}, {"a": 1, "b": 1, "c": 1}, {"z": 7}, {"a": 0, "b": 5}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def brute_times(rows, sizes, target):
    """rows: (doc_id, source, size, n). Servings in order of finish time until the budget is spent, equal times together."""
    queue, finish = [], {}
    for s in sizes:
        at = 0
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or -1, r[2]))
        for r in mine:
            at += r[2] * r[3]
            finish[r] = [(at + p * sizes[s]) / target[s] if target[s] else 0.0 for p in (0, 1)]
            if r[2]:
                queue += [(f, r[2] * r[3]) for f in finish[r]]
    budget, spent, cut = sum(target.values()), 0, -1.0
    for f in sorted({f for f, _ in queue}):
        spent += sum(n for g, n in queue if g == f)
        if spent > budget:
            break
        cut = f
    return {r: sum(f <= cut for f in fs) for r, fs in finish.items()}


def test_servings_match_brute_force(spark, messy, small):
    for docs in (messy, small):
        sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        counts, sizes = defaultdict(int), defaultdict(int)
        for r in sized.collect():
            counts[tuple(r)] += 1
            sizes[r.source] += r["size"]
        rows = [(*k, n) for k, n in counts.items()]
        want = brute_times(rows, sizes, brute_targets(dict(sizes)))
        got = {(r.doc_id, r.source, r["size"], r.n_rows): r.times for r in mix(docs, spark, n_words(F.col("text"))).collect()}
        assert {k: v for k, v in got.items() if k[2]} == {k: v for k, v in want.items() if k[2]}


def test_copies_and_reruns(spark, messy):
    one = sorted(map(repr, mixed_copies(messy, spark, n_words(F.col("text"))).collect()))
    two = sorted(map(repr, mixed_copies(messy.repartition(5), spark, n_words(F.col("text"))).collect()))
    assert one == two
    assert mixed_copies(messy, spark, n_words(F.col("text"))).columns == messy.columns


def test_empty_and_wordless_tables(spark, messy, nothing):
    assert mix(nothing, spark, n_words(F.col("text"))).count() == 0
    blank = messy.withColumn("text", F.lit(" "))
    assert {r.times for r in mix(blank, spark, n_words(F.col("text"))).collect()} <= {0, 1, 2}
