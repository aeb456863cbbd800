import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as T
from tessera.llm.quality import remainder


def random_examples(rng, n, terms):
    ids = [sorted(rng.choice(terms, int(rng.integers(0, 6)), replace=False).tolist()) for _ in range(n)]
    tfs = [rng.integers(1, 4, len(x)).tolist() for x in ids]
    start = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return T.Examples(list(range(n)), rng.integers(0, 2, n).astype(float), start, np.array(sum(ids, [])), np.array(sum(tfs, [])))


def rows_of(e):
    return [(i, e.term[a:b], e.tf[a:b]) for i, a, b in zip(e.ids, e.start, e.start[1:])]


def test_nearest_are_those_of_all_comparisons():
    rng = np.random.default_rng(5)
    terms = 40
    idf = 1 + rng.random(terms)
    examples = random_examples(rng, 900, terms)
    index = T.build_index(examples, idf, 2.0)
    place = {d: i for i, d in enumerate(index.ids)}

    def vector(ids, tfs):
        v = np.zeros(terms)
        v[ids] = (1 + np.log(tfs)) * index.factor[ids]
        return v / (np.linalg.norm(v) or 1)

    held = [(d, vector(ids, tfs)) for d, ids, tfs in rows_of(examples)]
    for _, ids, tfs in rows_of(random_examples(rng, 60, terms)):
        if len(ids):
            q = vector(ids, tfs)
            want = sorted((-round(float(q @ v), 9), place[d]) for d, v in held if q @ v > 0)[: T.K]
            cos, at = index.nearest(ids, tfs)
            assert [-c for c, _ in want] == [round(float(c), 9) for c in cos]
            assert len(set(at.tolist())) == len(at)


def brute_scores(texts, labels, learn):
    """The whole operator by comparing every document with every example. texts: {id: text}; labels: {id: label}."""
    counts = {i: Counter(T.words(t)) for i, t in texts.items()}
    df = Counter(w for c in counts.values() for w in c)
    n = len(texts)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}

    def scorer(train):
        rate = (sum(labels[i] for i in train) + 0.5) / (len(train) + 1)
        seen, toxic = Counter(w for i in train for w in counts[i]), Counter(w for i in train if labels[i] for w in counts[i])
        factor = {w: idf[w] * max(T.FLOOR, abs(math.log((toxic[w] + T.SHRINK * rate) / (seen[w] + T.SHRINK) / rate))) ** T.SHARPNESS for w in seen}
        every = {w for i in learn for w in counts[i]}

        def vector(i):
            v = {w: (1 + math.log(k)) * (factor[w] if w in factor else T.FLOOR**T.SHARPNESS * (idf[w] if w in every else math.log(1 + n) + 1)) for w, k in counts[i].items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            return {w: x / norm for w, x in v.items()}

        held = {i: vector(i) for i in train}

        def vote(i):
            q = vector(i)
            cos = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), labels[j]) for j, v in held.items()), reverse=True)[: T.K]
            return (sum(c**T.POWER * y for c, y in cos) + T.PRIOR * rate) / (sum(c**T.POWER for c, _ in cos) + T.PRIOR)

        return vote

    return scorer


def test_scores_match_brute_force(spark, small, labels):
    texts = {r.doc_id: r.text for r in small.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    fold_of = {r[0]: r[1] for r in small.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(T.FOLDS))).collect()}
    learn = [i for i in known if i in texts and zlib.crc32(str(i).encode()) % 5]
    scorer = brute_scores(texts, known, learn)
    votes, ys = [], []
    for f in range(T.FOLDS):
        vote = scorer([i for i in learn if fold_of[i] != f])
        for i in learn:
            if fold_of[i] == f:
                votes.append(vote(i))
                ys.append(float(known[i]))
    x, p = T.isotonic(np.array(votes), np.array(ys))
    final = scorer(learn)
    got = {r.doc_id: r for r in T.op1_toxicity(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    for i in texts:
        v = final(i)
        assert abs(got[i].score - min(1, max(0, 0.99 * np.interp(v, x, p) + 0.01 * v))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(0)
    v = rng.random(3000)
    y = (rng.random(3000) < v).astype(float)
    x, p = T.isotonic(v, y)
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()
    assert abs(np.interp(v, x, p) - v).mean() < 0.06


def test_every_row_is_scored(spark, messy, nothing, labels):
    learn = remainder("doc_id", 5) != 0
    rows = T.toxicity_scores(messy, labels, spark, learn).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.toxicity_scores(nothing, labels, spark, learn).count() == 0
    assert T.toxicity_scores(messy, labels.limit(0), spark, learn).select("score").distinct().count() == 1
    named = messy.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert T.toxicity_scores(named, labels.withColumn("doc_id", F.col("doc_id").cast("string")), spark, learn).count() == messy.count()


def test_examples_among_messy_rows(spark, messy):
    """Labels of the messy rows themselves: repeated rows, a null id, empty and null texts are examples."""
    labels = messy.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, 1).otherwise(0).alias("toxic"))
    rows = T.toxicity_scores(messy, labels, spark, F.lit(True)).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert any(r.evidence for r in rows if r.doc_id == 9)


def test_held_out_accuracy_and_evidence(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = T.op1_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").cache()
    toxic, clean = got.filter("toxic = 1"), got.filter("toxic = 0")
    assert toxic.filter("predicted = 1").count() >= 0.9 * toxic.count()
    assert clean.filter("predicted = 1").count() < 0.02 * clean.count()
    assert toxic.agg(F.avg("score")).first()[0] > 5 * clean.agg(F.avg("score")).first()[0]
    learned = {r[0] for r in labels.filter(remainder("doc_id", 5) != 0).select("doc_id").collect()}
    used = {r[0] for r in got.select(F.explode("evidence.id")).distinct().collect()}
    assert used and used <= learned
    got.unpersist()
