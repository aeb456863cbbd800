import numpy as np
from pyspark.sql import functions as F

from tessera.llm.quality import FEATURES, features, fit, keep_good, quality_scores, remainder


def test_learns_steps_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    y = (x[:, 3] > 0.3).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(FEATURES)))
    m = fit(x, (x[:, 2] + x[:, 5] > 1).astype(float))
    row = x[7]
    bins = [int(np.searchsorted(e, v, side="right")) for e, v in zip(m.edges, row)]
    total = m.intercept + sum(t[b] for t, b in zip(m.tables, bins)) + sum(t[m.coarse[i][bins[i]], m.coarse[j][bins[j]]] for i, j, t in m.pairs)
    assert abs(m.score(x[7:8])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_no_rows_or_one_class():
    none = np.empty((0, len(FEATURES)))
    assert fit(none, np.empty(0)).score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]
    ones = fit(np.random.default_rng(0).random((20, len(FEATURES))), np.ones(20)).score(np.zeros((1, len(FEATURES))))
    assert 0.9 < ones[0] < 1


def test_features_of_any_text():
    for t in (None, "", " \n", "x", "日本語 🙂", "A" * 300_000, "a b " * 50_000):
        assert len(features(t)) == len(FEATURES) and np.isfinite(features(t)).all()


def test_every_row_is_scored(spark, messy, nothing, labels):
    learn = remainder("doc_id", 4) != 2
    rows = quality_scores(messy, labels, spark, learn).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(nothing, labels, spark, learn).count() == 0
    assert quality_scores(messy, labels.limit(0), spark, learn).select("score").distinct().count() == 1
    assert keep_good(messy, labels, spark, 0.0).count() == messy.count()
    assert keep_good(messy, labels, spark).columns == messy.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    from tessera.llm.quality import op3_quality

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op3_quality(spark, sf).filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    assert got[1] > 500 and got[0] > 0.97


def test_only_text_counts(spark, small, labels):
    learn = remainder("doc_id", 4) != 2
    other = small.withColumn("lang", F.lit("?")).withColumn("source", F.lit("?")).withColumn("n_chars", F.lit(0))
    a, b = ({tuple(r) for r in quality_scores(d, labels, spark, learn).collect()} for d in (small, other))
    assert a == b


def test_rows_are_judged_one_by_one(spark, small, labels):
    """Good and bad texts under one id, and under none: the bad ones go whatever else has their id."""
    learn = remainder("doc_id", 4) != 2
    score = {r.doc_id: r.score for r in quality_scores(small, labels, spark, learn).collect()}
    good, bad = ([i for i, s in score.items() if (s >= 0.7) == side][:5] for side in (True, False))
    assert good and bad
    for shared in (good[0], None):
        rows = small.filter(F.col("doc_id").isin(good + bad)).withColumn("doc_id", F.lit(shared).cast("long"))
        mixed = small.filter(~F.col("doc_id").isin(good + bad)).union(rows)
        kept = keep_good(mixed, labels, spark)
        wanted = {r.text for r in small.filter(F.col("doc_id").isin(good)).collect()}
        unwanted = {r.text for r in small.filter(F.col("doc_id").isin(bad)).collect()}
        texts = {r.text for r in kept.collect()}
        assert wanted <= texts and not (unwanted - {r.text for r in small.filter(F.col("doc_id").isin(*[i for i, s in score.items() if s >= 0.7])).collect()}) & texts
