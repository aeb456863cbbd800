import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives as N


def plain(rows, anchors, n_positives=5, n_negatives=3, low=50, high=95):
    """Every score, for rows (id, label, vector)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    out = []
    for a, anchor in enumerate(rows):
        if anchor[0] is None or not anchors(anchor[0]):
            continue
        scored = sorted(((-int(sum(x * y for x, y in zip(anchor[2], r[2], strict=False))), r[0] is None, r[0] or 0, i) for i, r in enumerate(rows) if i != a))
        positives = [s for s in scored if rows[s[3]][1] == anchor[1]][:n_positives]
        for p in positives:
            fit = [s for s in scored if rows[s[3]][1] != anchor[1] and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(anchor[0], rows[p[3]][0], k, rows[s[3]][0], -p[0], -s[0]) for k, s in enumerate(fit[:n_negatives], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>, score string, block string").repartition(3)


@pytest.mark.parametrize(("block", "group"), [(7, 2), (64, 100)])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_scores_agree(spark, block, group, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 12)) * 20
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.floor(centres[rng.integers(4)] + rng.normal(size=12) * 6)], "x", "y") for i in range(150)]
    got = rows_of(N.hard_negatives(frame(spark, rows), spark, F.col("vec_id") % 5 == 0, block=block, group=group))
    assert got == plain(rows, lambda i: i % 5 == 0) and got


def test_odd_rows(spark):
    rows = [
        (0, 1, [3.0, 4.0], "", ""), (0, 1, [3.0, 4.0], "", ""), (1, 1, [3.0, 4.0], "", ""), (2, 2, [2.0, 2.0], "", ""), (3, 2, [2.0, 2.0, 9.0], "", ""), (3, 2, [2.0, 2.0], "", ""),
        (None, 2, [2.0, 2.0], "", ""), (None, 1, [1.0, 1.0], "", ""), (5, None, [9.0, 9.0], "", ""), (6, 2, None, "", ""), (7, 2, [float("nan"), 1.0], "", ""), (8, 2, [None, 1.0], "", ""),
        (9, 2, [], "", ""), (10, 1, [0.0, 0.0], "", ""), (11, 1, [-3.0, -4.0], "", ""), (12, 2, [float("inf"), 1.0], "", ""),
    ]
    got = rows_of(N.hard_negatives(frame(spark, rows), spark, F.col("vec_id") % 5 == 0))
    assert got == plain(rows, lambda i: i % 5 == 0) and got
    assert N.hard_negatives(frame(spark, rows).limit(0), spark, F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_leave_rows_out():
    """At a high threshold the index holds few dimensions, and reach() still finds every pair."""
    rng = np.random.default_rng(3)
    y = np.floor(rng.normal(size=(400, 32)) * np.geomspace(60, 1, 32))
    index = N.Index(y, y[:20])
    scores = y[:20] @ y.T
    for share in (0.9, 0.5, 0.0, -1.0):
        t = share * index.x_norms[:, -1] * index.y_norms[:, -1].max()
        i, j, s = index.reach(np.arange(20), t)
        want = np.nonzero(scores >= t[:, None])
        assert sorted(zip(i, j, s, strict=True)) == sorted(zip(*want, scores[want], strict=True))


def test_too_large():
    with pytest.raises(ValueError):
        N.Index(np.full((1, 2), 1e9), np.full((1, 2), 1e9))


def test_query_agrees_with_all_scores(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [math.floor(256 * x) for x in r.embedding]))
    assert rows_of(N.op12_hard_negatives(spark, sf_dir)) == plain(rows, lambda i: i % 50 == 0)
