import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_model as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = ""


def tokens_of(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(folded), END]


class Plain:
    """The model by counting tuples, without quantisation."""

    def __init__(self, texts, order=L.ORDER, smoothing=L.SMOOTHING):
        self.order, self.smoothing = order, smoothing
        self.counts = Counter()
        for tokens in map(tokens_of, texts):
            for n in range(1, order + 1):
                self.counts.update(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
        self.total = sum(n for g, n in self.counts.items() if len(g) == 1)
        self.known = sum(len(g) == 1 for g in self.counts)

    def p(self, context, word):
        if not context:
            return (self.counts[(word,)] + 1) / (self.total + self.known + 1)
        n = self.counts[context]
        return (self.counts[(*context, word)] + self.smoothing * self.p(context[1:], word)) / (n + self.smoothing)

    def score(self, text):
        tokens = tokens_of(text)
        base = sum(math.log10(self.p((), t)) for t in tokens)
        return len(tokens), sum(self.counts[(t,)] > 0 for t in tokens), base, sum(math.log10(self.p(tuple(tokens[max(0, i - self.order + 1) : i]), t)) for i, t in enumerate(tokens))


def close(got, rows, held, order=L.ORDER, smoothing=L.SMOOTHING):
    model = Plain([t for i, t in rows if not held(i)], order, smoothing)
    want = sorted(((i, held(i), *model.score(t)) for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in got.collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[6] == model.total for g in got)
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], abs=1e-6) and g[5] == pytest.approx(w[5], abs=4e-4 * w[2] + 1e-6)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def held():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def test_query_agrees_with_counts(spark, small, sf_dir):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    close(L.op13_lm_scoring(spark, sf_dir), rows, held_out)


@pytest.mark.parametrize(("order", "smoothing"), [(1, 5.0), (2, 0.5), (3, 20.0), (4, 3.0)])
def test_orders_over_many_chunks_and_shards(spark, small, order, smoothing):
    """With so small shards frequent prefixes are split."""
    part = small.limit(60).cache()
    rows = [(r.doc_id, r.text) for r in part.collect()]
    close(L.lm_scores(part.repartition(3), spark, held(), order=order, smoothing=smoothing, chunk=900, shard=90), rows, held_out, order, smoothing)


def test_odd_rows(spark, messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    close(L.lm_scores(messy, spark, held()), rows, held_out)
    assert L.lm_scores(nothing, spark, held()).count() == 0
    alone = L.lm_scores(messy, spark, F.lit(True)).collect()  # nothing to learn from
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in alone)


def test_probabilities_sum_to_one():
    model = Plain(["a b a c", "a b b", "c a b"])
    for context in [(), ("a",), ("a", "b"), ("z",), ("b", "z")]:
        assert sum(model.p(context, w) for w in ["a", "b", "c", END, "unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("top", [10, 1000, 1 << 40, (1 << 62) - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        values = np.sort(rng.integers(0, top, n))
        e = L.EliasFano(values)
        assert (e[np.arange(n)] == values).all()
        asked = np.concatenate([values, values + 1, np.maximum(values - 1, 0), rng.integers(0, top, 50), [0, top]])
        place = e.find(asked)
        there = np.isin(asked, values)
        assert ((place >= 0) == there).all() and (values[place[there]] == asked[there]).all()


def test_level_finds_successors():
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a) ** 5, int(b)) for a, b in rng.integers(0, 60, (800, 2))})
    prefix, successor = (np.array(c) for c in zip(*pairs, strict=True))
    level = L.Level(prefix, successor, np.full(len(pairs), 0.125))
    for p in {*prefix.tolist(), 7}:
        asked = np.arange(65)
        place, pointer = level.find(np.array([p]), np.array([65]), asked)
        own = [b for a, b in pairs if a == p]
        assert [b for b, x in zip(asked.tolist(), place, strict=True) if x >= 0] == own
        assert (place[place >= 0] - pointer[0]).tolist() == list(range(len(own))) and all(pairs[x] == (p, b) for b, x in zip(asked, place, strict=True) if x >= 0)
    assert L.probability(level.codes) == pytest.approx(0.125, rel=3e-4)
