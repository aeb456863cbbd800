"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of at most BINS bins (quantiles of the training rows), and adds what the feature's
lookup table holds for that bin; a few pairs of features add from two-dimensional tables. The tables are learned by
cyclic boosting: in every round each feature in turn gets one shallow tree, fitted to the current residuals and shrunk.
Then the pairs that explain most of what is left are chosen and boosted in the same way. Scoring adds table entries.

Training takes at most `train_rows` labelled rows, those whose ids hash lowest, so that their binned features (a few
dozen bytes a row) fit anywhere; features and scores are computed for every row by Spark.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kind_of, table, tagged, written

#: Bound of the training sample.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 200, 60, 0.1
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_bytes", "letters", "capitals", "symbols", "digits", "commas_stops", "marks", "bars", "other_bytes", "distinct_words",
    "adjacent_repeats", "distinct_pairs", "compressed", "distinct_lines", "words_a_line",
)


def _classes() -> np.ndarray:
    """For each byte: letter, capital, symbol, digit, comma or stop, exclamation or question mark, bar, beyond ASCII."""
    table = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        table[b] = [c.isascii() and c.isalpha(), "A" <= c <= "Z", 32 < b < 127 and not c.isalnum() and c not in ".,!?|", c.isascii() and c.isdigit(), c in ".,", c in "!?", c == "|", b >= 128]
    return table


_CLASSES = _classes()


def features(text: str | None) -> list[float]:
    """The values of FEATURES for one text; null counts as empty, and an empty text gives zeros."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    letters, capitals, symbols, digits, stops, marks, bars, beyond = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, pairs = max(1, len(words)), max(1, len(words) - 1)
    return [
        math.log1p(len(words)), len(raw) / n, letters + beyond, capitals / max(1e-9, letters + beyond), symbols, digits, stops, marks, bars, beyond,
        len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / pairs, len(set(zip(words, words[1:], strict=False))) / pairs,
        len(zlib.compress(raw, 1)) / len(raw), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(len(FEATURES))), *batch.columns[2:]], ["doc_id", *FEATURES, *batch.schema.names[2:]])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str | None = None) -> DataFrame:
    """(doc_id, features) and, if asked for, the tag of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(tag).alias("tag")] if tag else []))
    return rows.mapInArrow(_feature_rows, f"doc_id {kind_of(rows, 'doc_id')}, " + ", ".join(f"{f} float" for f in FEATURES) + (f", tag {kind_of(rows, 'tag')}" if tag else ""))


@dataclass
class Additive:
    """edges[j]: upper bin edges of feature j; tables[j]: its lookup table; pairs: (i, j, table over coarse bins)."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """Leaf value of every bin, and the gain, of a tree that splits the ordered bins up to depth times."""
    value = g.sum() / (h.sum() + smooth)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), value), 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + smooth) + (g.sum() - gl) ** 2 / (h.sum() - hl + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    k = int(gain.argmax())
    if gain[k] <= 1e-9:
        return np.full(len(g), value), 0.0
    (left, a), (right, b) = _tree(g[: k + 1], h[: k + 1], depth - 1, smooth), _tree(g[k + 1 :], h[k + 1 :], depth - 1, smooth)
    return np.concatenate([left, right]), float(gain[k]) + a + b


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The better of: split the rows once and the columns of each part once, or the other way round."""

    def rows_first(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        best, out = -1.0, np.zeros_like(g)
        for k in range(1, len(g)):
            (top, a), (low, b) = _tree(g[:k].sum(0), h[:k].sum(0), 1), _tree(g[k:].sum(0), h[k:].sum(0), 1)
            if a + b > best:
                best, out = a + b, np.concatenate([np.tile(top, (k, 1)), np.tile(low, (len(g) - k, 1))])
        return out, best

    (x, a), (y, b) = rows_first(g, h), rows_first(g.T, h.T)
    return (x, a) if a >= b else (y.T, b)


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of logistic loss. Without rows, or with one class only, the model is that constant, smoothed."""
    intercept = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.empty(0) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    sizes = [len(e) + 1 for e in edges]
    tables = [np.zeros(s) for s in sizes]
    coarse = [(np.arange(s) * PAIR_BINS // s).astype(int) for s in sizes]
    model = Additive(edges, intercept, tables, coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    total = np.full(len(y), intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            r, w = residual()
            step = RATE * _tree(np.bincount(b, r, sizes[j]), np.bincount(b, w, sizes[j]))[0]
            tables[j] += step
            total += step[b]

    def joint(i: int, j: int) -> np.ndarray:
        return coarse[i][bins[i]] * PAIR_BINS + coarse[j][bins[j]]

    def sums(cell: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (r, w))

    r, w = residual()
    gains = sorted(((-_pair_tree(*sums(joint(i, j), r, w))[1], i, j) for i, j in combinations(range(len(bins)), 2)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains]
    cells = [joint(i, j) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for (_, _, t), cell in zip(model.pairs, cells, strict=True):
            r, w = residual()
            step = RATE * _pair_tree(*sums(cell, r, w))[0]
            t += step
            total += step.ravel()[cell]
    return model


def train(rows: DataFrame, labels: DataFrame, learn: F.Column, train_rows: int = TRAIN_ROWS, label: str = "quality") -> Additive:
    """rows: a feature table; labels: (doc_id, label). learn: which of labels may be learned from.

    The sample is the train_rows ids of lowest hash; labels that are null, or whose document is missing, don't count. Of
    several labels of an id the higher counts, of several rows the one with the smallest features.
    """
    chosen = labels.filter(learn & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    one = chosen.join(rows, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(*FEATURES)).alias("f"))
    got = one.select("doc_id", "label", "f.*").toPandas().sort_values("doc_id")
    return fit(got[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES)), got["label"].to_numpy(np.float64))


def _scores(model: Additive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), *batch.columns[1 + len(FEATURES) :]], ["doc_id", "score", *batch.schema.names[1 + len(FEATURES) :]])

    return run


def remainder(doc_id, of: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def quality_scores(docs: DataFrame, labels: DataFrame, spark: SparkSession, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, tag: str | None = None) -> DataFrame:
    """(doc_id, score) for each row of docs, with its tag if that is asked for; null and empty texts are scored like any other.

    Repeated rows are each scored, equal texts alike; an empty table gives an empty result, and without labels of both
    kinds all scores are one constant. Only ids and texts of docs are read; ids may be of any type that labels can be
    joined by.
    """
    rows = written(feature_table(docs, id_col, text_col, tag), spark, "features")
    model = train(rows, labels, learn, train_rows)
    return rows.mapInArrow(_scores(model), f"doc_id {kind_of(rows, 'doc_id')}, score double" + (f", tag {kind_of(rows, 'tag')}" if tag else ""))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs, labels, spark, remainder("doc_id", 4) != 2)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below threshold, each row judged by its own text, with docs' own columns.

    Rows that share an id, or have none, are judged one by one; equal texts score alike, a score of exactly threshold stays,
    and so do all of a row's repeats. Null and empty texts are scored like any other. An empty table gives an empty result.
    """
    rows, tag = tagged(docs, spark)
    good = quality_scores(rows, labels, spark, remainder("doc_id", 4) != 2, tag=tag).filter(F.col("score") >= threshold).select(F.col("tag").alias(tag))
    return rows.join(good, tag, "left_semi").select(*docs.columns)
