"""Hard negatives by threshold joins over inverted indexes of vector blocks, with the bounds of L2AP.

Rows are dealt into blocks of BLOCK; a block's index has its dimensions in order of energy, and the norm of every prefix
of every vector. Anchors, in groups of GROUP, meet every block. For a threshold t

- a vector's leading dimensions are left out of the index as long as the norm of that prefix times the largest norm of an
  anchor stays below t: a row that shares only these with an anchor can't reach t;
- partial scores are accumulated from the last dimensions to the first, a slab of postings at a time; pairs whose partial
  score plus the product of both remaining norms stays below t go, and with them the rows that no anchor needs;
- what is left is completed by the dimensions that were left out, so all scores are exact.

Thresholds begin high and are lowered, for those anchors only whose windows aren't full yet, down to the windows' ends.
Positives come first (the best rows of the same label), then the negatives in the window that each positive opens. A
block hands on its best rows of each window only; Spark ranks those of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, kind_of, table, written

#: Rows of a block, anchors of a group, anchors whose partial scores are held at a time, dimensions of a slab.
BLOCK, GROUP, HELD, SLAB = 4096, 4096, 64, 8
#: Thresholds as shares of the way from a window's end to its top.
LEVELS = (0.75, 0.5, 0.25, 0.0)
#: Whole numbers of double precision are exact below.
EXACT = 2.0**53


def usable(vector: Column, label: Column) -> Column:
    """Rows that take part: a label, and a vector without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _blocks(schema: pa.Schema):
    """One row for the partition: its rows in order of id (null last), as a matrix padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
        ids, labels, anchors, vectors = (list(c) for c in zip(*rows, strict=True))
        x = _padded([np.array(v, np.float64) for v in vectors])
        cells = [TaskContext.get().partitionId(), ids, labels, anchors, x.shape[1], x.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return run


def _padded(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(vectors), max(1, max(map(len, vectors)))))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


class Index:
    """The inverted index of a block for one set of anchors."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        width = max(y.shape[1], x.shape[1])
        y, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (y, x))
        order = np.argsort(-(y**2).sum(axis=0), kind="stable")
        self.y, self.x, self.width = np.ascontiguousarray(y[:, order]), np.ascontiguousarray(x[:, order]), width
        self.y_norms, self.x_norms = (np.sqrt(np.concatenate([np.zeros((len(m), 1)), np.cumsum(m**2, axis=1)], axis=1)) for m in (self.y, self.x))
        if len(y) and len(x) and self.y_norms[:, -1].max() * self.x_norms[:, -1].max() >= EXACT:
            raise ValueError("components are too large for exact scores")

    def reach(self, anchors: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs of the anchors whose score is their threshold t or more."""
        x, x_norms = self.x[anchors], self.x_norms[anchors]
        least, most = t.min(), x_norms[:, -1].max(initial=0)
        # dimensions of each row that the index leaves out
        out = np.maximum((self.y_norms * most < least * (1 - 1e-9)).sum(axis=1) - 1, 0) if least > 0 else np.zeros(len(self.y), int)
        rows = np.flatnonzero(out < self.width)
        acc = np.zeros((len(anchors), len(rows)))
        for low in range((self.width - 1) // SLAB * SLAB, -1, -SLAB):
            high = min(low + SLAB, self.width)
            posted = np.flatnonzero(out[rows] < high)
            values = self.y[rows[posted], low:high] * (np.arange(low, high) >= out[rows[posted], None])
            if len(posted) == len(rows):
                acc += x[:, low:high] @ values.T
            else:
                acc[:, posted] += x[:, low:high] @ values.T
            left = np.maximum(out[rows], low)
            can = acc + x_norms[:, left] * self.y_norms[rows, left] * (1 + 1e-9) >= t[:, None] - 1e-6
            needed = np.flatnonzero(can.any(axis=0))
            if len(needed) < 0.9 * len(rows) or not low:
                rows, acc, can = rows[needed], acc[:, needed], can[:, needed]
        i, j = np.nonzero(can) if len(rows) else (np.empty(0, int), np.empty(0, int))
        score = acc[i, j]
        rest = out[rows[j]]
        for part in range(0, len(i), 1 << 16):
            s = slice(part, part + (1 << 16))
            widest = rest[s].max(initial=0)
            if widest:
                score[s] += (x[i[s], :widest] * self.y[rows[j[s]], :widest] * (np.arange(widest) < rest[s, None])).sum(axis=1)
        good = score >= t[i]
        return i[good], rows[j[good]], score[good]


def fill(index: Index, allowed, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, window, row, score): the first k rows of each window low <= score <= high (anchors x windows).

    allowed(anchors, rows) says which pairs count. Rows of a block are in order of id, so ties go by row.
    """
    longest = index.y_norms[:, -1].max(initial=0)
    reach = index.x_norms[:, -1] * longest
    open_ = (low <= high).any(axis=1)
    wide = np.where(low <= high, low, np.inf).min(axis=1, initial=np.inf)
    bottom = np.maximum(wide, -reach - 1)
    top = np.minimum(np.where(low <= high, high, -np.inf).max(axis=1, initial=-np.inf), reach + 1)
    for start in range(0, len(low), HELD):
        todo = np.flatnonzero(open_[start : start + HELD]) + start
        todo = todo[bottom[todo] <= top[todo]]
        for level in LEVELS:
            if not len(todo):
                break
            t = bottom[todo] + (top[todo] - bottom[todo]) * level
            i, row, score = index.reach(todo, t)
            keep = allowed(todo[i], row)
            i, row, score = i[keep], row[keep], score[keep]
            order = np.lexsort((row, -score, i))
            i, row, score = i[order], row[order], score[order]
            full, found = np.ones(len(todo), bool), []
            for w in range(low.shape[1]):
                inside = np.flatnonzero((score >= low[todo[i], w]) & (score <= high[todo[i], w]))
                first = np.searchsorted(i[inside], i[inside])
                best = inside[np.arange(len(inside)) - first < k]
                found.append((w, best))
                full &= (np.bincount(i[best], minlength=len(todo)) >= k) | (t <= low[todo, w]) | (low[todo, w] > high[todo, w])
            full |= level == LEVELS[-1]
            for w, best in found:
                best = best[full[i[best]]]
                yield todo[i[best]], np.full(len(best), w), row[best], score[best]
            todo = todo[~full]


def _first(rows: pa.Table) -> tuple:
    block = rows.slice(0, 1).to_pylist()[0]
    y = np.frombuffer(block["x"]).reshape(-1, block["width"])
    return block, y


def _coded(own: list, others: list) -> tuple[np.ndarray, np.ndarray]:
    """Labels as numbers."""
    codes = {v: i for i, v in enumerate(dict.fromkeys([*own, *others]))}
    return np.array([codes[v] for v in own]), np.array([codes[v] for v in others])


def _joined(k: int, low_share: int | None, high_share: int | None, schema: pa.Schema):
    """The function of a block and a group of anchors: positives if there are no shares, else negatives."""

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        if not blocks.num_rows or not anchors.num_rows:
            return schema.empty_table()
        block, y = _first(blocks)
        labels, mine = _coded(block["labels"], anchors["label"].to_pylist())
        n = anchors.num_rows
        if low_share is None:
            own = np.where(anchors["block"].to_numpy() == block["block"], anchors["place"].to_numpy(), -1)
            low, high = np.full((n, 1), -np.inf), np.full((n, 1), np.inf)
            allowed = lambda i, row: (labels[row] == mine[i]) & (row != own[i])
        else:
            scores = anchors["positive_scores"].to_pylist()
            windows = max(map(len, scores))
            low, high = np.full((n, windows), 1.0), np.full((n, windows), 0.0)
            for i, s in enumerate(scores):
                low[i, : len(s)] = [-(-low_share * p // 100) for p in s]
                high[i, : len(s)] = [high_share * p // 100 for p in s]
            allowed = lambda i, row: labels[row] != mine[i]
        parts = list(fill(Index(y, _padded([np.frombuffer(v) for v in anchors["x"].to_pylist()])), allowed, low, high, k))
        if not parts:
            return schema.empty_table()
        i, w, row, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = pa.array(block["ids"], schema.field("id").type).take(pa.array(row))
        tags = [anchors[c].combine_chunks().take(pa.array(i)) for c in ("block", "place")]
        return pa.Table.from_arrays([*tags, pa.array(w.astype(np.int32)), ids, pa.array(row.astype(np.int64)), pa.array(score.astype(np.int64))], schema=schema)

    return run


def hard_negatives(
    vectors: DataFrame, spark: SparkSession, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    A row's score is its inner product with the anchor; components must be whole numbers. Positives are the first
    n_positives other rows of the anchor's label; negatives the first n_negatives rows of other labels whose score is low
    to high hundredths of the positive's. Higher scores come first, ties by smaller id (null last). Vectors of different
    lengths count as if zeros followed. Rows that `usable` excludes take no part; repeated rows are rows of their own, and
    a repeated anchor gets its results twice. An empty table gives an empty result; other columns are not read.
    """
    id_kind, label_kind = kind_of(vectors, id_col), kind_of(vectors, label_col)
    v = F.col(vector_col)
    rows = vectors.filter(usable(v, F.col(label_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.cast("array<double>").alias("x"))
    rows = written(rows, spark, "vectors")
    n_blocks, n_anchors = max(1, -(-rows.count() // block)), rows.filter("anchor").count()
    block_kinds = f"block int, ids array<{id_kind}>, labels array<{label_kind}>, anchors array<boolean>, width int, x binary"
    blocks = written(rows.repartition(n_blocks).mapInArrow(_blocks(arrow_schema(block_kinds)), block_kinds), spark, "blocks")
    n_groups = max(1, -(-n_anchors // group))

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                x = np.frombuffer(b["x"]).reshape(-1, b["width"])
                at = [i for i, a in enumerate(b["anchors"]) if a]
                cells = [[b["block"]] * len(at), at, [b["ids"][i] for i in at], [b["labels"][i] for i in at], [x[i].tobytes() for i in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, anchor_types, strict=True)], schema=anchor_types)

    anchor_kinds = f"block int, place long, anchor_id {id_kind}, label {label_kind}, x binary"
    anchor_types = arrow_schema(anchor_kinds)
    anchors = written(blocks.mapInArrow(anchors_of, anchor_kinds), spark, "anchors")

    met_kinds = f"block int, place long, window int, id {id_kind}, row long, score long"

    def met(asked: DataFrame, k: int, *shares: int) -> DataFrame:
        """The best k of each window in each block, for anchors (block and place tell them apart)."""
        dealt = asked.withColumn("part", F.pmod(F.xxhash64("block", "place"), F.lit(n_groups)))
        everywhere = dealt.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
        run = _joined(k, *(shares or (None, None)), arrow_schema(met_kinds))
        return each.withColumn("of", F.col("block")).groupBy("of", "part").cogroup(everywhere.groupBy("of", "part")).applyInArrow(lambda left, right: run(left, right), met_kinds)

    best = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    ranked = met(anchors, n_positives).withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(*best))).filter(F.col("rank") <= n_positives)
    listed = F.sort_array(F.collect_list(F.struct("rank", "id", "score")))  # n_positives at most
    positives = ranked.groupBy("block", "place").agg(listed.alias("positives"))
    asked = written(anchors.join(positives, ["block", "place"]), spark, "positives")
    asked = asked.withColumn("positive_scores", F.col("positives.score"))
    found = met(asked, n_negatives, low, high)
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place", "window").orderBy(*best))).filter(F.col("rank") <= n_negatives)
    named = top.join(asked.select("block", "place", "anchor_id", "positives"), ["block", "place"]).withColumn("p", F.element_at("positives", F.col("window") + 1))
    return named.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    fine = e.filter(usable(F.col("embedding"), F.col("label"))).select("vec_id", whole.alias("embedding"), label.alias("label"))
    return hard_negatives(fine, spark, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""
