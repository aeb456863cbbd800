"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with block-max inverted indexes.

1. A bounded sample of labelled rows are the examples; all their words are terms, whatever they say about the label.
2. Every document becomes a sparse vector (1 + ln tf) * idf * relevance over all its words; idf counts all documents.
   The relevance of a word is the power of its log odds with the label among the examples, shrunken towards 0 as if it
   had been seen SHRINK times more at the overall rate, and never below a floor: rare words of single examples weigh
   little, and there is no list of chosen words. Plain tf * idf finds half of the toxic documents only, as the many
   words that say nothing hide the few that do.
3. The index lists, for each word, the blocks of BLOCK examples that have it, with the highest weight that the block
   holds for the word. A query adds these up to an upper bound of each block, scores blocks from the highest bound down,
   and stops when no bound reaches its K-th best cosine. Words that weigh next to nothing in the query only score the
   candidates; what they could add at most is part of every bound. The result is that of comparing with all examples.
4. Neighbours vote with a power of their cosine, beside a small vote for the overall rate. Votes become probabilities by
   an isotonic fit over votes that the examples get from the folds they aren't in; relevance is learned without the
   fold, too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kind_of, table, written
from tessera.llm.quality import remainder

#: Bound of the labelled sample; its index has to fit into the driver and into every worker (about 50 MB of such texts).
TRAIN_ROWS = 5_000
#: Chosen by folds of learnable rows: shrinkage, power and floor of relevance; neighbours, power and prior of votes.
SHRINK, SHARPNESS, FLOOR = 20.0, 3, 0.02
K, POWER, PRIOR = 15, 2, 0.1
BLOCK, FOLDS, EVIDENCE = 64, 4, 3
#: Length of the light part of a query that takes no part in the search for candidates; decides speed only.
SLACK = 0.03

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the distinct words of a text, and how often each occurs."""
    counts = Counter(words(text))
    names = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
    return names, np.fromiter(counts.values(), np.int32, len(counts))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [_term_counts(t) for t in batch.column(2).to_pylist()]
        arrays = [batch.column(0), batch.column(1), _lists([n for n, _ in counts], pa.int64()), _lists([k for _, k in counts], pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "names", "tfs"])


def _vectors(vocabulary: np.ndarray):
    """terms: places of the text's words in the vocabulary; other: squared length of what its other words add, before idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs, other = [], [], np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1).to_pylist()):
                names, tf = _term_counts(text)
                at = np.minimum(np.searchsorted(vocabulary, names), max(0, len(vocabulary) - 1))
                known = vocabulary[at] == names if len(vocabulary) else np.zeros(len(names), bool)
                order = np.argsort(at[known])
                terms.append(at[known][order])
                tfs.append(tf[known][order])
                other[i] = ((1 + np.log(tf[~known])) ** 2).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(terms, pa.int32()), _lists(tfs, pa.int32()), pa.array(other)], ["doc_id", "terms", "tfs", "other"])

    return run


@dataclass
class Examples:
    """Labelled rows as sparse rows: those of example i are at start[i] : start[i + 1] of term and tf."""

    ids: list
    labels: np.ndarray
    start: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    def only(self, rows: np.ndarray) -> Examples:
        n = np.diff(self.start)[rows]
        at = _ranges(self.start[:-1][rows], n)
        return Examples([self.ids[i] for i in rows.tolist()], self.labels[rows], np.concatenate([[0], np.cumsum(n)]), self.term[at], self.tf[at])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def relevance(examples: Examples, n_terms: int) -> tuple[np.ndarray, float]:
    """Each term's relevance, and the rate of label 1."""
    label_of = np.repeat(examples.labels, np.diff(examples.start))
    seen, toxic = np.bincount(examples.term, minlength=n_terms), np.bincount(examples.term, label_of, n_terms)
    rate = (examples.labels.sum() + 0.5) / (len(examples.labels) + 1)
    odds = np.log((toxic + SHRINK * rate) / (seen + SHRINK) / rate)
    return np.maximum(FLOOR, np.abs(odds)) ** SHARPNESS, rate


@dataclass
class Index:
    """Entries of a term are at first[term] : first[term + 1]; each is a block that has the term, the highest weight there,
    and the place of its postings (up to the next entry's). Rows of examples are at row[i] : row[i + 1]."""

    factor: np.ndarray
    other_factor: float
    ids: list
    labels: np.ndarray
    first: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    place: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    rate: float
    row: np.ndarray
    row_term: np.ndarray
    row_weight: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scratch"}

    @property
    def scratch(self) -> np.ndarray:
        if "_scratch" not in self.__dict__:
            self._scratch = np.zeros(len(self.factor))
        return self._scratch

    def nearest(self, terms: np.ndarray, tfs: np.ndarray, other: float = 0.0, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest examples that share a term, ties by place.

        Weighty terms find the candidates: the others, whose weights have the length `slack`, add at most that to any
        cosine. Candidates are then scored with all terms. Where the weighty terms tell too little, all terms search.
        """
        q = (1 + np.log(tfs)) * self.factor[terms]
        q = q / np.sqrt((q * q).sum() + other * self.other_factor**2)
        by_weight = np.argsort(-q, kind="stable")
        rest = np.sqrt(np.maximum(0, (q * q).sum() - np.cumsum(q[by_weight] ** 2)))
        weighty = int(np.argmax(rest <= SLACK)) + 1
        for used, slack in ((by_weight[:weighty], rest[weighty - 1]), (by_weight, 0.0)):
            score, at, kth = self._search(terms[used], q[used], slack, k)
            if kth > slack:
                break
        near = score >= kth - slack - 1e-12
        score, at = score[near], at[near]
        if slack:
            self.scratch[terms] = q
            n = self.row[at + 1] - self.row[at]
            e = _ranges(self.row[at], n)
            cos = np.add.reduceat(self.scratch[self.row_term[e]] * self.row_weight[e], np.cumsum(n) - n)
            self.scratch[terms] = 0
        else:
            cos = score
        best = np.lexsort((at, -cos))[:k]
        return cos[best], at[best]

    def _search(self, terms: np.ndarray, q: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Scores by these terms and places of the examples in all blocks that can hold one of the k nearest; the k-th score."""
        n_blocks = -(-len(self.labels) // BLOCK)
        n = self.first[terms + 1] - self.first[terms]
        entry, q = _ranges(self.first[terms], n), np.repeat(q, n)
        block = self.block[entry]
        bounds = np.bincount(block, q * self.block_max[entry], n_blocks)
        order = np.argsort(-bounds, kind="stable")
        score, at, kth, done, step = np.empty(0), np.empty(0, np.int64), 0.0, 0, 4
        slot = np.full(n_blocks, -1)
        while done < n_blocks:
            part = order[done : done + step]
            part = part[(bounds[part] > 0) & (bounds[part] + slack >= kth - 1e-12)]
            if not len(part):
                break
            slot[:] = -1
            slot[part] = np.arange(len(part))
            place = slot[block]
            here = np.flatnonzero(place >= 0)
            e = entry[here]
            m = self.place[e + 1] - self.place[e]
            p = _ranges(self.place[e], m)
            found = np.bincount(np.repeat(place[here] * BLOCK, m) + self.example[p] % BLOCK, np.repeat(q[here], m) * self.weight[p])
            hit = np.flatnonzero(found)
            score, at = np.concatenate([score, found[hit]]), np.concatenate([at, part[hit // BLOCK] * BLOCK + hit % BLOCK])
            kth = float(np.partition(score, -k)[-k]) if len(score) >= k else 0.0
            done, step = done + step, 2 * step
        return score, at, kth

    def vote(self, cos: np.ndarray, at: np.ndarray) -> float:
        w = cos**POWER
        return float(((w * self.labels[at]).sum() + PRIOR * self.rate) / (w.sum() + PRIOR))


def build_index(examples: Examples, idf: np.ndarray, other_idf: float) -> Index:
    """Similar examples stand together, so that bounds of blocks are sharp."""
    relevant, rate = relevance(examples, len(idf))
    factor = idf * relevant
    n = np.diff(examples.start)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    weight = (1 + np.log(examples.tf)) * factor[examples.term]
    weight /= np.sqrt(np.bincount(row, weight * weight, len(n)))[row]
    # examples in the order of their weightiest term
    heaviest = np.zeros(len(n))
    np.maximum.at(heaviest, row, weight)
    top = np.flatnonzero(weight == heaviest[row])[::-1]  # of several the first
    lead = np.full(len(n), -1)
    lead[row[top]] = examples.term[top]
    turn = np.lexsort((np.arange(len(n)), n, lead))
    place_of = np.empty(len(n), np.int64)
    place_of[turn] = np.arange(len(n))
    r = _ranges(examples.start[:-1][turn], n[turn])
    rows = (np.concatenate([[0], np.cumsum(n[turn])]), examples.term[r].astype(np.int32), weight[r])
    example = place_of[row]
    order = np.argsort(examples.term * np.int64(len(n)) + example)
    example, weight = example[order].astype(np.int32), weight[order]
    n_blocks = max(1, -(-len(n) // BLOCK))
    cell = examples.term[order] * np.int64(n_blocks) + example // BLOCK
    del order, row, top
    place = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    cell = cell[place]
    block_max = np.maximum.reduceat(weight, place) if len(place) else np.empty(0)
    first = np.searchsorted(cell, np.arange(len(idf) + 1) * n_blocks)
    return Index(
        factor, other_idf * FLOOR**SHARPNESS, [examples.ids[i] for i in turn.tolist()], examples.labels[turn], first, (cell % n_blocks).astype(np.int32), block_max,
        np.append(place, len(weight)), example, weight, rate, *rows,
    )


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and probabilities to interpolate between: pooled adjacent violators, each pool smoothed by one half a label."""
    pools: list[list[float]] = []
    order = np.lexsort((labels, votes))
    for v, y in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
        if pools and pools[-1][3] == v:
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + 1, pools[-1][2] + v, v]
        else:
            pools.append([y, 1, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2] + a[2], a[3]]
    x = np.array([p[2] / p[1] for p in pools])
    return x, np.maximum.accumulate(np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools]))


def _score_rows(shared, fit: tuple[np.ndarray, np.ndarray] | None, id_kind: pa.DataType):
    kind = pa.list_(pa.struct([("id", id_kind), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            start = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            terms, tfs = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            out, evidence = np.empty(batch.num_rows), []
            for i, other in enumerate(batch.column(3).to_pylist()):
                a, b = start[i], start[i + 1]
                near: list[dict] = []
                vote = index.rate
                if b > a and len(index.labels):
                    cos, at = index.nearest(terms[a:b], tfs[a:b], other)
                    vote = index.vote(cos, at)
                    near = [{"id": index.ids[x], "cosine": float(c), "label": int(index.labels[x])} for c, x in zip(cos[:EVIDENCE], at[:EVIDENCE], strict=True)]
                out[i] = vote
                evidence.append(near)
            if fit is not None and len(fit[0]):
                out = 0.99 * np.interp(out, *fit) + 0.01 * out  # keeps the order of votes inside a pool
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(out, 0, 1)), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return run


def _fold_votes(vocabulary: np.ndarray, shared):
    """Votes that examples get from an index they aren't in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            start = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy())])
            terms, tfs = np.searchsorted(vocabulary, batch.column(0).flatten().to_numpy()), batch.column(1).flatten().to_numpy()
            votes = [index.vote(*index.nearest(terms[a:b], tfs[a:b])) if b > a and len(index.labels) else index.rate for a, b in zip(start[:-1], start[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(2).cast(pa.float64())], ["vote", "label"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, spark: SparkSession, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, evidence) for each row of docs: evidence holds the nearest examples with their cosines and labels.

    Null and empty texts, and texts that share no word with an example, get the calibrated overall rate. Without labels
    all scores are one constant; with labels of one kind all examples vote alike. Repeated rows are each scored. Of
    several texts with one id the first in order is the example, and of several labels the higher counts; examples at
    one cosine are taken in the order of the index. Only ids and texts of docs are read; ids may be of any type that
    labels can be joined by. The driver holds the words of at most train_rows examples, counted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = kind_of(rows, "doc_id")
    sample = labels.filter(learn & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = written(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), spark, "sample")
    # the sample has at most train_rows pairs of numbers: that is the bound of this broadcast
    texts = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    named = written(texts.mapInArrow(_named, f"doc_id {kind}, label int, names array<bigint>, tfs array<int>"), spark, "examples")
    got = named.orderBy("doc_id").toArrow().combine_chunks()
    names, tfs = (got.column(c).combine_chunks() for c in ("names", "tfs"))
    vocabulary, term = np.unique(names.flatten().to_numpy(), return_inverse=True)
    term = term.astype(np.int32)
    start = np.concatenate([[0], np.cumsum(names.value_lengths().to_numpy())]) if len(got) else np.zeros(1, np.int64)
    examples = Examples(got.column("doc_id").to_pylist(), got.column("label").to_numpy().astype(float), start, term, tfs.flatten().to_numpy())

    shape = f"doc_id {kind}, terms array<int>, tfs array<int>, other double"
    vectors = written(rows.mapInArrow(_vectors(vocabulary), shape), spark, "vectors")
    n = vectors.count()
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()  # at most a row a word of the examples
    df = np.zeros(len(vocabulary))
    df[counted.column("t").to_numpy()] = counted.column("df").to_numpy()
    idf, other_idf = np.log((1 + n) / (1 + df)) + 1, float(np.log(1 + n)) + 1

    scored = f"doc_id {kind}, score double, evidence array<struct<id: {kind}, cosine: double, label: int>>"
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))
    in_fold = named.orderBy("doc_id").select(fold.alias("fold")).toArrow().column("fold").to_numpy()

    share = spark.sparkContext.broadcast  # an index is as large as train_rows texts

    def votes(f: int) -> pa.Table:
        index = share(build_index(examples.only(np.flatnonzero(in_fold != f)), idf, other_idf))
        voted = named.filter(fold == f).select("names", "tfs", "label").mapInArrow(_fold_votes(vocabulary, index), "vote double, label double").toArrow()
        index.destroy()
        return voted

    voted = pa.concat_tables([votes(f) for f in range(FOLDS)])
    fit = isotonic(voted.column("vote").to_numpy(), voted.column("label").to_numpy())
    return vectors.mapInArrow(_score_rows(share(build_index(examples, idf, other_idf)), fit, got.schema.field("doc_id").type), scored)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, labels, spark, remainder("doc_id", 5) != 0)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
