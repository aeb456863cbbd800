"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link if at most 3 of their 64 bits differ. Balls of half that radius, one bit, around both meet if at
most 2 bits differ, so one of three differing bits is taken out first: the 64 bits are cut into 3 blocks, and for each
block the other bits, with every variant that has one of them flipped, are emitted as keys (131 in all). Fingerprints
of one key differ in at most 2 of the bits outside the block. Among these

- those that agree in the block, or differ in one bit of it, link; each group of them is tied to its smallest member;
- those with the same bits outside link also if the block differs in 2 or 3 bits: these are looked up, flip by flip.

Any 3 differing bits lie either in one block (second rule) or leave at most 2 outside the block that holds just one of
them, or at most 2 in all (first rule), so no link is lost; and nobody lists the pairs of a group. Every link is verified by counting
bits. Equal fingerprints are merged before and share a row; components are found among those that have links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kind_of, table, tagged, written
from tessera.llm.components import components

RADIUS, SEED = 3, 42
#: First bit and size of each block; KEY_BITS: most bits outside one.
BLOCKS, KEY_BITS, MOST = ((0, 22), (22, 21), (43, 21)), 43, 22
#: Words of a shingle.
SHINGLE = 3


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash; repeated shingles count each time. Fewer words than a shingle: all of them; none: 0."""
    words = (text or "").encode().lower().split()  # bytes: lower() folds A-Z only and split() knows the six ASCII blanks
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *batch.columns[1:]], ["fp", *batch.schema.names[1:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str | None = None) -> DataFrame:
    """(fp, doc_id) and, if asked for, the tag of each row."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *([F.col(tag).alias("tag")] if tag else []))
    return rows.mapInArrow(_fingerprints, f"fp long, doc_id {kind_of(rows, 'doc_id')}" + (f", tag {kind_of(rows, 'tag')}" if tag else ""))


def _without(values: np.ndarray, block: int) -> np.ndarray:
    """The bits outside the block, closed up."""
    low, size = BLOCKS[block]
    high = values >> np.uint64(low + size) if low + size < 64 else np.zeros_like(values)
    return (values & np.uint64((1 << low) - 1)) | (high << np.uint64(low))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 2000):
            fp = batch.column(0).to_numpy(zero_copy_only=False)[part : part + 2000].view(np.uint64)
            for block, (_, size) in enumerate(BLOCKS):
                flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64 - size, dtype=np.uint64)])
                keys = (_without(fp, block)[:, None] ^ flips) | np.uint64(block << KEY_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], ["key", "fp"])


_ONE = [np.uint64(1 << i) for i in range(MOST)]
_MORE = [np.uint64(sum(1 << i for i in c)) for size in range(2, RADIUS + 1) for c in combinations(range(MOST), size)]


def _linked_in(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of the same key; both arrays are sorted by key."""
    block = key >> np.uint64(KEY_BITS)
    low, size = (np.array(x, np.uint64)[block] for x in zip(*BLOCKS, strict=True))
    inside = (fp >> low) & ((np.uint64(1) << size) - np.uint64(1))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.uint64)
    place = (group << np.uint64(MOST)) | inside
    order = np.lexsort((fp, place))
    place, fp, key, block = place[order], fp[order], key[order], block[order]
    first = np.concatenate([[True], place[1:] != place[:-1]])
    heads = np.flatnonzero(first)
    head_of = heads[np.cumsum(first) - 1]
    links = [(fp, fp[head_of])]  # same key, same block: each to the smallest

    def look(places: np.ndarray, fps: np.ndarray, flips: list) -> None:
        for flip in flips:
            near = places ^ flip
            at = np.minimum(np.searchsorted(places, near), len(places) - 1)
            hit = np.flatnonzero((places[at] == near) & (near < places))
            if len(hit):
                links.append((fps[hit], fps[at[hit]]))

    look(place[heads], fp[heads], _ONE)
    exact = np.zeros(len(fp), bool)
    for b in range(len(BLOCKS)):
        exact |= (block == b) & (_without(fp, b) == (key & np.uint64((1 << KEY_BITS) - 1)))
    centre = np.flatnonzero(exact)
    if len(centre):
        g = place[centre] >> np.uint64(MOST)
        centre = centre[np.isin(g, g[1:][g[1:] == g[:-1]])]
    if len(centre) > 1:
        look(place[centre], fp[centre], _MORE)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    real = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    a, b = a[real], b[real]
    return np.maximum(a, b), np.minimum(a, b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows may span batches, so those of the last key wait for the next batch."""
    empty = np.empty(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far, joined once it is complete

    def flush() -> pa.RecordBatch:
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (empty, empty)
        held.clear()
        shared = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        key, fp = key[shared], fp[shared]
        u, v = _linked_in(key, fp) if len(key) else (empty, empty)
        pairs = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        if not len(key):
            continue
        last = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
        if last or not held or held[-1][0][-1] != key[0]:
            held.append((key[:last], fp[:last]))
            yield flush()
        held.append((key[last:], fp[last:]))
    yield flush()


def near_links(distinct_fps: DataFrame) -> DataFrame:
    """(u, v): links that join the same fingerprints into components as all pairs within the radius do."""
    emitted = distinct_fps.mapInArrow(_emit, "key long, fp long")
    dealt = emitted.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def component_labels(distinct_fps: DataFrame, spark: SparkSession) -> DataFrame:
    """(fp, label): fingerprints that reach each other have one label."""
    links = written(near_links(distinct_fps), spark, "links")
    labels = components(links, spark)
    return distinct_fps.join(labels, distinct_fps["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Null and blank texts have fingerprint 0 and link like any other. component_id is the smallest id reachable; rows
    with a null id get that of their component too, null if it has no other. Repeated rows each get a row, all alike.
    An empty table gives an empty result. Ids may be of any type that has an order; other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col), spark, "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), spark, "classes")
    labelled = classes.join(component_labels(classes.select("fp"), spark).withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = written(labelled.join(smallest, "label").select("f", "component_id"), spark, "component-ids")
    return fps.join(ids, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, with docs' own columns.

    The row with the smallest id stays (null last), of several with that id the first in docs' order; so of repeated
    rows one stays.
    """
    rows, tag = tagged(docs, spark)
    fps = written(fingerprints(rows, id_col, text_col, tag), spark, "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
    classes = written(fps.groupBy("fp").agg(least.alias("least")), spark, "classes")
    labelled = classes.join(component_labels(classes.select("fp"), spark).withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"))
    kept = labelled.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.tag").alias(tag))
    return rows.join(kept, tag, "left_semi").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), spark)
