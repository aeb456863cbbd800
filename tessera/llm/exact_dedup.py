"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition becomes a run: its digests in order, each once, with its best row and the number of its copies. In
binomial rounds, FAN_IN neighbouring runs are merged into one, which is written to the shared folder. A run merged from
many is cut into as many slices of the digests' range, so that a task reads one slice of FAN_IN runs and no task grows with
the round; as a run holds a digest once, a digest brings at most FAN_IN rows to a merge, however many copies it has.

A merge sorts the runs' rows together (Spark spills what memory can't hold) and keeps the first row of each digest in one
pass. Equal texts are those with equal SHA-256 of the normalised text; a second, independent 64-bit hash and the byte
length are part of the key, so each level is verified against a digest collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, table, tagged, written

#: Runs merged at a time.
FAN_IN = 16
KEY = ["digest", "check", "n_bytes"]
#: Where a row is: its run, and the slice of the digests' range in it.
PLACE = ["run", "slice"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _digests(docs: DataFrame, id_col: str, text_col: str, tag: Column | None = None) -> DataFrame:
    """One row per input row: id, a tag that tells repeated rows apart, code points, digest, and the run."""
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.monotonically_increasing_id() if tag is None else tag).alias("tag"),
        F.spark_partition_id().alias("run"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.sha2(norm, 256).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.octet_length(norm).alias("n_bytes"),
    )


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of PLACE and KEY: the first of each, with the copies of all of them. The last key of a batch waits for the next batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if rows.num_rows == 0:
            continue
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for c in (*PLACE, *KEY):
            column = rows[c].combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        copies = pa.array(np.add.reduceat(rows["copies"].to_numpy(), starts))
        firsts = rows.take(pa.array(starts)).set_column(rows.schema.get_field_index("copies"), rows.schema.field("copies"), copies)
        *done, held = firsts[:-1].to_batches() + firsts[-1:].combine_chunks().to_batches()
        yield from done
    if held is not None:
        yield held


def _as_run(rows: DataFrame) -> DataFrame:
    """Each partition's rows in order, every digest once: most code points first, then the smallest id (null last), then tag."""
    return rows.sortWithinPartitions(*PLACE, *KEY, "less", "no_id", "id", "tag").mapInArrow(_first_of_each, rows.schema)


def merge_runs(digests: DataFrame, spark: SparkSession, fan_in: int = FAN_IN) -> DataFrame:
    """(digest key, best, copies): the row that stays has most code points, then the smallest id (null last), then tag."""
    runs = _as_run(digests.select(
        *KEY, "run", F.lit(0).alias("slice"), (-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "tag", F.lit(1).cast("long").alias("copies")
    ))
    n_inputs = (digests.agg(F.max("run")).first()[0] or 0) + 1
    n_runs, n_slices = n_inputs, 1
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    while True:
        n_runs, n_slices = -(-n_runs // fan_in), min(n_slices * fan_in, n_inputs)
        neighbours = runs.withColumns({"run": F.floor(F.col("run") / fan_in).cast("int"), "slice": F.shiftright(prefix * n_slices, 32).cast("int")})
        runs = written(_as_run(neighbours.repartition(n_runs * n_slices, *PLACE)), spark, "run")
        if n_runs == 1:
            return runs.select(*KEY, F.struct("id", "tag").alias("best"), "copies")


def exact_groups(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after deleting white space; null counts as empty, and all empty texts are one group. Of repeated
    rows with one id, exactly one is kept. An empty table gives an empty result. Other columns of docs are not read.
    """
    digests = written(_digests(docs, id_col, text_col), spark, "digests")
    winners = merge_runs(digests, spark)
    w = winners.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), F.col("copies").alias("group_size"))
    return digests.join(w, KEY).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, with docs' own columns.

    Of equal texts the row with the most code points stays, then the one with the smallest id (null last), then the first
    in docs' order. Rows of other texts that share an id are judged for themselves; of wholly repeated rows one stays.
    """
    rows, tag = tagged(docs, spark)
    digests = written(_digests(rows, id_col, text_col, F.col(tag)), spark, "digests")
    kept = merge_runs(digests, spark).select(F.col("best.tag").alias(tag))
    return rows.join(kept, tag, "left_semi").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), spark)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
