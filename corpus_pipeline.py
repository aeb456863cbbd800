"""A training-data pipeline over documents: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage's result is written as Parquet and read again as the next one's docs; the last gives the packing, the others
the columns of documents, whatever others docs has. Quality takes its labels from the labels table beside documents. Empty
tables go through all stages and give an empty packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, mixing, packing, quality, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score below the threshold go, row by row; null and empty texts are scored like others, repeats and ties stay or go together."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"), spark)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of texts that are equal but for white space, one stays: the longest, then the smallest id (null last), then the first; null counts as empty."""
    return exact_dedup.exact_dedup(docs, spark)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component of near duplicates, the document with the smallest id stays (null last), of repeated rows the first; empty texts link with each other."""
    return simhash.near_dedup(docs, spark)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mix of sources takes it, up to twice; null sources are one source, texts without words go, repeats are taken alike."""
    return mixing.mixed_copies(docs, spark, common.n_words(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: all copies packed into sequences; null and empty texts are their end token, very long ones are cut into pieces."""
    return packing.packed(docs, spark)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: A boosted model, fingerprints, components and a packing rule are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), spark, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
