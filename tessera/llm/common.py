"""What several operators share: reading tables, shared scratch tables, column checks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Java character class of the white space that the contracts name: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a new one is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, spark: SparkSession, name: str, column: str) -> DataFrame:
    """df written once in the shared folder, in buckets of the column: joins and groups by the column read it without a shuffle.

    An external table of spark.sql.shuffle.partitions buckets; the session's catalog keeps its name, the folder its files.
    """
    named = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("path", f"{shared_dir(spark)}/{named}").option("compression", "zstd").format("parquet").saveAsTable(named)
    return spark.table(named)


def checkpointed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Spark's own checkpoint in the shared folder; for small tables of iterations, freed when unreferenced."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def arrow_schema(kinds: str) -> pa.Schema:
    """A schema string as Arrow's schema."""
    return to_arrow_schema(StructType.fromDDL(kinds))


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, as a schema string has it."""
    return df.schema[column].dataType.simpleString()


def tagged(df: DataFrame, spark: SparkSession) -> tuple[DataFrame, str]:
    """df with a column that tells its rows apart and stays so, and that column's name.

    Rows of files are told by file and place in it, if that tells them apart: a row that was exploded, joined or united with
    itself stands for several. Such rows, and those that don't come from files, are written once, with a number each.
    """
    tag = free_name(df, "row_tag")
    try:
        rows = df.withColumn(tag, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        if rows.groupBy(tag).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return rows, tag
    except AnalysisException:  # df doesn't come straight from files
        pass
    return written(df.withColumn(tag, F.monotonically_increasing_id()), spark, "tagged"), tag


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores appended until df has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def n_words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
