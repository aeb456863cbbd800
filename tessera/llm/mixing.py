"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue that is served again and again in one shuffled order (by MD5 of the id). The virtual finish time
of a serving is the source's cumulative tokens, this one included, divided by the source's target weight. Servings are
taken in the order of finish time over all sources until the next would exceed the budget: the largest finish time is
found at which all servings up to it fit. Prefix sums go by hash buckets within a source; the queue is range-sorted over
all tasks and cut in the range in which the budget runs out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, n_words, table, written

#: Buckets of the shuffled order of a source, by the first hexadecimal digits of the hash.
DIGITS = 3
#: Servings in one range of the global order, about.
RANGE = 500_000
#: Fixed by the contract: weights by place of the source, share of all tokens that is mixed, servings of a document.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target): weights by code-point order of the names, null last, and share * all tokens filled up.

    A target stops at passes times its source's size; what it leaves is shared again by weight. That is filling to a
    common level: sources in the order of cap / weight, the first k of them at their caps, the rest at weight * level.
    The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.select("*", w.alias("weight"), (F.col("source_size") * float(passes)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * share
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The level of the first source that stays below its cap holds for all that follow it.
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    per = per.withColumn("open_level", open_level)
    return per.select("source", "source_size", F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open_level") * F.col("weight"))).alias("target"))


def _cut(servings: DataFrame, budget: float, spark: SparkSession) -> float:
    """The largest finish time up to which all servings together fit into budget; below any if none fits.

    Servings are sorted by finish time over all sources in ranges of about RANGE rows, equal times in one range. The
    sums of the ranges tell in which one the budget runs out; only that one is added up serving by serving.
    """
    n = max(1, -(-servings.count() // RANGE))
    ranges = servings.repartitionByRange(n, "finish").sortWithinPartitions("finish").withColumn("range", F.spark_partition_id())
    ranges = written(ranges, spark, "mix-sorted")
    sums = ranges.groupBy("range").agg(F.sum("size").alias("size"))
    upto = sums.select("range", "size", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    over = upto.filter(F.col("upto") > budget).orderBy("range").select("range", (F.col("upto") - F.col("size")).alias("before")).first()
    if over is None:
        return math.inf
    inside = ranges.filter(F.col("range") == over["range"])
    by_time = inside.groupBy("range", "finish").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("range").orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)
    run = by_time.select("finish", (F.sum("size").over(in_order) + F.lit(over["before"])).alias("upto"))
    last = run.filter(F.col("upto") <= budget).agg(F.max("finish")).first()[0]
    return last if last is not None else math.nextafter(inside.agg(F.min("finish")).first()[0], -math.inf)


def mix(docs: DataFrame, spark: SparkSession, size: Column, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, n_rows, source_size, target, times): how often the mix takes each document, 0 to passes.

    Rows that agree in id, source and size are served together and make one row here, with their number in n_rows.
    Null sources are a source of their own; rows of size 0 are served with their neighbours and take nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows"))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = written(rows.select("*", (F.col("size") * F.col("n_rows")).alias("all"), h.alias("h"), F.substring(h, 1, DIGITS).alias("bucket")), spark, "mix-rows")
    targets = written(source_targets(rows.select("source", F.col("all").alias("size")), weights, share, passes), spark, "mix-targets")
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("all").alias("in_bucket"))
    offsets = per_bucket.select(
        "source", "bucket", (F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).alias("offset")
    )
    o = offsets.join(targets.withColumnRenamed("source", "s"), offsets["source"].eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "s", "bucket": "b"})
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("all").over(inner)).join(o, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = written(placed.select("doc_id", "source", "size", "n_rows", "all", "source_size", "target", (F.col("upto") + F.col("offset")).alias("served")), spark, "mix-served")
    finish = [F.coalesce(F.try_divide(F.col("served") + F.col("source_size") * p, F.col("target")), F.lit(0.0)) for p in range(passes)]
    servings = placed.filter("size > 0").select(F.col("all").alias("size"), F.explode(F.array(*finish)).alias("finish"))
    budget = targets.agg(F.sum("target")).first()[0]
    cut = _cut(servings, budget, spark) if budget else 0.0
    times = sum((F.when(f <= F.lit(cut), 1).otherwise(0) for f in finish), F.lit(0))
    return placed.select("doc_id", "source", "size", "n_rows", "source_size", "target", times.cast("int").alias("times"))


def mixed_copies(docs: DataFrame, spark: SparkSession, size: Column, id_col: str = "doc_id", source_col: str = "source", **kind) -> DataFrame:
    """docs' rows, each as often as the mix takes it, with docs' own columns.

    Repeated rows are each taken as often; null ids, null sources and rows of size 0 are treated as mix does. An empty
    table gives an empty result.
    """
    i, s, n, m, times, copy = (free_name(docs, f"mix_{x}") for x in ("id", "source", "size", "of", "times", "copy"))
    t = mix(docs, spark, size, id_col=id_col, source_col=source_col, **kind).filter("times > 0")
    t = t.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("times").alias(times))
    sized = docs.withColumn(m, size.cast("long"))
    both = sized.join(t, F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)) & (F.col(m) == F.col(n)))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; of taken, the words of all servings of this row."""
    m = mix(table(spark, sf_dir, "documents"), spark, n_words(F.col("text")))
    m = m.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, size, count(*) AS n_rows, size * count(*) AS every, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
  GROUP BY doc_id, source, size),
per AS (
  SELECT source, CAST(sum(every) AS BIGINT) AS source_size, CAST(sum(every) AS DOUBLE) * 2.0 AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
targets AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source IS NULL, source LIMIT 1)) AS target
  FROM levels),
served AS (
  SELECT r.*, t.source_size, t.target, sum(every) OVER (PARTITION BY r.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
servings AS (
  SELECT doc_id, source, size, every, (served + source_size * pass)::DOUBLE / target AS finish
  FROM served, (VALUES (0), (1)) p(pass) WHERE size > 0),
queue AS (SELECT finish, sum(every) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS spent FROM servings),
cut AS (SELECT max(finish) AS finish FROM queue WHERE spent <= (SELECT sum(target) FROM targets))
SELECT doc_id, size, source_size, target,
       coalesce(CAST(size * ((served::DOUBLE / target <= cut.finish)::INT + ((served + source_size)::DOUBLE / target <= cut.finish)::INT) AS BIGINT), 0) AS taken
FROM (SELECT *, unnest(range(n_rows)) AS nth FROM served), cut
"""
