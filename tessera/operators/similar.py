"""Similar records, and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import similar_window
from tessera.functions.text import STOP_WORDS
from tessera.sources.scratch import kept

#: The aspect that every scope has besides its own.
RESERVED = "recordType"
#: Records that have a value, up to which the value opens them.
RARE = 1000
#: Rows of similar_dates' result that a task makes.
PAIRS = 4_000_000


def top_words(fields: DataFrame, names: Sequence[str], k: int = 5, least: int = 4) -> DataFrame:
    """(uri, word, n, rank): the k most frequent words a-z of at least `least` letters that are no stop words, over all the fields at once."""
    words = fields.filter(F.col("field").isin(list(names))).select("uri", F.explode(F.split(F.lower("v_str"), "[^a-z]+")).alias("word"))
    n = words.filter((F.length("word") >= least) & ~F.col("word").isin(STOP_WORDS)).groupBy("uri", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= k)


def aspect_values(fields: DataFrame, spec: dict[str, tuple[Sequence[str], float, bool]], docs: DataFrame | None = None, ignored: Sequence[str] = (), type_mandatory: bool = False) -> DataFrame:
    """(uri, aspect, value, weight, mandatory) by aspect: (fields, weight, mandatory).

    docs adds the reserved aspect that every scope has besides its own: the record's type, with weight 1.
    """
    spark = fields.sparkSession
    rows = [(f, a, float(w), bool(m)) for a, (fs, w, m) in spec.items() for f in fs]
    s = spark.createDataFrame(rows, "field string, aspect string, weight double, mandatory boolean")
    v = fields.filter(F.col("v_str").isNotNull() & ~F.col("v_str").isin(list(ignored))).join(F.broadcast(s), "field")  # s: one row an aspect's field
    v = v.select("uri", "aspect", F.col("v_str").alias("value"), "weight", "mandatory")
    if docs is not None:
        v = v.union(docs.select("uri", F.lit(RESERVED), F.col("data_type"), F.lit(1.0), F.lit(type_mandatory)))
    return v.distinct()


def split_by_frequency(values: DataFrame, mine: DataFrame, rare: int = RARE) -> DataFrame:
    """(aspect, value, common) for the values in mine: whether more than `rare` records have the value."""
    asked = mine.select("aspect", "value").distinct()
    n = values.join(asked, ["aspect", "value"], "left_semi").groupBy("aspect", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.select("aspect", "value", (F.col("n") > rare).alias("common"))


def similar(values: DataFrame, seeds: DataFrame, k: int = 10, rare: int = RARE) -> DataFrame:
    """(seed, uri, score, rank): records that share aspect values with each seed, the sum of weights as score; ties by uri.

    Where a seed has mandatory values, a record must share one of each mandatory aspect. Seeds without values get nothing.

    Only rare values open their records. A record that is found by common values alone scores what its set of common values
    shares with the seed, as all records with that set do; of these, records with a smaller uri score at least as much, so
    only the first k of a set can be among a seed's first k, and only the k best sets. These take the place of the common
    values' records. All candidates are then verified against all values.
    """
    mine = values.join(seeds.select("uri").distinct(), "uri", "left_semi").withColumnRenamed("uri", "seed")
    split = kept(split_by_frequency(values, mine, rare), "frequency")
    own = kept(mine.join(split, ["aspect", "value"]), "seed-values")
    open_ = own.filter("not common").select("seed", "aspect", "value")
    rare_ones = values.join(split.filter("not common"), ["aspect", "value"], "left_semi")
    found = open_.join(rare_ones.select("uri", "aspect", "value"), ["aspect", "value"]).select("seed", "uri").distinct()

    pair = F.struct("aspect", "value")
    sets = values.join(split.filter("common").select("aspect", "value"), ["aspect", "value"], "left_semi").groupBy("uri").agg(F.sort_array(F.collect_set(pair)).alias("set"))
    place = F.row_number().over(Window.partitionBy("set").orderBy("uri"))
    firsts = sets.withColumn("place", place).filter(F.col("place") <= k + 1).withColumn("set_values", F.col("set"))  # the seed itself may be one
    aspects = F.count_distinct(F.when(F.col("mandatory"), F.col("aspect")))
    # seeds that agree in their common values and in what they need have the same best sets, which are looked for once
    common = F.sort_array(F.collect_set(F.when(F.col("common"), F.struct("aspect", "value", "weight", "mandatory"))))
    alike = own.groupBy("seed").agg(aspects.alias("needed"), common.alias("common_values")).withColumn("kind", F.sha2(F.to_json(F.struct("needed", "common_values")), 256))
    alike = kept(alike, "alike")
    needed = alike.select("seed", "needed")
    kinds = alike.groupBy("kind").agg(F.first("needed").alias("needed"), F.first("common_values").alias("common_values"))
    firsts = kept(firsts.withColumn("set", F.sha2(F.to_json("set"), 256)).select("set", "uri", "place", F.when(F.col("place") == 1, F.col("set_values")).alias("values")), "set-firsts")
    heads = firsts.filter("place = 1").select("set", F.col("uri").alias("least"), F.explode("values").alias("p")).select("set", "least", "p.aspect", "p.value")
    of_kind = kinds.select("kind", "needed", F.inline("common_values"))
    of_set = heads.join(of_kind, ["aspect", "value"]).groupBy("kind", "needed", "set", "least").agg(F.sum("weight").alias("most"), aspects.alias("met"))
    best = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("most"), "least"))
    near = of_set.filter("met = needed").withColumn("n", best).filter(F.col("n") <= k + 1).select("kind", "set", "most")
    # of a kind's records the first k + 1, by what sets are worth and uri, as a seed may be one of them
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("most"), "uri"))
    of_kinds = near.join(firsts, "set").withColumn("n", order).filter(F.col("n") <= k + 1).select("kind", "uri")
    by_sets = alike.select("seed", "kind").join(of_kinds, "kind").select("seed", "uri")

    candidates = found.union(by_sets).filter("seed <> uri").distinct()
    shared = candidates.join(values.select("uri", "aspect", "value"), "uri").join(own.select("seed", "aspect", "value", "weight", "mandatory"), ["seed", "aspect", "value"])
    scored = shared.groupBy("seed", "uri").agg(F.sum("weight").alias("score"), aspects.alias("met"))
    good = scored.join(needed, "seed").filter("met = needed")
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "uri"))).filter(F.col("rank") <= k).select("seed", "uri", "score", "rank")


def similar_match(values: DataFrame, uri: str) -> DataFrame:
    """A match (uri, score) of the records similar to one, to be combined with others; without values it is an error."""
    if values.filter(F.col("uri") == uri).isEmpty():
        raise ValueError(f"{uri} has no values to be similar in")
    return similar(values, values.sparkSession.createDataFrame([(uri,)], "uri string"), 1 << 30).select("uri", "score")


def similar_dates(fields: DataFrame, start_field: str, end_field: str, seeds: DataFrame) -> DataFrame:
    """(seed, uri): records that begin before and end after each seed's widened window of years; a side that the seed lacks is skipped.

    Spans and windows are met by their years, so each pair of them is looked at once, however many records share it. The
    result, which grows with seeds times records, is made in tasks of about PAIRS rows.
    """
    year = lambda c: F.year(F.timestamp_seconds(c))
    f = fields.filter(F.col("field").isin(start_field, end_field))
    spans = f.groupBy("uri").agg(F.min(F.when(F.col("field") == start_field, F.col("v_long"))).alias("s"), F.max(F.when(F.col("field") == end_field, F.col("v_long"))).alias("e"))
    spans = spans.select("uri", year(F.col("s")).alias("s"), year(F.col("e")).alias("e"))
    lo, hi = similar_window(F.col("s"))[0], similar_window(F.col("e"))[1]
    windows = spans.join(seeds.select("uri").distinct(), "uri", "left_semi").select(F.col("uri").alias("seed"), lo.alias("lo"), hi.alias("hi"))
    outside = (F.col("lo").isNull() | (F.col("s") < F.col("lo"))) & (F.col("hi").isNull() | (F.col("e") > F.col("hi")))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    n_spans = spans.groupBy("s", "e").agg(F.count(F.lit(1)).alias("spans"))
    # written and read: both are as small as the years' pairs, whatever the number of records
    by_window = kept(windows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("seeds")).withColumn("w", F.monotonically_increasing_id()), "windows")
    met = kept(n_spans.join(by_window, outside).select("w", "s", "e", "spans", "seeds"), "met")
    # a window's records are dealt into parts of about PAIRS pairs, and its seeds meet each part
    parts = F.ceil(F.sum("spans") * F.first("seeds") / PAIRS).cast("int")
    dealt = kept(met.groupBy("w").agg(parts.alias("parts")), "parts")
    tasks = min(20_000, dealt.agg(F.sum("parts")).first()[0] or 1)
    asked = windows.alias("x").join(by_window.alias("b"), same("x.lo", "b.lo") & same("x.hi", "b.hi")).select("w", "seed").join(dealt, "w")
    asked = asked.select("w", "seed", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    of_window = spans.alias("r").join(met.join(dealt, "w").alias("m"), same("r.s", "m.s") & same("r.e", "m.e")).select("w", F.col("uri"), F.pmod(F.xxhash64("uri"), F.col("parts")).cast("int").alias("part"))
    spread = lambda df: df.repartition(tasks, "w", "part")
    return spread(of_window).join(spread(asked), ["w", "part"]).filter("seed <> uri").select("seed", "uri")


#: Components whose signs deal vectors into blocks.
SIGNS = 16
BLOCK_NAMES = ["block", "uris", "width", "x", "centre", "radius"]
BLOCKS = "block int, uris array<string>, width int, x binary, centre binary, radius double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of vectors as one block: unit vectors, their centre, and how far they are from it."""
    parts = [(b.column(0).to_pylist(), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)) for b in batches if b.num_rows]
    if not parts:
        return
    uris = [u for us, _ in parts for u in us]
    x = np.concatenate([m for _, m in parts])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centre = x.mean(axis=0)
    radius = float(np.linalg.norm(x - centre, axis=1).max())
    cells = [TaskContext.get().partitionId(), uris, x.shape[1], x.tobytes(), centre.tobytes(), radius]
    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.list_(pa.string()), pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)], BLOCK_NAMES)


def _blocked(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about `size` vectors that point alike: rows are dealt by range of the signs of their components, then uri."""
    v = vectors.filter("main is not null").select("uri", F.col("main").cast("array<double>").alias("main"))
    n = max(1, -(-v.count() // size))
    signs = F.array_join(F.transform(F.slice("main", 1, SIGNS), lambda c: F.when(c < 0, "0").otherwise("1")), "")
    dealt = v.repartitionByRange(n, signs, "uri") if n > 1 else v.coalesce(1)
    return kept(dealt.mapInArrow(_blocks, BLOCKS), "vector-blocks"), n


def _far(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block of queries and a part of the vectors' blocks: the distance of the centres, and the least of any two members."""
    out = []
    for q in left.to_pylist():
        centre = np.frombuffer(q["centre"])
        for b in right.to_pylist():
            d = float(np.linalg.norm(centre - np.frombuffer(b["centre"])))
            out.append((q["block"], b["block"], d, max(0.0, d - q["radius"] - b["radius"])))
    kinds = [("q", pa.int32()), ("b", pa.int32()), ("d", pa.float64()), ("least", pa.float64())]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for q, b in zip(left.to_pylist(), right.to_pylist(), strict=False):
            x, y = (np.frombuffer(m["x"]).reshape(-1, m["width"]) for m in (q, b))
            ids, uris = np.array(q["uris"], object), np.array(b["uris"], object)
            order = np.argsort(uris, kind="stable")
            y, uris = y[order], uris[order]
            for part in range(0, len(x), 256):
                # rounded, so that equal vectors have equal cosines in whichever block they are
                cos = np.round(x[part : part + 256] @ y.T, 12)
                cos[ids[part : part + 256, None] == uris[None, :]] = -np.inf
                best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                i, j = np.nonzero(np.take_along_axis(cos, best, 1) > -np.inf)
                rows.append((np.full(len(i), q["q"]), ids[part + i], uris[best[i, j]], cos[i, best[i, j]]))
        kinds = pa.schema([("q", pa.int32()), ("query", pa.string()), ("uri", pa.string()), ("cosine", pa.float64())])
        if not rows:
            return kinds.empty_table()
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        return pa.Table.from_arrays([pa.array(c.tolist(), t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(query, uri, cosine, rank) of each query's k nearest vectors by exact cosine, itself left out.

    Queries and vectors are dealt into blocks of about `block` that point alike. A block of queries first meets the block of
    vectors whose centre is nearest; the k-th best cosine found there bounds what its queries still need. Of the other
    blocks it meets those only whose members can be that near, by the triangle inequality on the centres' distance and both
    radii. Null vectors are left out. Ties go by uri; cosines are rounded to 12 digits.
    """
    v, n_blocks = _blocked(vectors, block)
    q, _ = _blocked(queries.dropDuplicates(["uri"]), block)
    n_parts = max(1, -(-n_blocks // 1024))
    centres = v.select("block", "centre", "radius", F.pmod("block", F.lit(n_parts)).alias("part"))
    asked = q.select("block", "centre", "radius", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    distances = kept(asked.groupBy("part").cogroup(centres.groupBy("part")).applyInArrow(_far, "q int, b int, d double, least double"), "distances")

    def met(pairs: DataFrame) -> DataFrame:
        left = q.withColumnRenamed("block", "q").join(pairs, "q").select("q", "b", "uris", "width", "x")
        right = v.withColumnRenamed("block", "b").join(pairs, "b").select("q", "b", "uris", "width", "x")
        return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(_best(k), "q int, query string, uri string, cosine double")

    nearest = distances.groupBy("q").agg(F.min_by("b", "d").alias("b"))
    first = kept(met(nearest), "nearest")
    kth = first.groupBy("q", "query").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
    full = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))))
    n_queries = q.select(F.col("block").alias("q"), F.size("uris").alias("all"))
    limits = kth.groupBy("q").agg(F.max(full).alias("limit"), F.count(full).alias("full")).join(n_queries, "q")
    limits = limits.select("q", F.when(F.col("full") == F.col("all"), F.col("limit")).alias("limit"))
    # the pairs of blocks that are left: neither met yet nor too far from each other
    near = distances.join(nearest.withColumnRenamed("b", "done"), "q").filter(F.col("b") != F.col("done")).join(limits, "q", "left")
    others = met(near.filter(F.col("limit").isNull() | (F.col("least") <= F.col("limit") + 1e-6)).select("q", "b"))
    pairs = first.union(others).select("query", "uri", "cosine")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "uri"))).filter(F.col("rank") <= k)
