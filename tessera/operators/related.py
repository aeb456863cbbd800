"""Related records over one- and two-hop paths.

A path is (key, first, first_forward, second, second_forward): the two predicates and whether each is followed from
subject to object. From a start record the first hop leads to an object of a middle scope, the second to the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import camel_words
from tessera.sources.scratch import kept

#: Ends of a middle above which it counts as heavy; buckets that middles are counted by; starts that triples meet as they are.
HEAVY, BUCKETS, FEW = 1000, 1 << 20, 20_000

Path = tuple[str, str, bool, str, bool]


def _hop(triples: DataFrame, predicate: str, forward: bool) -> DataFrame:
    a, b = ("subject", "object") if forward else ("object", "subject")
    return triples.filter(F.col("predicate") == predicate).select(F.col(a).alias("a"), F.col(b).alias("b"))


def _sides(triples: DataFrame, path: Path, starts: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """(start, mid) and (mid, uri): the triples of the two hops, of the asked starts only.

    Where starts are many, those of the first hop that aren't asked are looked for instead, each once: mostly these are few
    or none, so that the triples need not meet the starts.
    """
    _, first, first_forward, second, second_forward = path
    one = _hop(triples, first, first_forward).toDF("start", "mid")
    if few:
        one = one.join(starts, "start", "left_semi")
    else:
        one = one.join(kept(one.select("start").distinct().join(starts, "start", "left_anti"), "strangers"), "start", "left_anti")
    return one, _hop(triples, second, second_forward).toDF("mid", "uri")


def _hubs(one: DataFrame, two: DataFrame, heavy: int) -> DataFrame:
    """(mid, starts, ends) of the middles with more than `heavy` triples of a hop.

    Triples are counted by bucket first, which tasks add up before anything is exchanged; only those of buckets with more
    than `heavy` are counted by middle.
    """
    bucket = F.pmod(F.xxhash64("mid"), F.lit(BUCKETS)).cast("int").alias("bucket")
    of = lambda last: F.col("last") == last
    mids = one.select("mid", F.lit(False).alias("last")).union(two.select("mid", F.lit(True).alias("last"))).select("mid", "last", bucket)
    full = kept(mids.groupBy("last", "bucket").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > heavy).select("bucket").distinct(), "full-buckets")
    counts = mids.join(full, "bucket", "left_semi").groupBy("mid").agg(F.count_if(~of(True)).alias("starts"), F.count_if(of(True)).alias("ends"))
    return kept(counts.filter((F.col("starts") > heavy) | (F.col("ends") > heavy)), "hubs")


def _counted(two: DataFrame) -> DataFrame:
    return two.groupBy("mid", "uri").agg(F.count(F.lit(1)).alias("c"))


def _pairs(one: DataFrame, two: DataFrame, hubs: DataFrame) -> DataFrame:
    """(start, uri, c) for each middle between a start and another record; c counts the triples of the last hop.

    Both hops are exchanged once, by middle, and made unique, counted and joined where they lie. Hubs are not among these:
    their ends are dealt into parts, and their starts meet each part, so that no task holds a whole middle.
    """
    light = one.join(hubs, "mid", "left_anti").repartition("mid").distinct().join(_counted(two.join(hubs, "mid", "left_anti").repartition("mid")), "mid")
    pairs = light.filter("start <> uri").select("start", "uri", "c")
    if hubs.isEmpty():
        return pairs
    parts = hubs.select("mid", F.ceil(F.greatest(F.col("ends"), F.lit(1)) / HEAVY).cast("int").alias("parts"))
    dealt = _counted(two.join(hubs, "mid", "left_semi")).join(parts, "mid").select("mid", F.pmod(F.xxhash64("uri"), F.col("parts")).alias("part"), "uri", "c")
    spread = one.join(hubs, "mid", "left_semi").distinct().join(parts, "mid").select("start", "mid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    return pairs.union(spread.join(dealt, ["mid", "part"]).filter("start <> uri").select("start", "uri", "c"))


def _n(path: Path, of: Column | None = None) -> Column:
    """A last hop from subject to object counts its triples with duplicates; one against the arrow counts distinct records."""
    only = lambda c: c if of is None else F.when(of, c)
    return F.sum(only(F.col("c"))) if path[4] else F.max(only(F.lit(1).cast("long")))


def _all_ends(triples: DataFrame, paths: Sequence[Path], starts: DataFrame, few: bool) -> DataFrame:
    """(start, uri, key, n, total): how often each path leads from start to uri, the paths counted side by side in one exchange."""
    found = []
    for i, path in enumerate(paths):
        one, two = _sides(triples, path, starts, few)
        found.append(_pairs(one, two, _hubs(one, two, HEAVY)).withColumn("path", F.lit(i)))
    counts = reduce(DataFrame.union, found).groupBy("start", "uri").agg(*[_n(p, F.col("path") == i).alias(f"n{i}") for i, p in enumerate(paths)])
    each = F.array(*[F.struct(F.lit(p[0]).alias("key"), F.col(f"n{i}").alias("n")) for i, p in enumerate(paths)])
    total = reduce(lambda a, b: a + b, [F.coalesce(f"n{i}", F.lit(0).cast("long")) for i in range(len(paths))])
    return counts.select("start", "uri", total.alias("total"), F.inline(F.filter(each, lambda x: x["n"].isNotNull()))).select("start", "uri", "key", "n", "total")


def _first_ends(triples: DataFrame, path: Path, starts: DataFrame, few: bool, cap: int, heavy: int) -> DataFrame:
    """The first `cap` rows of _all_ends of each start, by n, then uri, without listing what middles with many ends lead to.

    Starts with the same set of heavy middles reach the same ends through them equally often, so those counts are taken once
    a set. An end that a start reaches by heavy middles alone has behind it only ends that come after it in the set's order:
    it is among the set's first cap + 1 (the start itself may be one) or not among the start's first cap. These, and the ends
    that light middles lead to, are the candidates; both kinds get their count by light and by heavy middles added up.
    """
    one, two = _sides(triples, path, starts, few)
    hubs = _hubs(one, two, heavy)
    many = kept(hubs.filter(F.col("ends") > heavy).select("mid"), "heavy")
    summed = lambda rows: rows.groupBy("start", "uri").agg(_n(path).alias("n"))
    if many.isEmpty():
        return _ranked(summed(_pairs(one, two, hubs)), path, cap)
    rest = lambda hop: hop.join(many, "mid", "left_anti")
    light = summed(_pairs(rest(one), rest(two), rest(hubs)))
    sets = kept(one.join(many, "mid", "left_semi").groupBy("start").agg(F.sort_array(F.collect_set("mid")).alias("mids")), "heavy-sets")
    members = sets.select("mids").distinct().select("mids", F.explode("mids").alias("mid"))
    by_set = members.join(_counted(two.join(many, "mid", "left_semi")), "mid").groupBy("mids", "uri").agg(_n(path).alias("by_heavy"))
    by_set = kept(by_set, "heavy-ends")
    place = F.row_number().over(Window.partitionBy("mids").orderBy(F.desc("by_heavy"), "uri"))
    firsts = by_set.withColumn("place", place).filter(F.col("place") <= cap + 1)
    through = sets.join(firsts, "mids").filter("start <> uri").select("start", "uri", "mids", "by_heavy")
    reached = light.join(sets, "start", "left").join(by_set, ["mids", "uri"], "left").select("start", "uri", "n", "by_heavy")
    both = through.join(light.select("start", "uri"), ["start", "uri"], "left_anti").select("start", "uri", F.lit(None).cast("long").alias("n"), "by_heavy").union(reached)
    zero = F.lit(0).cast("long")
    n = F.coalesce("n", zero) + F.coalesce("by_heavy", zero) if path[4] else F.lit(1).cast("long")
    return _ranked(both.select("start", "uri", n.alias("n")), path, cap)


def _ranked(counts: DataFrame, path: Path, cap: int) -> DataFrame:
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), "uri")))
    return ranked.filter(F.col("r") <= cap).select("start", "uri", F.lit(path[0]).alias("key"), "n")


def related(triples: DataFrame, paths: Sequence[Path], start: DataFrame, cap: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(start, uri, key, n, total) for all records in start (one column uri): relations of all of them in the same joins.

    cap keeps that many records of each relation, those with the highest counts; middles with more than `heavy` ends are then
    not listed start by start.
    """
    starts = kept(start.select(F.col("uri").alias("start")).distinct(), "starts")
    few = starts.count() <= FEW
    if cap is None:
        return _all_ends(triples, paths, starts, few)
    rows = reduce(DataFrame.unionByName, [_first_ends(triples, p, starts, few, cap, heavy) for p in paths])
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("start", "uri")))


def related_page(rows: DataFrame, page: int = 1, length: int = 10) -> DataFrame:
    """Whole records of one page, the most related first, each with its relations."""
    place = F.dense_rank().over(Window.partitionBy("start").orderBy(F.desc("total"), "uri"))
    return rows.withColumn("place", place).filter((F.col("place") > (page - 1) * length) & (F.col("place") <= page * length)).orderBy("start", "place", F.desc("n"), "key")


def has_related(triples: DataFrame, paths: Sequence[Path], start: DataFrame) -> DataFrame:
    """One row a start record: whether it has any related record.

    No end is listed: a middle leads to another record than the start if the first or the last of its ends is another.
    """
    s = start.select(F.col("uri").alias("start")).distinct()
    found = []
    for _, first, first_forward, second, second_forward in paths:
        one = _hop(triples, first, first_forward).join(s, F.col("a") == F.col("start")).select("start", F.col("b").alias("mid"))
        ends = _hop(triples, second, second_forward).groupBy(F.col("a").alias("mid")).agg(F.min("b").alias("least"), F.max("b").alias("most"))
        found.append(one.join(ends, "mid").filter("least <> start or most <> start").select(F.col("start").alias("f")))
    any_ = reduce(DataFrame.union, found).distinct()
    return s.join(any_, F.col("start") == F.col("f"), "left").select("start", F.col("f").isNotNull().alias("related"))


def connecting(triples: DataFrame, path: Path, start: str, end: str) -> DataFrame:
    """(uri): the records in the middle of a path between two records."""
    _, first, first_forward, second, second_forward = path
    a = _hop(triples, first, first_forward).filter(F.col("a") == start).select(F.col("b").alias("uri"))
    b = _hop(triples, second, second_forward).filter(F.col("b") == end).select(F.col("a").alias("uri"))
    return a.join(b, "uri", "left_semi").distinct()


def schema_edges(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """(from_type, predicate, to_type, n): what predicates link which types, found from the data."""
    d = docs.select("uri", "data_type")
    s, o = d.toDF("subject", "from_type"), d.toDF("object", "to_type")
    return triples.join(s, "subject").join(o, "object").groupBy("from_type", "predicate", "to_type").agg(F.count(F.lit(1)).alias("n"))


def relation_paths(edges: DataFrame, start: Sequence[str], middle: Sequence[str], end: Sequence[str], suppressed: Sequence[str] = ()) -> DataFrame:
    """(key, first, first_forward, mid_type, second, second_forward, start_type, end_type): all two-hop paths of the schema."""
    f = edges.select(F.col("from_type").alias("x"), "predicate", F.lit(True).alias("forward"), F.col("to_type").alias("y"))
    both = f.union(edges.select(F.col("to_type"), "predicate", F.lit(False), F.col("from_type")))
    a = both.filter(F.col("x").isin(list(start)) & F.col("y").isin(list(middle))).toDF("start_type", "first", "first_forward", "mid_type")
    b = both.filter(F.col("x").isin(list(middle)) & F.col("y").isin(list(end))).toDF("mid_type", "second", "second_forward", "end_type")
    back = (F.col("first") == F.col("second")) & (F.col("first_forward") != F.col("second_forward")) & (F.col("start_type") != F.col("end_type"))
    keyed = a.join(b, "mid_type").filter(~back).withColumn("key", F.concat_ws("-", "start_type", "first", "second", "end_type"))
    return keyed.filter(~F.col("key").isin(list(suppressed)))


def path_labels(paths: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """paths with a label: the one of labels (key, label), else the first predicate in words."""
    words = camel_words(F.regexp_replace("first", "^P[0-9]+i?_", ""))
    if labels is None:
        return paths.withColumn("label", words)
    return paths.join(labels, "key", "left").withColumn("label", F.coalesce("label", words))


def path_statistics(paths: DataFrame) -> DataFrame:
    """(start_type, end_type, paths): how many paths each related list has."""
    return paths.groupBy("start_type", "end_type").agg(F.count(F.lit(1)).alias("paths"))
