"""Predicates and their composition. A match is a DataFrame (uri, score), one row a record.

Predicates only filter, project and join; what is broadcast and in what order joins run is left to the optimizer. A
predicate's score is its weight. Children of hops are matches themselves, joined by left semi joins, so an empty child
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.dates import complete_date, to_seconds

SAME = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def _scored(df: DataFrame, uri: str | Column, weight: float) -> DataFrame:
    return df.select((F.col(uri) if isinstance(uri, str) else uri).alias("uri")).distinct().withColumn("score", F.lit(float(weight)))


def compare(column: Column, op: str, value) -> Column:
    if op not in SAME:
        raise ValueError(f"unknown comparison {op!r}")
    return getattr(column, SAME[op])(value)


# -- predicates ---------------------------------------------------------------------------------------------------


def by_uri(docs: DataFrame, uris: Sequence[str], weight: float = 1.0) -> DataFrame:
    return _scored(docs.filter(F.col("uri").isin(list(uris))), "uri", weight)


def iri(spark: SparkSession, uris: Sequence[str], weight: float = 1.0) -> DataFrame:
    """Nodes as they are, whether or not a record exists: seeds of hops."""
    return spark.createDataFrame([(u,) for u in dict.fromkeys(uris)], "uri string").withColumn("score", F.lit(float(weight)))


def hop_inverse(triples: DataFrame, predicates: Sequence[str], child: DataFrame, weight: float = 1.0) -> DataFrame:
    """Objects of the predicates whose subject is in child."""
    t = triples.filter(F.col("predicate").isin(list(predicates)))
    return _scored(t.join(child, t["subject"] == child["uri"], "left_semi"), "object", weight)


def hop_forward(triples: DataFrame, predicates: Sequence[str], child: DataFrame, docs: DataFrame | None = None, types: Sequence[str] | None = None, weight: float = 1.0) -> DataFrame:
    """Subjects that reach child by the predicates; with docs and types, only records of these types."""
    t = triples.filter(F.col("predicate").isin(list(predicates)))
    found = t.join(child, t["object"] == child["uri"], "left_semi").select(F.col("subject").alias("uri"))
    if types is not None:
        found = found.join(docs.filter(F.col("data_type").isin(list(types))), "uri", "left_semi")
    return _scored(found, "uri", weight)


def hop_by_id(fields: DataFrame, id_fields: Sequence[str], uri: str, weight: float = 1.0) -> DataFrame:
    """A forward hop to one known record, by the field that holds its id instead of a triple join."""
    return field_value(fields, id_fields, [uri], weight)


def field_range(fields: DataFrame, field: str, op: str, value: float, weight: float = 1.0) -> DataFrame:
    """Each column is compared by itself, so that the comparisons reach the scan and longs keep all their digits."""
    exact, value = value, float(value)
    whole = value.is_integer()
    if whole or op in ("=", "!="):
        on_long = compare(F.col("v_long"), op, F.lit(int(exact))) if whole else F.lit(op == "!=")
    else:  # between two whole numbers
        on_long = compare(F.col("v_long"), ">=" if op in (">", ">=") else "<", F.lit(math.ceil(value)))
    on_float = compare(F.col("v_float"), op, F.lit(value))
    return _scored(fields.filter((F.col("field") == field) & (on_float | (F.col("v_float").isNull() & on_long))), "uri", weight)


def field_value(fields: DataFrame, names: Sequence[str], values: Sequence, weight: float = 1.0) -> DataFrame:
    texts, numbers = [v for v in values if isinstance(v, str)], [v for v in values if not isinstance(v, str)]
    same = F.col("v_str").isin(texts) if texts else F.lit(False)
    if numbers:
        same |= F.coalesce(F.col("v_float"), F.col("v_long").cast("double")).isin([float(v) for v in numbers])
    return _scored(fields.filter(F.col("field").isin(list(names)) & same), "uri", weight)


def date_range(fields: DataFrame, start_field: str, end_field: str, value: str, op: str = "=", weight: float = 1.0) -> DataFrame:
    """value is "start;end" or a start alone; a missing side borrows the other.

    < and <= compare the record's start with the completed start; > and >= its end with the completed end. So = means
    that the record's interval contains value's, and != that it starts before or ends after it.
    """
    start, _, end = value.partition(";")
    start, end = start.strip() or end.strip(), end.strip() or start.strip()
    if not start:
        raise ValueError("a date range needs a date")
    low, high = to_seconds(complete_date(F.lit(start))), to_seconds(complete_date(F.lit(end), end=True))

    def side(field: str, op: str, bound: Column) -> DataFrame:
        return fields.filter((F.col("field") == field) & compare(F.col("v_long"), op, bound))

    if op in ("<", "<="):
        return _scored(side(start_field, op, low), "uri", weight)
    if op in (">", ">="):
        return _scored(side(end_field, op, high), "uri", weight)
    if op == "=":
        return _scored(side(start_field, "<=", low).join(side(end_field, ">=", high), "uri", "left_semi"), "uri", weight)
    if op == "!=":
        return _scored(side(start_field, "<", low).select("uri").union(side(end_field, ">", high).select("uri")), "uri", weight)
    raise ValueError(f"unknown comparison {op!r}")


def record_type(docs: DataFrame, names: Sequence[str], scopes: dict[str, list[str]], weight: float = 1.0) -> DataFrame:
    """Records of the types; a scope's name stands for its types, and case doesn't matter."""
    known = {t.lower(): t for types in scopes.values() for t in types}
    types = [t for n in names for t in (scopes.get(n.lower()) or [known.get(n.lower(), n)])]
    return _scored(docs.filter(F.col("data_type").isin(types)), "uri", weight)


@dataclass(frozen=True)
class MatchOptions:
    """What must agree for a word to be found. exact compares raw tokens and wins over case, accents, stemmed and wildcarded.

    case, accents: upper and lower case, or accented and plain letters, are different. punctuation, spacing: what stands
    between the words of a value, before and after them, counts too; this needs postings with gaps.
    """

    exact: bool = False
    stemmed: bool = False
    wildcarded: bool = True
    complete: bool = False
    case: bool = False
    accents: bool = False
    punctuation: bool = False
    spacing: bool = False

    @property
    def wildcards(self) -> bool:
        return self.wildcarded and not self.exact

    def key(self, token: Column) -> Column:
        """What is compared of a raw token."""
        if self.exact:
            return token
        out = token if self.case else F.lower(token)
        if not self.accents:
            out = F.translate(out, T.ACCENTED + T.ACCENTED.upper(), T.PLAIN + T.PLAIN.upper()) if self.case else T.fold(out)
        return T.stem(out) if self.stemmed else out

    def column(self) -> Column:
        """key of a posting's token, from the stored columns where they hold it."""
        if self.exact or self.case or self.accents:
            return self.key(F.col("token"))
        return F.col("stem" if self.stemmed else "folded")


def build_postings(fields: DataFrame, gaps: bool = False) -> DataFrame:
    """(uri, field, pos, token, folded, stem): the words of text fields; with gaps, also what stands before and after each.

    Texts are dealt over all tasks first: a file may hold many of them in one row group, which one task reads.
    """
    texts = fields.filter("v_str is not null").repartition("uri")
    if gaps:
        parts = texts.select("uri", "field", T.tokens(F.col("v_str")).alias("token"), F.split("v_str", T.WORD).alias("between"))
        # zipped before they are exploded, so that no row carries all gaps of its text
        parts = parts.select("uri", "field", "token", F.slice("between", 1, F.size("token")).alias("before"), F.slice("between", 2, F.size("token")).alias("after"))
        words = parts.select("uri", "field", F.posexplode(F.arrays_zip("token", "before", "after")).alias("pos", "word")).select("uri", "field", "pos", "word.*")
    else:
        words = texts.select("uri", "field", F.posexplode(T.tokens(F.col("v_str"))).alias("pos", "token"))
    return words.withColumn("folded", T.fold(F.col("token"))).withColumn("stem", T.stem(F.col("folded")))


def field_word(postings: DataFrame, names: Sequence[str], value: str, options: MatchOptions = MatchOptions(), weight: float = 1.0) -> DataFrame:
    """Records with the word, the phrase (words at consecutive places of one field) or the wildcard word.

    complete: the field holds these words and nothing else.
    """
    import re

    p = postings.filter(F.col("field").isin(list(names)))
    if options.wildcards:
        value = T.checked_wildcards(value)
    word = r"[^\W_]" if not options.wildcards else r"(?:[^\W_]|[*?])"
    words, between = re.findall(word + "+", value), re.split(word + "+", value.strip())
    if not words:
        raise ValueError("nothing to search for")

    def is_word(i: int) -> Column:
        wanted = options.key(F.lit(words[i]))
        if options.wildcards and re.search(r"[*?]", words[i]):
            plain = MatchOptions(case=options.case, accents=options.accents)  # a part of a word has no stem
            pattern = F.concat(*[F.lit({"*": ".*", "?": "."}[x]) if x in "*?" else plain.key(F.lit(x)) for x in re.findall(r"[*?]|[^*?]+", words[i])])
            found = F.rlike(plain.column(), F.concat(F.lit("^"), pattern, F.lit("$")))
        else:
            found = options.column() == wanted
        return found & _gaps_agree(between, i, options) if options.punctuation or options.spacing else found

    if len(words) == 1 and not options.complete:
        return _scored(p.filter(is_word(0)), "uri", weight)
    # one pass: each occurrence of the i-th word votes for the place where the phrase would begin
    met = F.array_compact(F.array(*[F.when(is_word(i), F.lit(i)) for i in range(len(words))]))
    hits = p.select("uri", "field", "pos", F.explode(met).alias("i")).select("uri", "field", (F.col("pos") - F.col("i")).alias("at"), "i")
    found = hits.groupBy("uri", "field", "at").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(words))
    if options.complete:
        long = p.filter(F.col("pos") >= len(words)).select("uri", "field")
        found = found.filter("at = 0").join(long, ["uri", "field"], "left_anti")
    return _scored(found, "uri", weight)


def _gaps_agree(between: list[str], i: int, options: MatchOptions) -> Column:
    """Whether what stands before and after a posting is what the value has around its i-th word.

    Between two words both must be equal; before the first and after the last the record may have more, unless the whole
    field is compared.
    """

    def kept(gap: Column) -> Column:
        if not options.punctuation:
            return F.regexp_replace(gap, r"\S+", "")
        return gap if options.spacing else F.regexp_replace(gap, r"\s+", "")

    before, after = kept(F.col("before")), kept(F.col("after"))
    first, last = kept(F.lit(between[i])), kept(F.lit(between[i + 1]))
    ends = options.complete
    return (before.endswith(first) if i == 0 and not ends else before == first) & (after.startswith(last) if i == len(between) - 2 and not ends else after == last)


def keyword(postings: DataFrame, names: Sequence[str], value: str, options: MatchOptions = MatchOptions(), weight: float = 1.0) -> DataFrame | None:
    """An unquoted value of several words is the AND of its words and phrases; ignorable ones are left out; None if nothing is left."""
    import re

    parts = [value] if options.complete else [w.strip('"') for w in re.findall(r'"[^"]*"|[^\s"]+', value)]
    parts = [w for w in parts if re.search(r"\w", w) and (len(parts) > 1 or w.lower() not in T.STOP_WORDS)]
    return and_(*[field_word(postings, names, w, options, weight) for w in parts]) if parts else None


def text_match(postings: DataFrame, triples: DataFrame, any_field: str, any_predicate: str, value: str, name_field: str = "referenceName", weight: float = 1.0) -> DataFrame:
    """Records with the text in their own any-text field, or linked by any_predicate to a record with the text in its name."""
    own, linked = keyword(postings, [any_field], value, weight=weight), keyword(postings, [name_field], value)
    if own is None or linked is None:
        raise ValueError("nothing to search for")
    return or_(own, hop_forward(triples, [any_predicate], linked, weight=weight))


def related_filter(triples: DataFrame, paths: dict[str, list[tuple[str, bool]]], uri: str, weight: float = 1.0) -> DataFrame:
    """Records that any of the paths reaches from uri. A path is a list of (predicate, forward)."""
    spark = triples.sparkSession
    ends = []
    for path in paths.values():
        m = iri(spark, [uri])
        for predicate, forward in path:
            m = hop_inverse(triples, [predicate], m) if forward else hop_forward(triples, [predicate], m)
        ends.append(m.select("uri"))
    return _scored(reduce(DataFrame.union, ends).filter(F.col("uri") != uri), "uri", weight)


# -- composition --------------------------------------------------------------------------------------------------


def _left(operator: str, matches: Sequence[DataFrame | None]) -> list[DataFrame]:
    """The operands that are not None; None stands for a term that is left out, such as a stop word."""
    left = [m for m in matches if m is not None]
    if not left:
        raise ValueError(f"{operator} of nothing")
    return left


def and_(*operands: DataFrame | None) -> DataFrame:
    """Records in all matches; scores add up. A term that is left out (None) is true."""
    matches = _left("AND", operands)
    if len(matches) == 1:
        return matches[0]
    out = matches[0].withColumnRenamed("score", "s0")
    for i, m in enumerate(matches[1:], 1):
        out = out.join(m.withColumnRenamed("score", f"s{i}"), "uri")
    return out.select("uri", reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(matches))]).alias("score"))


def or_(*operands: DataFrame | None) -> DataFrame:
    """Records in any match; scores add up. One operand is returned as it is. A term that is left out (None) is false."""
    matches = _left("OR", operands)
    if len(matches) == 1:
        return matches[0]
    return reduce(DataFrame.unionByName, matches).groupBy("uri").agg(F.sum("score").alias("score"))


def not_(universe: DataFrame, *matches: DataFrame) -> DataFrame:
    """Records of universe in none of the matches."""
    out = universe.select("uri")
    for m in matches:
        out = out.join(m, "uri", "left_anti")
    return _scored(out, "uri", 1.0)


def boost(match: DataFrame | None, booster: DataFrame | None) -> DataFrame:
    """match; records that are in booster too score higher. A booster that is left out (None) raises no score."""
    (match,) = _left("BOOST", [match])
    if booster is None:
        return match
    b = booster.select("uri", F.col("score").alias("more"))
    return match.join(b, "uri", "left").select("uri", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def in_types(match: DataFrame, docs: DataFrame, types: Sequence[str]) -> DataFrame:
    """The type constraint of a scope."""
    return match.join(docs.filter(F.col("data_type").isin(list(types))), "uri", "left_semi")


def multi_scope(branches: dict[str, DataFrame], docs: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """The OR of matches, each in its own scope."""
    if not branches:
        raise ValueError("a multi-scope search needs a branch")
    return or_(*[in_types(m, docs, scopes[s]) for s, m in branches.items()])


def relevance(postings: DataFrame, names: Sequence[str], weighted: dict[str, float]) -> DataFrame:
    """(uri, score): sum over words of weight * (1 + ln tf) * ln(1 + N / df), N the records that have a word at all."""
    p = postings.filter(F.col("field").isin(list(names)))
    spark = p.sparkSession
    w = spark.createDataFrame([(k, float(v)) for k, v in weighted.items()], "word string, weight double").withColumn("folded", T.fold(F.col("word")))
    tf = p.join(F.broadcast(w), "folded").groupBy("uri", "folded", "weight").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("folded").agg(F.count(F.lit(1)).alias("df"))
    n = p.filter("pos = 0").agg(F.count_distinct("uri").alias("n"))  # one token a field
    s = tf.join(df, "folded").crossJoin(F.broadcast(n))  # one row
    return s.groupBy("uri").agg(F.sum(F.col("weight") * (1 + F.log("tf")) * F.log(1 + F.col("n") / F.col("df"))).alias("score"))
