"""JSON records: loading, slices, typed fields, triples, vectors, exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import to_seconds


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One JSON record a line, gzipped or not: (docs, corrupt). The key is json.id; lines without it, or without JSON, are corrupt."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).filter(F.trim("value") != "")
    v = lines.select("value", F.try_parse_json("value").alias("v"))
    keyed = v.select("value", F.try_variant_get("v", "$.json.id", "string").alias("uri"), F.try_variant_get("v", "$.json.type", "string").alias("data_type"), F.try_variant_get("v", "$.admin.sources", "array<string>").alias("sources"), "v")
    docs = keyed.filter("uri is not null").select("uri", "data_type", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.to_json("v").alias("json"))
    return docs, keyed.filter("uri is null").select("value")


def assign_slices(docs: DataFrame, everything: str = "all", reader: str = "%s-reader") -> DataFrame:
    """docs with collections: the lower-case sources and an application-wide one; and readers: one tag a source."""
    low = F.transform("sources", F.lower)
    return docs.withColumn("collections", F.array_union(low, F.array(F.lit(everything)))).withColumn("readers", F.transform(low, lambda s: F.format_string(reader, s)))


@dataclass(frozen=True)
class FieldSpec:
    """A field: the union of JSON paths, of kind text, date, number or id. Steps go through arrays by themselves."""

    name: str
    paths: tuple[str, ...]
    kind: str = "text"


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _items(v: Column) -> Column:
    """An array's items, or the value alone."""
    return F.when(_is(v, "ARRAY"), v.try_cast("array<variant>")).otherwise(F.array(v))


def _below(at: Column, step: str) -> Column:
    """What the values at a node of the path trie hold under one more step; arrays are gone through."""
    found = F.transform(at, lambda x: F.try_variant_get(x, f"$.{step}", "variant"))
    return F.flatten(F.transform(F.filter(found, lambda v: v.isNotNull()), _items))


def _text(v: Column) -> Column:
    return F.when(_is(v, "OBJECT") | _is(v, "ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def extract_fields(docs: DataFrame, spec: Sequence[FieldSpec]) -> DataFrame:
    """(uri, field, v_str, v_long, v_float): typed values; those that can't be read are left out, not errors.

    One pass, whatever the number of fields: each record is parsed once, the paths of all fields make a trie of which each
    node is read from its parent's values once, and the fields' values are exploded together.
    """
    at = docs.select("uri", F.array(F.try_parse_json("json")).alias("p"))
    node = {"": "p"}
    paths = sorted({p for f in spec for p in f.paths})
    for depth in range(1, 1 + max((p.count(".") + 1 for p in paths), default=0)):
        new = {}
        for p in paths:
            steps = p.split(".")
            if len(steps) >= depth:
                new.setdefault(".".join(steps[:depth]), (".".join(steps[: depth - 1]), steps[depth - 1]))
        named = {path: f"p{len(node) + i}" for i, path in enumerate(new)}
        at = at.select("*", *[_below(F.col(node[parent]), step).alias(named[path]) for path, (parent, step) in new.items()])
        node |= named
    rows = []
    for f in spec:
        values = F.array_distinct(F.filter(F.transform(F.flatten(F.array(*[F.col(node[p]) for p in f.paths])), _text), lambda x: x.isNotNull()))
        rows.append(F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), values.alias("values")))
    each = at.select("uri", F.explode(F.array(*rows)).alias("f")).select("uri", "f.field", "f.kind", F.explode("f.values").alias("v"))
    kind = F.col("kind")
    typed = each.select("uri", "field", F.when(kind.isin("text", "id"), F.col("v")).alias("v_str"), F.when(kind == "date", to_seconds(F.col("v"))).alias("v_long"), F.when(kind == "number", F.col("v").try_cast("double")).alias("v_float"))
    return typed.filter("v_str is not null or v_long is not null or v_float is not null")


def record_triples(docs: DataFrame) -> DataFrame:
    """(subject, predicate, object, src_uri) of the triples embedded in records."""
    schema = "struct<triples: array<struct<triple: struct<subject: string, predicate: string, object: string>>>>"
    t = docs.select("uri", F.explode(F.from_json("json", schema)["triples"]).alias("t"))
    return t.select("t.triple.subject", "t.triple.predicate", "t.triple.object", F.col("uri").alias("src_uri")).filter("subject is not null and predicate is not null and object is not null")


_SET = """struct<json: struct<id: string, type: string,
  about: array<struct<id: string, type: string, created_by: struct<influenced_by: array<struct<id: string, type: string>>>>>,
  classified_as: array<struct<id: string>>, containing: array<struct<id: string>>, created_by: struct<carried_out_by: array<struct<id: string>>>>>"""


def set_triples(docs: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """Triples derived from sets: what they are about (directly and by influence), their classes, members and creators.

    Members point to the set, all others from the set.
    """
    scopes_of: dict[str, list[str]] = {}
    for scope, types in scopes.items():
        for t in types if scope != "reference" else []:
            scopes_of.setdefault(t, []).append(scope)
    s = docs.select(F.from_json("json", _SET)["json"].alias("j"), "uri").filter("j.type = 'Set'")
    listed = lambda column, f: F.coalesce(F.transform(column, f), F.array())
    triple = lambda subject, predicate, object_: F.struct(subject.alias("subject"), predicate.alias("predicate"), object_.alias("object"))
    node = lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"))
    through = F.flatten(listed(F.col("j.about"), lambda a: listed(a["created_by"]["influenced_by"], node)))
    about = F.concat(listed(F.col("j.about"), node), through)

    def linked(scope: str) -> Column:
        of_scope = F.filter(about, lambda a: a["type"].isin([t for t, found in scopes_of.items() if scope in found]))
        return F.transform(of_scope, lambda a: triple(F.col("uri"), F.lit(f"about_or_depicts_{scope}"), a["id"]))

    def out(path: str, predicate: str, reverse: bool = False) -> Column:
        return listed(F.col(path), lambda o: triple(*(x for x in ((o["id"], F.lit(predicate), F.col("uri")) if reverse else (F.col("uri"), F.lit(predicate), o["id"])))))

    all_ = [*(linked(x) for x in dict.fromkeys(x for found in scopes_of.values() for x in found)), out("j.classified_as", "setClassifiedAs"), out("j.containing", "member_of", True), out("j.created_by.carried_out_by", "agentOfCreation")]
    # a record is parsed once for all its triples
    rows = s.select(F.col("uri").alias("src_uri"), F.inline(F.concat(*all_))).select("subject", "predicate", "object", "src_uri")
    return rows.filter("subject is not null and object is not null").distinct()


def vector_view(docs: DataFrame, dimension: int) -> DataFrame:
    """(uri, data_type, main) of records with a vector; one of another length is an error."""
    v = docs.select("uri", "data_type", F.from_json("json", "struct<vectors: struct<main: array<float>>>")["vectors"]["main"].alias("main")).filter("main is not null")
    bad = F.raise_error(F.concat(F.lit("not a vector of the right length: "), F.col("uri"))).cast("array<float>")
    return v.select("uri", "data_type", F.when((F.size("main") == dimension) & ~F.exists("main", lambda x: x.isNull()), F.col("main")).otherwise(bad).alias("main"))


def export_slice(docs: DataFrame, collections: Sequence[str], path: str) -> None:
    """Records of any of the collections, as Parquet."""
    docs.filter(F.arrays_overlap("collections", F.array(*[F.lit(c) for c in collections]))).write.parquet(path)


def import_slice(docs: DataFrame, path: str) -> DataFrame:
    """docs with the exported records put back: an exported record replaces the one with its uri."""
    back = docs.sparkSession.read.parquet(path)
    return docs.join(back, "uri", "left_anti").unionByName(back, allowMissingColumns=True)


def drop_slice(docs: DataFrame, collections: Sequence[str]) -> DataFrame:
    return docs.filter(~F.coalesce(F.arrays_overlap("collections", F.array(*[F.lit(c) for c in collections])), F.lit(False)))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Triples by predicate, fields by field, docs by data_type: later filters on it read only their folders."""
    df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(path)  # as many tasks as a folder's size needs
