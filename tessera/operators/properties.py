"""An index of JSON properties: what each record says under each property name, at any depth.

Spark's own parser decides which texts are JSON; each of these is then walked once, in its task, by a small helper that
gives a row for each scalar, object and array. An array's items belong to the array's property, however deep arrays nest;
an object's values belong to its own properties. Stored by property (`sources.records`' write_partitioned), a search reads
the folders of the properties that it names; built for a search, the index is made of the properties that it names only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from json import JSONDecoder

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

COLUMNS = ["uri", "property", "kind", "v_str", "v_num", "v_bool"]
SCHEMA = "uri string, property string, kind string, v_str string, v_num double, v_bool boolean"
#: What Python makes of JSON; whole numbers are read as floats.
KINDS = {dict: "object", list: "array", str: "text", bool: "boolean", type(None): "null", float: "number"}
#: Rows of the index that are handed on at once.
ROWS = 50_000


def _walk(names: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = JSONDecoder(parse_int=float, strict=False).raw_decode
        kinds = [("uri", pa.string()), ("property", pa.string()), ("kind", pa.string()), ("v_str", pa.string()), ("v_num", pa.float64()), ("v_bool", pa.bool_())]
        schema = pa.schema(kinds)
        # half of a character, which JSON can write and UTF-8 can't, becomes "?", as in Spark's parser
        whole = lambda x: x if x.isascii() else x.encode("utf-8", "replace").decode()

        def batch(columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=schema)

        for b in batches:
            columns: list[list] = [[] for _ in kinds]
            uris, properties, names_of_kinds, texts, numbers, booleans = columns
            for uri, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                left = [(None, parse(text.lstrip(" \t\n\r"))[0])]
                while left:
                    name, v = left.pop()
                    kind = KINDS[type(v)]
                    if kind == "object":
                        left += v.items()
                    elif kind == "array":
                        left += [(name, x) for x in v]
                    if name is None or (names is not None and name not in names):
                        continue
                    uris.append(uri)
                    properties.append(whole(name))
                    names_of_kinds.append(kind)
                    texts.append(whole(v) if kind == "text" else None)
                    numbers.append(v + 0.0 if kind == "number" else None)  # no negative zero
                    booleans.append(v if kind == "boolean" else None)
                if len(uris) >= ROWS:
                    yield batch(columns)
                    for c in columns:
                        c.clear()
            if uris:
                yield batch(columns)

    return run


def property_rows(docs: DataFrame, json: str = "json", names: Sequence[str] | None = None) -> DataFrame:
    """property_index for a search made at once: rows of equal values may repeat, which makes no difference to a match."""
    j = F.col(json).cast("string")
    texts = docs.select("uri", j.alias("json")).filter(F.try_parse_json(F.col("json")).isNotNull())
    return texts.mapInArrow(_walk(None if names is None else frozenset(names)), SCHEMA)


def property_index(docs: DataFrame, json: str = "json", names: Sequence[str] | None = None) -> DataFrame:
    """(uri, property, kind, v_str, v_num, v_bool): a row for each distinct value of each property of each record.

    kind is text, number, boolean, null, object or array; the last three have no value. Text that is no JSON has no rows.
    A date or time is text in JSON. Numbers are compared as doubles, so 7 and 7.0 are one value. names: the properties that
    are asked for, all by default; every record is walked whole in any case.
    """
    return property_rows(docs, json, names).distinct()


def holds_value(value, exact: bool = True) -> Column:
    """Rows of the index with the value. Not exact: texts are compared folded, without punctuation."""
    if value is None:
        return F.col("kind") == "null"
    if isinstance(value, bool):
        return F.col("v_bool") == value
    if isinstance(value, str):
        return F.col("v_str") == value if exact else T.fold_all(F.col("v_str")) == T.fold_all(F.lit(value))
    return F.col("v_num") == float(value)


def property_value(index: DataFrame, names: Sequence[str], values: Sequence, weight: float = 1.0, exact: bool = True) -> DataFrame:
    """A match of the records in which one of the properties has one of the values, itself or in an array."""
    if not values:
        raise ValueError("a property search needs a value")
    any_value = reduce(lambda a, b: a | b, [holds_value(v, exact) for v in values])
    found = index.filter(F.col("property").isin(list(names)) & any_value)
    return found.select("uri").distinct().withColumn("score", F.lit(float(weight)))


def property_search(docs: DataFrame, index: DataFrame, types: Sequence[str] = (), present: Sequence[str] = (), values: Mapping[str, object] = {}, exact: bool = True) -> DataFrame:
    """A match of the records of one of the types that have all of the properties and all of the values (a list: each of them).

    One pass over the named properties' rows: what is asked has a bit, and a record must have all bits.
    """
    asked = [F.col("property") == n for n in dict.fromkeys(present)]
    for name, value in values.items():
        asked += [(F.col("property") == name) & holds_value(v, exact) for v in (value if isinstance(value, (list, tuple)) else [value])]
    of_type = docs.filter(F.col("data_type").isin(list(types))) if types else docs
    found = of_type.select("uri").distinct()
    if asked:
        # a bit for each thing that is asked, 62 a number
        bits = [sum((F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(asked[k : k + 62])), F.lit(0).cast("long")) for k in range(0, len(asked), 62)]
        all_bits = [(1 << len(asked[k : k + 62])) - 1 for k in range(0, len(asked), 62)]
        named = index.filter(F.col("property").isin([*present, *values]) & reduce(lambda a, b: a | b, asked))
        met = named.groupBy("uri").agg(*[F.bit_or(b).alias(f"b{i}") for i, b in enumerate(bits)])
        all_met = met.filter(reduce(lambda a, b: a & b, [F.col(f"b{i}") == n for i, n in enumerate(all_bits)]))
        found = found.join(all_met, "uri", "left_semi")
    return found.withColumn("score", F.lit(1.0))
