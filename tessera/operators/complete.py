"""Name completion, by a scan of the names or by an index of their words' beginnings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_all

MAX_PAGE = 10


#: Characters of a beginning that the index keeps; longer searches are compared with the whole name among those that agree so far.
KEPT = 64


def name_index(fields: DataFrame) -> DataFrame:
    """(field, start, folded, uri): for each word of each name, the folded name from that word on, cut after KEPT characters, and all of it."""
    names = fields.filter("v_str is not null").select("field", "uri", fold_all(F.col("v_str")).alias("folded"))
    words = F.split("folded", " ")
    from_word = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.substring(F.array_join(F.slice(words, i, KEPT), " "), 1, KEPT))
    return names.select("field", F.explode(F.array_distinct(from_word)).alias("start"), "folded", "uri")


def write_name_index(index: DataFrame, path: str) -> None:
    """In order of field and beginning over all files, so that their statistics leave only those that hold a prefix to be read."""
    index.repartitionByRange("field", "start").sortWithinPartitions("field", "start").write.parquet(path)


def complete_names(
    fields: DataFrame, names_field: str, prefix: str, context_field: str | None = None, alternatives: bool = False, page: int = 1, length: int = MAX_PAGE, index: DataFrame | None = None
) -> DataFrame:
    """(uri, names): records with a name that has a word beginning with the text, and all their primary names in order.

    context_field keeps only records that some record's field references. alternatives searches the field of all names
    (the primary names' field without "Primary") and still returns primary names. index is a stored name_index; without it
    all names of the field are looked through.
    """
    searched = names_field.replace("Primary", "") if alternatives else names_field
    folded = " ".join(re.split(r"\W+", prefix.lower())).strip()
    if not folded:
        raise ValueError("nothing to complete")
    whole = F.lit(True) if index is not None and len(folded) <= KEPT else (fold_all(F.col("v_str")) if index is None else F.col("folded")).rlike(r"(^| )" + re.escape(folded))
    if index is None:
        own = fields.filter((F.col("field") == searched) & whole)
    else:
        own = index.filter((F.col("field") == searched) & F.col("start").startswith(folded[:KEPT]) & whole)
    found = own.select("uri").distinct()
    if context_field:
        used = fields.filter(F.col("field") == context_field).select(F.col("v_str").alias("uri"))
        found = found.join(used, "uri", "left_semi")
    primary = fields.filter(F.col("field") == names_field).join(found, "uri", "left_semi")
    out = primary.groupBy("uri").agg(F.array_join(F.sort_array(F.collect_set("v_str")), " | ").alias("names"))
    return out.orderBy("names", "uri").offset((page - 1) * length).limit(length)
