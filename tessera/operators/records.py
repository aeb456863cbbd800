"""Profiles of records, batches of changes to user-made records, validation and visibility. Records are docs (uri, data_type, json, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of user-made sets: characters of names, notes and labels, and number of notes.
MAX_NAME, MAX_NOTE, MAX_LABEL, MAX_NOTES = 200, 500, 200, 30

_REF = "struct<id: string, type: string, _label: string>"
_NAME = f"struct<type: string, content: string, language: array<{_REF}>, classified_as: array<{_REF}>>"
RECORD = f"""struct<json: struct<id: string, type: string, _label: string, identified_by: array<{_NAME}>, defined_by: string,
  classified_as: array<{_REF}>, member_of: array<{_REF}>, subject_to: array<string>, representation: array<string>, supertypes: array<string>,
  referred_to_by: array<struct<content: string>>, containing: array<{_REF}>, produced_by: struct<carried_out_by: array<{_REF}>, part: array<struct<carried_out_by: array<{_REF}>>>>,
  created_by: struct<carried_out_by: array<{_REF}>, part: array<struct<carried_out_by: array<{_REF}>>>, timespan: struct<begin_of_the_begin: string, end_of_the_end: string>>,
  born: struct<timespan: struct<begin_of_the_begin: string>>>>"""


def parsed(docs: DataFrame) -> DataFrame:
    """docs with the column j: the parts of the record that profiles use."""
    return docs.withColumn("j", F.from_json("json", RECORD)["json"])


def primary_name(names: Column, language: str | None = None, english: str = "en") -> Column:
    """The content of the name in the asked language, else in English, else of the first name."""
    real = F.filter(names, lambda n: n["type"] == "Name")
    in_ = lambda code: F.filter(real, lambda n: F.exists(F.coalesce(n["language"], F.array()), lambda x: (x["id"] == code) | (x["_label"] == code)))
    picks = ([F.try_element_at(in_(language), F.lit(1))] if language else []) + [F.try_element_at(in_(english), F.lit(1)), F.try_element_at(real, F.lit(1))]
    return F.coalesce(*[p["content"] for p in picks])


def carried_out_by(event: Column) -> Column:
    """Agents of a production or creation: its own, else those of its parts."""
    own = event["carried_out_by"]
    return F.when(F.size(own) > 0, own).otherwise(F.flatten(F.transform(event["part"], lambda p: p["carried_out_by"])))


def profile(docs: DataFrame, name: str | None, language: str | None = None) -> DataFrame:
    """The named part of each record; None or results gives the whole record. Other names are errors."""
    d = parsed(docs)
    base = [F.col("j.id").alias("id"), F.col("j.type").alias("type")]
    label = primary_name(F.col("j.identified_by"), language).alias("name")
    if name in (None, "results"):
        return docs
    if name == "name":
        return d.select(*base, label, F.when(F.col("j.type") == "Place", F.col("j.defined_by")).alias("defined_by"))
    if name == "location":
        return d.select(*base, F.filter("j.identified_by", lambda n: n["type"] == "Identifier")["content"].alias("identifiers"), F.col("j.member_of.id").alias("member_of"))
    if name == "rights":
        return d.select(*base, F.col("j.subject_to").alias("subject_to"))
    if name == "relationship":
        made = F.col("j.type").isin("HumanMadeObject", "DigitalObject", "LinguisticObject", "VisualItem")
        return d.select(*base, label, F.when(made, carried_out_by(F.col("j.produced_by"))["id"]).alias("produced_by"), F.when(made, F.col("j.supertypes")).alias("supertypes"), F.when(~made, F.col("j.classified_as.id")).alias("classified_as"), F.col("j.representation").alias("image"))
    raise ValueError(f"unknown profile {name!r}")


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a uri with the columns of both: arrays appended, other values kept; two different values are an error."""
    shared = [c for c in a.columns if c in b.columns and c != "uri"]
    kinds = dict(a.dtypes)
    both = a.alias("a").join(b.alias("b"), "uri", "full")

    def one(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if kinds[c].startswith("array"):
            return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y))
        clash = F.raise_error(F.concat(F.lit(f"two values of {c} for "), F.col("uri"))).cast(kinds[c])
        return F.when(x.isNotNull() & y.isNotNull() & (x != y), clash).otherwise(F.coalesce(x, y))

    return both.select("uri", *[one(c).alias(c) if c in shared else F.col(c) for c in [*a.columns, *[c for c in b.columns if c not in a.columns]] if c != "uri"])


def violations(records: DataFrame) -> DataFrame:
    """(uri, rule): every rule that a user-made record breaks. records: (uri, kind, names array<string>, notes array<string>, label)."""
    rules = {
        "kind must be Set or Person": ~F.coalesce(F.col("kind").isin("Set", "Person"), F.lit(False)),
        "a name is required": F.coalesce(F.size("names"), F.lit(0)) < 1,
        f"a name has at most {MAX_NAME} characters": F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.length(n) > MAX_NAME),
        f"at most {MAX_NOTES} notes": F.coalesce(F.size("notes"), F.lit(0)) > MAX_NOTES,
        f"a note has at most {MAX_NOTE} characters": F.exists(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.length(n) > MAX_NOTE),
        f"a label has at most {MAX_LABEL} characters": F.coalesce(F.length("label"), F.lit(0)) > MAX_LABEL,
    }
    broken = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return records.select("uri", F.explode(broken).alias("rule"))


def apply_changes(sets: DataFrame, changes: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """A new snapshot of user-made sets (uri, username, members array<string>, history array<struct<user, at>>).

    changes: (uri or null, username, members, at), one a set. A null uri creates a set with a new one. Members lose
    repetitions and the set itself; the creator's name is kept; one entry is added to the history unless the last one has
    the same user and second. The new uri is a hash of the change, so a repeated task makes the same one. records, as
    violations takes them, are the changed sets themselves: changes of those that break a rule are left out.
    """
    made = F.concat(F.lit("set/"), F.substring(F.sha2(F.to_json(F.struct("username", "members", "at")), 256), 1, 32))
    c = changes.withColumn("uri", F.coalesce("uri", made))
    if records is not None:
        c = c.join(violations(records), "uri", "left_anti")
    c = c.select(F.col("uri"), F.col("username").alias("by"), F.array_remove(F.array_distinct("members"), F.col("uri")).alias("new"), F.date_trunc("second", "at").alias("at"))
    entry = F.struct(F.col("by").alias("user"), F.col("at").alias("at"))
    both = sets.join(c, "uri", "full")
    last = F.try_element_at("history", F.lit(-1))
    again = last["user"].eqNullSafe(F.col("by")) & last["at"].eqNullSafe(F.col("at"))
    history = F.when(F.col("by").isNull() | F.coalesce(again, F.lit(False)), F.col("history")).otherwise(F.concat(F.coalesce("history", F.array().cast(dict(sets.dtypes)["history"])), F.array(entry)))
    return both.select("uri", F.coalesce("username", "by").alias("username"), F.coalesce("new", "members").alias("members"), history.alias("history"))


def delete_records(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs left, rejected (uri, reason)): only user-made sets go, and none that is its user's default. docs: (uri, user_made, is_default, ...)."""
    w = wanted.select("uri").distinct().join(docs.select("uri", "user_made", "is_default", F.lit(True).alias("there")), "uri", "left")
    reason = F.when(F.col("there").isNull(), "no such record").when(~F.col("user_made"), "not user-made").when(F.col("is_default"), "default set")
    judged = w.select("uri", reason.alias("reason"))
    return docs.join(judged.filter("reason is null"), "uri", "left_anti"), judged.filter("reason is not null")


def visible(docs: DataFrame, slices: list[str], user: str | None = None) -> DataFrame:
    """docs of the reader's slices, with what of each may be seen: everything, or of other users' records the name only."""
    mine = docs.filter(F.arrays_overlap("collections", F.array(*[F.lit(s) for s in slices])))
    own = F.col("username").isNull() | F.col("username").eqNullSafe(F.lit(user))
    return mine.withColumn("seen_as", F.when(own, "record").otherwise("name"))


#: Sub-trees of a record by name, as the event or property and what of it.
GETTERS = {
    "about": ("about", ""), "active_at": ("carried_out", "took_place_at"), "birth_place": ("born", "took_place_at"), "birth_time": ("born", "timespan"), "carried_out_by": ("carried_out_by", ""),
    "carries": ("carries", ""), "classified_as": ("classified_as", ""), "created_at": ("created_by", "took_place_at"), "created_by": ("created_by", "carried_out_by"), "creation_time": ("created_by", "timespan"),
    "death_place": ("died", "took_place_at"), "death_time": ("died", "timespan"), "encountered_at": ("encountered_by", "took_place_at"), "encountered_by": ("encountered_by", "carried_out_by"),
    "equivalent": ("equivalent", ""), "influenced_by": ("created_by", "influenced_by"), "language": ("language", ""), "made_of": ("made_of", ""), "member_of": ("member_of", ""), "part_of": ("part_of", ""),
    "produced_at": ("produced_by", "took_place_at"), "produced_by": ("produced_by", "carried_out_by"), "production_time": ("produced_by", "timespan"), "published_by": ("used_for", "carried_out_by"),
    "represents": ("represents", ""), "shows": ("shows", ""), "technique": ("produced_by", "technique"), "timespan": ("timespan", ""), "took_place_at": ("took_place_at", ""),
}


def sub_tree(json: Column, name: str) -> Column:
    """JSON text of the named sub-tree; where an event has none of its own, that of its parts; null if neither has it."""
    event, what = GETTERS[name]
    own = F.get_json_object(json, f"$.json.{event}" + (f".{what}" if what else ""))
    if not what:
        return own
    return F.coalesce(own, F.get_json_object(json, f"$.json.{event}.part[*].{what}"))


def classified_with(json: Column, kind: str) -> Column:
    """Ids among a record's classifications that are themselves classified as `kind` (its id or an equivalent's): nationalities, occupations, genders."""
    schema = "array<struct<id: string, classified_as: array<struct<id: string, equivalent: array<struct<id: string>>>>>>"
    empty = F.array()
    of_kind = lambda c: (c["id"] == kind) | F.exists(F.coalesce(c["equivalent"], empty), lambda e: e["id"] == kind)
    all_ = F.from_json(F.get_json_object(json, "$.json.classified_as"), schema)
    return F.coalesce(F.filter(all_, lambda x: F.exists(F.coalesce(x["classified_as"], empty), of_kind))["id"], empty.cast("array<string>"))


def keep_properties(json: Column, names: list[str]) -> Column:
    """JSON text with the named top-level properties only, in the given order; absent ones are left out."""
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.get_json_object(json, f"$.{n}").alias("v")) for n in names]), lambda p: p["v"].isNotNull())
    quoted = lambda v: F.when(v.rlike(r'^\s*([\[{]|-?[0-9.]+([eE][+-]?[0-9]+)?\s*$|(true|false|null)\s*$)'), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), quoted(p["v"]))), ","), F.lit("}"))


def sorted_keys(json: Column) -> Column:
    """JSON text with the top-level properties in the order of their names; objects below keep theirs."""
    return keep_sorted(json, F.array_sort(F.json_object_keys(json)))


def keep_sorted(json: Column, names: Column) -> Column:
    as_map = F.from_json(json, "map<string, string>")
    quoted = F.transform(names, lambda n: F.concat(F.to_json(F.array(n)).substr(F.lit(2), F.length(F.to_json(F.array(n))) - 2), F.lit(":"), _as_json(F.try_element_at(as_map, n))))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def _as_json(v: Column) -> Column:
    """A value of from_json's map as JSON again: text that reads as an object, array, number or literal stays, other text is quoted."""
    bare = v.rlike(r'^\s*([\[{]|-?[0-9.]+([eE][+-]?[0-9]+)?\s*$|(true|false|null)\s*$)')
    text = F.to_json(F.array(v))
    return F.when(v.isNull(), "null").when(bare, v).otherwise(text.substr(F.lit(2), F.length(text) - 2))
