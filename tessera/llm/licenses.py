"""License scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance from ancestor directories.

A file whose whole text is close to a header template or to a whole licence text is a licence file and speaks for its
directory; a line close to a header template is a header and speaks for its file. A file without either takes the
licence of the nearest ancestor directory that has one.

Headers weigh terms by tf * idf. Whole licence texts weigh them by (1 + ln tf) * idf, each with idf over its own kind of
template: with plain tf, 'the' and 'of' make unlike licences alike (GFDL to GPL-3.0 0.80, against 0.41).

Only DataFrame functions are used. Tokens are counted for few texts: upper bounds of the cosines, found within a row, leave
out beforehand what can't reach THRESHOLD (can_reach, can_be_file), and with a file that is left out go all its lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

THRESHOLD = 0.6
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"

#: What licences say in headers and at the start of licence files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {spdx}") for name, spdx in (
        ("GPL-3.0", "GPL-3.0-only"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"),
        ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("MPL-2.0", "MPL-2.0"),
        ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"),
    )),
)

#: Whole licence texts, for files only: tessera/llm/license_texts/<licence>.txt.
FILE_TEMPLATES = tuple(sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in package_files("tessera.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")))


def _weights(templates: tuple[tuple[str, str], ...], damped: bool) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, normalised weight) rows, idf by term, idf of any other term."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    rows = []
    for i, c in enumerate(counts):
        w = {t: (1 + math.log(k) if damped else k) * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(i, templates[i][0], t, x / norm) for t, x in w.items()]
    return rows, idf, math.log(1 + n) + 1


WEIGHTS, IDF, OTHER_IDF = _weights(TEMPLATES, damped=False)
FILE_WEIGHTS, FILE_IDF, OTHER_FILE_IDF = _weights(FILE_TEMPLATES, damped=True)

#: Similarities are rounded to four digits before they are compared.
LEAST = THRESHOLD - 1e-4


def _fewest_terms() -> int:
    """The fewest distinct terms with which a cosine to a whole licence text can reach THRESHOLD."""
    fewest = []
    for i in range(len(FILE_TEMPLATES)):
        held, n = 0.0, 0
        for x in sorted((w for k, _, _, w in FILE_WEIGHTS if k == i), reverse=True):
            if held >= LEAST**2:
                break
            held, n = held + x * x, n + 1
        fewest.append(n)
    return min(fewest)


FEWEST_TERMS = _fewest_terms()


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _tokens(lowered: str | Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def _held(tokens: Column) -> Column:
    """Whether the distinct terms hold enough of a header template: its cosine is at most the root of the squared weights that occur at all."""
    squares: dict[int, list[tuple[str, float]]] = {}
    for template, _, term, w in WEIGHTS:
        squares.setdefault(template, []).append((term, w * w))

    def held(found: Column) -> Column:
        of_template = [F.aggregate(F.array(*[F.when(F.array_contains(found, t), x).otherwise(0.0) for t, x in terms]), F.lit(0.0), lambda a, x: a + x) for terms in squares.values()]
        return F.greatest(*of_template) >= LEAST**2

    known = F.array_intersect(tokens, F.array(*[F.lit(t) for t in IDF]))
    return _let(known, lambda found: (F.size(found) > 0) & held(found))


def _near(tokens: Column) -> Column:
    """Whether a header template is near enough if every other term occurs once: products are exact, norms at least so large."""
    place = {t: i for i, t in enumerate(IDF)}

    def bound(tfs: Column, others: Column) -> Column:
        by_template: dict[int, list[Column]] = {}
        for template, _, term, w in WEIGHTS:
            by_template.setdefault(template, []).append(tfs[place[term]] * (w * IDF[term]))
        dots = [F.aggregate(F.array(*x), F.lit(0.0), lambda a, y: a + y) for x in by_template.values()]
        square = F.aggregate(F.zip_with(tfs, F.array(*[F.lit(x) for x in IDF.values()]), lambda n, x: n * n * x * x), F.lit(0.0), lambda a, y: a + y)
        return F.greatest(*dots) >= LEAST * F.sqrt(square + others * OTHER_IDF**2)

    def of_known(known: Column) -> Column:
        tfs = F.transform(F.array(*[F.lit(t) for t in IDF]), lambda t: (F.size(known) - F.size(F.array_remove(known, t))).cast("double"))
        return _let(tfs, lambda x: bound(x, F.size(tokens) - F.size(known)))

    return _let(F.filter(tokens, lambda t: t.isin(list(IDF))), of_known)


def can_reach(lowered: str | Column) -> Column:
    """Whether the terms of a text allow a cosine of THRESHOLD with any header template."""
    return _let(_tokens(lowered), lambda t: _held(t) & _near(t))


def _licence_like(tokens: Column) -> Column:
    """can_be_file of tokens: squares of the templates' terms are exact, any other term occurs at least once."""
    by_idf: dict[float, list[str]] = {}
    for t, x in FILE_IDF.items():
        by_idf.setdefault(x, []).append(t)

    def square(term: Column) -> Column:
        """Rarer terms last: they are fewer in most texts."""
        first, *rest = sorted(by_idf)
        value = F.when(term.isin(by_idf[first]), first**2)
        for x in rest:
            value = value.when(term.isin(by_idf[x]), x**2)
        return value

    def reach(known: Column, found: Column) -> Column:
        def damped(t: Column) -> Column:
            return square(t) * F.pow(1 + F.log(F.size(known) - F.size(F.array_remove(known, t))), F.lit(2))

        squares = F.aggregate(found, F.lit(0.0), lambda a, t: a + damped(t))
        others = F.size(F.array_distinct(tokens)) - F.size(found)
        return (F.size(found) >= FEWEST_TERMS) & _let(squares, lambda x: x >= LEAST**2 * (x + others * OTHER_FILE_IDF**2))

    return _let(F.filter(tokens, lambda t: t.isin(list(FILE_IDF))), lambda known: _let(F.array_distinct(known), lambda found: reach(known, found)))


def can_be_file(lowered: str | Column) -> Column:
    """Whether the terms of a text allow a cosine of THRESHOLD with any whole licence text."""
    return _let(_tokens(lowered), _licence_like)


def best_templates(units: DataFrame, spark: SparkSession, whole_texts: bool = False) -> DataFrame:
    """units: (unit, lowered). (unit, license, similarity) of each unit's closest header template or whole licence text, if that reaches THRESHOLD.

    The template tables have a few thousand rows, fixed by the templates: that bounds their broadcasts. Ties go to the first template.
    """
    rows, idfs, other = (FILE_WEIGHTS, FILE_IDF, OTHER_FILE_IDF) if whole_texts else (WEIGHTS, IDF, OTHER_IDF)
    weights, idf = spark.createDataFrame(rows, "template int, license string, term string, w double"), spark.createDataFrame(list(idfs.items()), "term string, idf double")
    terms = units.select("unit", F.explode(_tokens("lowered")).alias("term"))
    tf = terms.groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    factor = 1 + F.log("tf") if whole_texts else F.col("tf")
    w = tf.join(F.broadcast(idf), "term", "left").withColumn("x", factor * F.coalesce("idf", F.lit(other)))
    norms = w.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = w.join(F.broadcast(weights), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cos = dots.join(norms, "unit").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 4)).filter(F.col("similarity") >= THRESHOLD)
    best = cos.groupBy("unit").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select("unit", F.col("b.license").alias("license"), F.col("b.similarity").alias("similarity"))


def _kept(lowered: Column) -> Column:
    """Lines that can be headers, and the text itself if it can be a licence file, as a struct in an array; an empty array if neither."""
    none = F.array().cast("array<string>")

    def of_tokens(t: Column) -> Column:
        lines = F.when(_held(t), F.filter(F.array_distinct(F.split(lowered, "\n")), can_reach)).otherwise(none)
        return F.struct(lines.alias("lines"), F.when(_held(t) & _near(t), lowered).alias("as_header"), F.when(_licence_like(t), lowered).alias("as_text"))

    return F.filter(F.transform(F.array(_tokens(lowered)), of_tokens), lambda s: (F.size(s["lines"]) > 0) | s["as_header"].isNotNull() | s["as_text"].isNotNull())


def scan_licenses(files: DataFrame, spark: SparkSession, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, path, license, origin, similarity, inherited_from) for each row of files.

    origin: file (a licence file), header (a line), inherited (from directory inherited_from), none. Null texts and paths
    count as empty; a file without directory inherits nothing. Of several headers, and of several licence files of a
    directory, the closest counts, then the last licence name. Repeated rows each get a row.
    """
    p = F.coalesce(path, F.lit(""))
    rows = files.select(F.col(id_col).alias("doc_id"), p.alias("path"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("lowered"))
    marked = written(rows.select("doc_id", "path", F.inline(_kept(F.col("lowered")))).distinct().withColumn("file", F.monotonically_increasing_id()), spark, "marked")
    lines = written(marked.select("file", F.explode("lines").alias("lowered")).withColumn("unit", F.monotonically_increasing_id()), spark, "license-lines")
    by_line = best_templates(lines.select("unit", "lowered"), spark).join(lines.select("unit", "file"), "unit")
    headers = by_line.groupBy("file").agg(F.max(F.struct("similarity", F.lit(0).alias("whole"), "license")).alias("b"))
    whole = best_templates(marked.filter("as_header is not null").select(F.col("file").alias("unit"), F.col("as_header").alias("lowered")), spark)
    whole = whole.unionByName(best_templates(marked.filter("as_text is not null").select(F.col("file").alias("unit"), F.col("as_text").alias("lowered")), spark, whole_texts=True))
    wholes = whole.select(F.col("unit").alias("file"), F.struct("similarity", F.lit(1).alias("whole"), "license").alias("b"))
    own = headers.unionByName(wholes).groupBy("file").agg(F.max_by("b", F.struct(F.col("b.whole"), F.col("b.similarity"), F.col("b.license"))).alias("b"))
    own = written(marked.select("file", "doc_id", "path").join(own, "file").groupBy("doc_id", "path").agg(F.max_by("b", F.struct(F.col("b.whole"), F.col("b.similarity"), F.col("b.license"))).alias("b")), spark, "own-licenses")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    speaks = own.filter("b.whole = 1").select(parent.alias("dir"), "b").filter("dir <> ''")
    dirs = speaks.groupBy("dir").agg(F.max(F.struct(F.col("b.similarity"), F.col("b.license"))).alias("d"))
    every = files.select(F.col(id_col).alias("doc_id"), p.alias("path"))
    o = own.select(F.col("doc_id").alias("i"), F.col("path").alias("p"), "b")
    with_own = written(every.join(o, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("path") == F.col("p")), "left").select("doc_id", "path", "b"), spark, "with-own")
    # Each directory is looked up once, however many files it holds: all ancestors of the distinct parents.
    held = with_own.filter("b is null").select(parent.alias("parent")).filter("parent <> ''").distinct()
    parts = F.split("parent", "/")
    above = held.select("parent", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    nearest = above.join(dirs, "dir").groupBy("parent").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "d")).alias("near"))
    nearest = written(nearest, spark, "nearest")  # else the join below couldn't split a directory with very many files
    out = with_own.withColumn("parent", parent).join(nearest.withColumnRenamed("parent", "q"), F.col("b").isNull() & (F.col("parent") == F.col("q")), "left")
    origin = F.when(F.col("b.whole") == 1, "file").when(F.col("b").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id", "path", F.coalesce("b.license", "near.d.license").alias("license"), origin.alias("origin"),
        F.coalesce("b.similarity", "near.d.similarity").alias("similarity"), F.when(F.col("b").isNull(), F.col("near.dir")).alias("inherited_from"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licenses(table(spark, sf_dir, "documents"), spark, path)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(float(x)) + "::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def _cosines(units: str, weights: str = "weights") -> str:
    return f"""
  SELECT unit, arg_max(license, (similarity, -template)) AS license, max(similarity) AS similarity FROM (
    SELECT d.unit, d.template, d.license, round(d.dot / n.norm, 4) AS similarity
    FROM (SELECT x.unit, w.template, w.license, sum(x.x * w.w) AS dot FROM {units}_x x JOIN {weights} w USING (term) GROUP BY ALL) d
    JOIN (SELECT unit, sqrt(sum(x * x)) AS norm FROM {units}_x GROUP BY unit) n USING (unit))
  WHERE similarity >= {THRESHOLD} GROUP BY unit"""


def _terms(units: str, idf: str = "idf", other: float = OTHER_IDF, tf: str = "count(*)") -> str:
    return f"""
  SELECT unit, t.term, {tf} * coalesce(any_value(i.idf), {other!r}::DOUBLE) AS x
  FROM (SELECT unit, unnest(regexp_extract_all(lowered, '{TOKEN}')) AS term FROM {units}) t LEFT JOIN {idf} i USING (term) GROUP BY unit, t.term"""


OP5_SQL = f"""
WITH weights(template, license, term, w) AS (VALUES {_values(WEIGHTS)}),
idf(term, idf) AS (VALUES {_values(IDF.items())}),
text_weights(template, license, term, w) AS (VALUES {_values(FILE_WEIGHTS)}),
text_idf(term, idf) AS (VALUES {_values(FILE_IDF.items())}),
f AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, lower(coalesce(text, '')) AS lowered FROM documents),
files AS (SELECT doc_id AS unit, lowered FROM f),
lines AS (SELECT row_number() OVER () AS unit, doc_id, lowered FROM (SELECT DISTINCT doc_id, unnest(string_split(lowered, chr(10))) AS lowered FROM f)),
lines_x AS ({_terms("lines")}), files_x AS ({_terms("files")}),
texts_x AS ({_terms("files", "text_idf", OTHER_FILE_IDF, "(1 + ln(count(*)))")}),
line_best AS ({_cosines("lines")}), header_file_best AS ({_cosines("files")}), text_best AS ({_cosines("texts", "text_weights")}),
file_best AS (
  SELECT unit, arg_max(license, (similarity, license)) AS license, max(similarity) AS similarity
  FROM (SELECT * FROM header_file_best UNION ALL SELECT * FROM text_best) GROUP BY unit),
header AS (SELECT l.doc_id, max((b.similarity, b.license)) AS b FROM line_best b JOIN lines l USING (unit) GROUP BY l.doc_id),
dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, max((similarity, license)) AS d FROM file_best b JOIN f ON f.doc_id = b.unit GROUP BY dir),
own AS (
  SELECT f.doc_id, f.path, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS parent, fb.license AS fl, fb.similarity AS fs, h.b[2] AS hl, h.b[1] AS hs
  FROM f LEFT JOIN file_best fb ON fb.unit = f.doc_id LEFT JOIN header h USING (doc_id)),
near AS (
  SELECT o.doc_id, arg_max(d.dir, length(d.dir)) AS dir, arg_max(d.d, length(d.dir)) AS d
  FROM own o JOIN dirs d ON o.parent = d.dir OR starts_with(o.parent, d.dir || '/') WHERE o.fl IS NULL AND o.hl IS NULL GROUP BY o.doc_id)
SELECT o.doc_id, o.path, coalesce(o.fl, o.hl, n.d[2]) AS license,
       CASE WHEN o.fl IS NOT NULL THEN 'file' WHEN o.hl IS NOT NULL THEN 'header' WHEN n.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(o.fs, o.hs, n.d[1]) AS similarity, n.dir AS inherited_from
FROM own o LEFT JOIN near n USING (doc_id)
"""
