import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import licenses as L


def cosine(text):
    """The closest template to a text, by the definition."""
    c = Counter(re.findall(L.TOKEN, text.lower()))
    w = {t: n * L.IDF.get(t, L.OTHER_IDF) for t, n in c.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    best = (0.0, 0, None)
    for i in range(len(L.TEMPLATES)):
        dot = sum(w.get(t, 0.0) * x for k, _, t, x in L.WEIGHTS if k == i)
        best = max(best, (round(dot / norm, 4) if norm else 0.0, -i, L.TEMPLATES[i][0]), key=lambda b: b[:2])
    return (best[2], best[0]) if best[0] >= L.THRESHOLD else None


FILES = [
    (1, "proj/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    (2, "proj/src/a.py", "import os\nprint('hi')"),
    (3, "proj/vendor/lib/COPYING", "Licensed under the Apache License, Version 2.0."),
    (4, "proj/vendor/lib/deep/er/x.c", "int main;"),
    (5, "proj/vendor/y.c", "This work is licensed under the GNU General Public License, version 3.\nint main(void) { return compute(first, second, third) + other_things(fourth, fifth, sixth); }"),
    (6, "other/z.c", "nothing here"),
    (7, "top.c", None),
    (8, None, "All rights reserved."),
    (9, "proj/src/b.py", ""),
    (9, "proj/src/b.py", ""),
    (None, "proj/src/c.py", "some code"),
]


def test_origins_and_inheritance(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = [(r.doc_id, r.license, r.origin, r.inherited_from) for r in L.scan_licenses(files, spark, F.col("path")).collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, "MIT", "file", None), (2, "MIT", "inherited", "proj"), (3, "Apache-2.0", "file", None), (4, "Apache-2.0", "inherited", "proj/vendor/lib"), (5, "GPL-3.0", "header", None),
            (6, None, "none", None), (7, None, "none", None), (8, "proprietary", "file", None), (9, "MIT", "inherited", "proj"), (9, "MIT", "inherited", "proj"), (None, "MIT", "inherited", "proj"),
        ],
        key=repr,
    )


def test_lines_match_the_definition(spark, small):
    got = {r.doc_id: (r.license, r.similarity) for r in L.scan_licenses(small, spark, F.lit("x")).filter("origin in ('header', 'file')").collect()}
    want = {}
    for r in small.select("doc_id", "text").collect():
        hits = [cosine(r.text)] if cosine(r.text) else [h for h in map(cosine, r.text.split("\n")) if h]
        if hits:
            want[r.doc_id] = max(hits, key=lambda h: (h[1], h[0]))
    assert got == want and want


def test_the_filter_loses_none(spark, small):
    texts = [line for r in small.select("text").collect() for line in [r.text, *r.text.split("\n")]] + [t for _, t in L.TEMPLATES] + [f"{t} and a few other words" for _, t in L.TEMPLATES]
    df = spark.createDataFrame([(t, t.lower()) for t in texts], "text string, lowered string").withColumn("can", L.can_reach("lowered"))
    rows = df.collect()
    assert all(r.can for r in rows if cosine(r.text)) and sum(r.can for r in rows) < 0.2 * len(rows)


def test_common_header_is_found_and_all_words_are_terms(spark):
    files = spark.createDataFrame([(1, "Licensed under the MIT License.\nimport os"), (2, "import os")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.origin) for r in L.scan_licenses(files, spark, F.lit("a.py")).collect()}
    assert got == {1: ("MIT", "header"), 2: (None, "none")}
    assert L.THRESHOLD == 0.6 and {"without", "of", "the"} <= set(L.IDF)


def _installed(name):
    with open(f"/usr/share/common-licenses/{name}") as f:
        return f.read()


MIT = """The MIT License (MIT)

Copyright (c) 2019 Some Body and contributors

""" + dict(L.FILE_TEMPLATES)["MIT"].split("Copyright (c)")[1]


def test_complete_licence_files_speak_for_their_directories(spark):
    texts = {"MIT": MIT, "BSD-3-Clause": _installed("BSD"), "Apache-2.0": _installed("Apache-2.0")}
    texts |= {f"{n}.0": _installed(n) for n in ("GPL-2", "GPL-3", "LGPL-3")} | {n: _installed(n) for n in ("LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    texts |= {n: dict(L.FILE_TEMPLATES)[n] + "\nCopyright 2020 Some Body" for n in ("AGPL-3.0", "BSD-2-Clause")}
    rows = [(i, f"{n}/{f}", t) for n, text in texts.items() for i, f, t in ((1, "LICENSE", text), (2, "src/deep/a.c", "int main;"))]
    rows += [(1, f"{n}/LICENSE", _installed(n)) for n in ("Artistic", "GFDL-1.3")]  # other licences, known by none of the templates
    got = {(r.path, r.license, r.origin, r.inherited_from) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), spark, F.col("path")).collect()}
    want = {(f"{n}/LICENSE", n, "file", None) for n in texts} | {(f"{n}/src/deep/a.c", n, "inherited", n) for n in texts}
    assert {g for g in got if g[2] in ("file", "inherited")} == want


def test_every_spdx_id_is_its_own(spark):
    ids = {"MIT": "MIT", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-or-later": "LGPL-2.1", "AGPL-3.0-only": "AGPL-3.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC0-1.0": "CC0-1.0", "ISC": None}
    files = spark.createDataFrame([(i, f"// SPDX-License-Identifier: {x}\nint a;") for i, x in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in L.scan_licenses(files, spark, F.lit("a.c")).collect()}
    assert [got[i] for i in range(len(ids))] == list(ids.values())


def test_few_texts_are_compared_with_whole_licences(spark, small):
    licences = spark.createDataFrame([(x,) for _, x in L.FILE_TEMPLATES], "text string")
    assert licences.filter(L.can_be_file(F.lower("text"))).count() == len(L.FILE_TEMPLATES)
    assert small.filter(L.can_be_file(F.lower("text"))).count() < 0.05 * small.count()


def test_any_table(spark, messy, nothing):
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    assert L.scan_licenses(messy, spark, path).count() == messy.count()
    assert L.scan_licenses(nothing, spark, path).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = L.scan_licenses(small, spark, F.lit("a/b"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
