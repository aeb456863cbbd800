import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.quality import op3_quality
from tests.llm import test_mixing, test_packing
from tests.llm.test_simhash import classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    name, stage = corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in op3_quality(spark, SF).filter("predicted = 1").collect()}
    out = stage(spark, docs, SF)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == kept

    best = {}
    for i in sorted(kept):
        key = re.sub(r"[\x20\x09-\x0d]", "", rows[i].text or "")
        if key not in best or len(rows[i].text) > len(rows[best[key]].text):
            best[key] = i
    docs = corpus_pipeline.STAGES[1][1](spark, out, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(best.values())

    fps = {i: plain_fingerprint(rows[i].text) for i in best.values()}
    label = classes([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], list(fps))
    docs = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(label.values())

    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", rows[i].text or "")) for i in label.values()}
    sizes = Counter()
    for i, n in size.items():
        sizes[rows[i].source] += n
    times = test_mixing.brute_times([(i, rows[i].source, n, 1) for i, n in size.items()], sizes, test_mixing.brute_targets(dict(sizes)))
    docs = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    copies = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == columns and copies == Counter({k[0]: v for k, v in times.items() if v})

    final = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    pieces = Counter((r.doc_id, r.piece, r.length) for r in final)
    assert {(d, p): n for (d, p, _), n in pieces.items()} == {(d, p): copies[d] for d, p, _ in pieces}
    assert set(copies) == {r.doc_id for r in final}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ends = Counter()
    for r in rows:
        ends[r.sequence_id] += r.length
    assert rows and max(ends.values()) <= 4096
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    for i, n in whole.items():
        assert n % (len(test_packing.ids_of(docs[i])) + 1) == 0


def test_messy_tables(spark, messy, nothing, tmp_path):
    """Nulls, blanks, a very long text, repeated rows and clashing columns go through all stages; so does an empty table."""
    for name, docs in (("messy", messy), ("nothing", nothing)):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{sf}/labels.parquet")
        got = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, got, sf)
            assert got.columns == docs.columns
        assert bool(corpus_pipeline.run(spark, sf).count()) == bool(docs.count())
