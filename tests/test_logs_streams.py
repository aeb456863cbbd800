import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import logs as L
from tessera.sources import logs as S
from tessera.streaming import streams


def test_access_log(spark, tmp_path):
    lines = [
        '10.0.0.1 - bob [02/Jan/2024:03:04:05 +0000] "GET /ds/x/search.mjs?q=1 HTTP/1.1" 200 512 - -', '10.0.0.1 - bob [02/Jan/2024:03:05:05 +0000] "GET /ds/x/facets.mjs HTTP/1.1" 500 - - -',
        "garbage", '10.0.0.1 - - [02/Jan/2024:05:05:05 +0000] "POST /other HTTP/1.1" 200 1 - -',
    ]
    (tmp_path / "node1.txt").write_text("\n".join(lines))
    log = S.read_access_log(spark, str(tmp_path / "node1.txt"))
    assert sorted((r.node, r.kind, r.status, r.bytes) for r in log.collect()) == [("node1.txt", "Facet", 500, None), ("node1.txt", "Other", 200, 1), ("node1.txt", "Search", 200, 512)]
    assert {(r.kind, r.requests) for r in L.requests_by(log, "kind", start="2024-01-02 03:00:00", end="2024-01-02 05:00:00").collect()} == {("Search", 1), ("Facet", 1)}
    assert L.facets_per_search(log).first().facets_per_search == 1.0


def test_trace_and_merge_logs(spark, tmp_path):
    (tmp_path / "t.log").write_text(
        '2024-01-02 03:04:05.123 Info: requestId: r9; requestContext: search; filterResults: true; totalElapsed: 120; searchElapsed: 100; estimate: 7; returned: 3; scope: [work]; searchCriteria: [{"a": ["b;c"]}]\nother\n2024-01-02 03:04:05 Info: Merged 12 MB in 3 sec at 4 MB/sec to x\n'
    )
    t = S.read_trace_log(spark, str(tmp_path / "t.log")).collect()
    assert [(r.request_id, r.filtered, r.total_ms, r.estimate, r.returned, r.scope, r.criteria) for r in t] == [("r9", True, 120, 7, 3, "work", '{"a": ["b;c"]}')]
    m = S.read_merges(spark, str(tmp_path / "t.log"))
    assert L.merge_rate(m).first()[1:] == (12, 3, 4.0)


def test_request_log_and_metrics(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"time": "t1", "url": "u", "zeta": 1}\n{"time": "t2", "alpha": {"b": 2}}\nnot json\n')
    wide, bad = S.read_request_log(spark, str(tmp_path / "r.json"))
    assert wide.columns == ["time", "url", "alpha", "zeta"]
    assert sorted(map(tuple, wide.collect())) == [("t1", "u", "", "1"), ("t2", "", '{"b":"2"}', "")] and bad.first()[0] == 1
    (tmp_path / "m.json").write_text(json.dumps([{"name": "s", "data": {"entry": [{"dt": "2024-01-01T00:00:00", "value": v} for v in (0, 3, 3)]}}]))
    assert tuple(L.queue_summary(S.read_metrics(spark, str(tmp_path / "m.json"))).first()) == ("s", 3, 2, 2, 3, 6)
    S.write_report(wide, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 2


@pytest.fixture(scope="module")
def log(spark):
    at = [0, 30, 60, 119, 240, 1000, 1050, 1100, 1150, 1200]
    return spark.createDataFrame([(i, "k", s, float(s * 100)) for i, s in enumerate(at)], "request_id long, kind string, s long, ms double").withColumn("ts", F.timestamp_seconds("s"))


def test_ranges(log):
    ranges = L.activity_ranges(log, "kind", 60, 100)
    assert sorted((r.start.timestamp() % 3600, r.n) for r in ranges.collect()) == sorted([(0.0, 4), (1000.0, 5)])
    assert L.in_ranges(log, ranges.select("start", "end"), 50).count() == 9


def test_buckets(log):
    h = {r.bucket: r.n for r in L.duration_histogram(log, 10.0).collect()}
    assert len(h) == 17 and h["0ms-9ms"] == 1 and h["2s-3s"] == 0 and h[">30s"] == 5 and sum(h.values()) == 10
    assert {r.seconds: r.n for r in L.whole_seconds(log).collect()}[100] == 5


def test_streams(spark, log, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.union(log.withColumn("ts", F.timestamp_seconds(F.lit(90_000))).limit(1)).repartition(1).write.parquet(src)
    stream = spark.readStream.schema(log.schema).parquet(src)
    for name, df in (("counts", streams.request_counts(stream)), ("sessions", streams.activity_sessions(stream, "kind", "61 seconds", 100))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.n, r.ms) for r in spark.table("counts").collect()} >= {(5, 44900.0)}
    assert sorted(r.n for r in spark.table("sessions").collect()) == [4, 5]
    schema = "request_id long, kind string, s long, ms double, ts timestamp"
    for want in (11, 12):
        streams.ingest(spark, src, schema, out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == want
        log.limit(1).write.mode("append").parquet(src)
        time.sleep(0.1)
