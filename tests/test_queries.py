"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, db, name):
    if name not in entry.oracle_sql():
        if name in registry.QUERIES:
            assert registry.QUERIES[name](spark, sf_dir).count() >= 0
        return
    df = entry.queries()[name](spark, sf_dir)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["uri", "data_type", "key"]
