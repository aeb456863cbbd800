"""Registered queries and the DuckDB SQL that must return the same rows."""

from tessera.plans import analytics, records, search, streams

QUERIES = {**search.QUERIES, **analytics.QUERIES, **records.QUERIES, **streams.QUERIES}
ORACLE_SQL = {**search.ORACLE_SQL, **analytics.ORACLE_SQL, **records.ORACLE_SQL, **streams.ORACLE_SQL}
