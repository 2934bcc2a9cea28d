"""Queries beside their checking SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from placetrace.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    cursor = db.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    rows = QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in rows) == expected
