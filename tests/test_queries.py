"""Each query with SQL gives the same rows in DuckDB; the others give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from sondage.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in found.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())
