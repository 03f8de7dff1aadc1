"""Every registered query against its DuckDB counterpart, at the smallest size."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from sessionlake.catalog import ORACLES, QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    spark.catalog.clearCache()
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = Counter(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want
