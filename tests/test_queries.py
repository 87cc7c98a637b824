"""Every query with SQL gives the same rows as the SQL, on the small tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from docket.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = sorted(str([plain(v) for v in r]) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
