"""Every query of the library against its SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from graphloom import queries_graph, queries_logs, queries_stream, queries_text, registry  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in cols)).collect())
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == cols
        order = [want.columns.index(c) for c in cols]
        assert rows == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    else:
        assert rows
