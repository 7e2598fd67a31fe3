"""Every query with a SQL twin gives the twin's rows."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

from skein.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    twin = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    at = [twin.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in twin.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_twin(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
