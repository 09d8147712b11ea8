"""Every site query beside its SQL on the smallest tables, or a check that it gives rows with stable columns."""

import os

import duckdb
import pytest

import compare
from inkwell.plans import maintenance_queries, moderation_queries, risk_queries, site_queries, source_queries, stream_queries, versioned_queries  # noqa: F401
from inkwell.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in compare.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(compare.plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert cols
        return
    rel = con.execute(ORACLES[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    assert got == sorted((tuple(compare.plain(r[have.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
