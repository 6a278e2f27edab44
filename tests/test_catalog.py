"""Every query of the catalogue against its statement in DuckDB, on the smallest tables."""

from __future__ import annotations

import decimal
import os

import pytest

from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    q = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(dict(zip(names, r))[c]) for c in columns]) for r in q.fetchall())
