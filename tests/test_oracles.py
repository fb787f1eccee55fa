"""Every registered query against DuckDB on the smallest tables; those without SQL must run and give rows."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import registry
from quern.plans.base import TABLE_NAMES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        return (2, "nan") if math.isnan(v) else (3, f"{float(v):.8g}")
    return (4, str(v))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in registry.ORACLES:
        assert mine
        return
    found = duck.execute(registry.ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    order = [theirs.index(c) for c in names]
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
