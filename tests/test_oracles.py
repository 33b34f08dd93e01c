"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from tallyspark.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def told(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = told(df.select(*columns).collect())
    assert columns
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == told([[r[i] for i in at] for r in found.fetchall()])
