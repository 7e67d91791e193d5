"""Every registered query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import pytest

from quillmark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    ran = duck.execute(registry.SQL[name])
    cols = [d[0] for d in ran.description]
    want = ran.fetchall()
    assert sorted(df.columns) == sorted(cols)
    mine, theirs = [df.columns.index(c) for c in sorted(cols)], [cols.index(c) for c in sorted(cols)]
    assert sorted(tuple(plain(r[i]) for i in mine) for r in got) == sorted(tuple(plain(r[i]) for i in theirs) for r in want)
