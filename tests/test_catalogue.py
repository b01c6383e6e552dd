"""Every query with an oracle equals it on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quillon.catalogue import ORACLES, QUERIES
from quillon.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return v.normalize() + 0
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in ORACLES:
        assert rows
        return
    want = oracle.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
