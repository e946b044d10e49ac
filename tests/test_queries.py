"""Registered queries of the core against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from casemill import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def canon(v):
    return None if isinstance(v, float) and v != v else round(v, 5) + 0.0 if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = Counter(tuple(canon(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        return
    rel = con.execute(ORACLES[name])
    order = [x[0] for x in rel.description]
    assert sorted(order) == columns
    theirs = Counter(tuple(canon(r[order.index(c)]) for c in columns) for r in rel.fetchall())
    assert ours == theirs
