"""Every engine query against its SQL twin on sf0.001; queries without one must give rows."""

import math

import duckdb
import pytest

from kinforge.plans import REGISTRIES
from kinforge.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = {}, {}
for r in REGISTRIES:
    QUERIES |= r.queries()
    ORACLES |= r.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return "nan" if math.isnan(float(v)) else round(float(v), 9) + 0.0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall()]
    have = [tuple(value(r[c]) for c in sorted(columns)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
