"""Every registered query against its SQL on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from snapledger.plans.oracles import ORACLES
from snapledger.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(lines, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    expected = canonical([d[0] for d in result.description], result.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
    assert got[1], "a check on no rows checks nothing"
