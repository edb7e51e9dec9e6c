"""Queries of the training-data operators against SQL, and that all are registered."""

import re

import pytest
from test_oracles import SF_DIR, canonical, duck  # noqa: F401

import __spark_entry__ as contract
from snapledger.llm.oracles import ORACLES
from snapledger.llm.queries import QUERIES


def test_every_operator_has_its_query():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF_DIR)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    assert got == canonical([d[0] for d in result.description], result.fetchall())
    assert got[1]
