"""Queries that SQL can express, against that SQL."""

import pytest

import __spark_entry__ as entry
from schedlake.llm.queries import CHECKS
from schedlake.plans.registry import connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    want = connect(SF).execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
