"""Every catalogue query against its DuckDB oracle, and what its plan must not hold."""

import pytest

import __spark_entry__ as entry
from workload.catalog import QUERIES
from tools.check_oracle import difference

SF_DIR = "/root/testdata/sf0.001"


def test_catalogue_is_complete():
    assert QUERIES.keys() <= entry.queries().keys() & entry.oracle_sql().keys()
    assert len(QUERIES) >= 57


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, name):
    result = entry.queries()[name](spark, SF_DIR)
    assert difference(result, SF_DIR, name) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    for operator in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan
