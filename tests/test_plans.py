"""Plan shape: no cartesian products or nested-loop joins anywhere; scans are pruned."""

import pytest

import __spark_entry__ as E
from harness import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan, plan
    assert "BroadcastNestedLoopJoin" not in plan, plan


def test_flagship_scan_is_pruned_and_join_broadcast(spark):
    plan = _plan(E.entry(spark))
    assert "BroadcastHashJoin" in plan
    # only the three used columns of events are read
    df = E.entry(spark)
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
