"""Every registered query with an oracle must match DuckDB (small scale factor for speed)."""

import pytest

import __spark_entry__ as E
from harness import SF_SMALL, compare, duck

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msgs = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert ok, "\n".join(msgs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["analyte", "month", "n_obs", "tested", "exceed", "prevalence"]
