"""Every registered query of the library beside its SQL in DuckDB; queries without SQL give rows of a stable schema."""

import pytest

from panelforge.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import DATA, run_sql, same_kind


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    same_kind(QUERIES[name](spark, DATA), *run_sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) and len(rows) > 0
