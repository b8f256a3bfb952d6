"""Plans of the registered queries: no cross products, filters and columns reach the scans, every survey row is named."""

import re

import pytest

from panelforge.plans.registry import ENTRY, ORACLE_SQL, QUERIES, SURVEY
from tests.oracle import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, DATA)))


def test_scan_is_pruned_and_filtered(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(QUERIES["keyframe_scan"](spark, DATA))
    assert "EqualTo(event_type,signup)" in p and "GreaterThanOrEqual(value,50.0)" in p and "props" not in p


def test_binning_is_one_exchange(spark):
    assert plan(QUERIES["bin_average"](spark, DATA)).count("Exchange hashpartitioning") == 1
    assert plan(QUERIES["source_probe"](spark, DATA)).count("Exchange hashpartitioning") == 1


def test_every_query_names_its_survey_rows():
    assert ENTRY in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
    assert all(re.fullmatch(r"2\.\d+-\d+( 2\.\d+-\d+)*", rows) for rows in SURVEY.values())
