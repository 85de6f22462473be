"""The registered queries agree with their SQL, and their plans hold up."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import compare, duck  # noqa: E402
from contract.oracle import oracle_sql  # noqa: E402
from contract.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="shared tables are not here")

SAMPLE = [
    "clean_readings_sliced", "rolling_features_time", "fleet_health", "failure_forecasts",
    "draft_work_orders", "similar_cases", "suppress_offline_sliced",
]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert len(QUERIES) > 100
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, duck(DATA), DATA, name) is None


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() == 25


@needs_data
@pytest.mark.parametrize("name", ["clean_readings", "fleet_health", "oee_daily_trend", "similar_cases", "parts_availability",
                                  "sensor_registry", "performance_baseline", "repair_effect"])
def test_no_pairwise_joins_and_no_python(spark, plan_of, name):
    text = plan_of(contract.queries()[name](spark, DATA))
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "FlatMapGroupsInPandas"):
        assert slow not in text


@needs_data
def test_filters_and_columns_reach_the_scan(spark, plan_of):
    text = plan_of(contract.queries()["recent_events"](spark, DATA))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(event_type,error)" in text and "GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in scan


@needs_data
def test_baseline_uses_one_window_sort(spark, plan_of):
    text = plan_of(contract.queries()["performance_baseline"](spark, DATA))
    assert text.count("Exchange hashpartitioning(machine_id") == 1
    assert text.count("+- Window") == 1
