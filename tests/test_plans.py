"""Properties of the plans that decide how the queries scale."""

import re

import pytest

from flowgauge.catalog import REGISTERED, report_of
from flowgauge.operators.rollup import hourly_traffic, trailing_readings
from flowgauge.sources.tables import event_readings

EAGER_STREAMS = {
    "raw_events_stream",
    "window_congestion_stream",
    "window_congestion_faulty_stream",
    "window_congestion_replay",
    "windows_closed_and_open",
    "critical_alerts_stream",
}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - EAGER_STREAMS))
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    plan = physical(REGISTERED[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert bad not in plan


def test_bound_reaches_the_scan(spark, sf_dir):
    plan = physical(hourly_traffic(trailing_readings(event_readings(spark, sf_dir))))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,2024-01-29T", plan)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double,props:string>" in plan


def test_newest_time_reads_one_column(spark, sf_dir):
    plan = physical(REGISTERED["latest_reading"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_alert_filter_is_pushed(spark, sf_dir):
    plan = physical(REGISTERED["critical_alerts"](spark, sf_dir))
    assert "LessThan(value,10.0)" in plan


def test_rollup_combines_before_the_shuffles(spark, sf_dir):
    plan = physical(hourly_traffic(trailing_readings(event_readings(spark, sf_dir))))
    assert "partial_sum" in plan and "partial_count" in plan
    # The second exchange moves a row for each sensor, hour and band of speeds.
    assert plan.count("Exchange") == 2


def test_peak_hours_limit_each_group_before_the_shuffle(spark, sf_dir):
    plan = physical(report_of(spark, sf_dir).peaks)
    assert plan.count("WindowGroupLimit") == 2


def test_no_rank_in_one_task(spark, sf_dir):
    """The only windows without a key are over the slices of the ranking and the hours of a day."""
    plan = physical(REGISTERED["report_rows"](spark, sf_dir))
    assert "dense_rank" not in plan.lower()
