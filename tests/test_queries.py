import pytest
from tests.oracle import DATA, same

import __spark_entry__ as e
from tidegrid.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_other_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("resample_mean", "memory_by_time", "dedup_last", "asof_memory"):
            same(spark, QUERIES[name], SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["time_filter_days"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan or "GreaterThanOrEqual(ts" in plan


def test_types_and_times_reach_the_scan(spark):
    plan = lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [error,signup])" in plan("cell_in_filter")
    assert "GreaterThanOrEqual(ts" in plan("time_filter_exact")


def test_plans_build_once(spark):
    """Errors need one forward pass; splits do not build arrays a second time, nor move them."""
    plan = lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan("forecast_errors").count("MapInArrow") == 1
    assert "collect_list" not in plan("split_time")
    assert plan("split_dev_exact").count("events.parquet") == 0


def test_gap_fill_sorts_once(spark):
    plan = QUERIES["gap_fill"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") + plan.count("Window(") <= 2
