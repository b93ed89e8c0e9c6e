"""The physical plans that matter at scale."""

import re

import pytest

from millwatch.operators import alerts, etl, features, fleet, survival
from millwatch.plans import jobs
from millwatch.session import work_dir
from millwatch.sources import driver_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return driver_tables.raw_logs(spark, FOLDER)


@pytest.fixture(scope="module")
def table(logs):
    return jobs.fleet_table(logs)


def test_history_is_one_shuffle_of_partial_aggregates(logs, plan_of):
    plan = plan_of(etl.machine_history(logs), "simple")
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert "partial_avg" in plan and plan.index("partial_avg") > plan.index("Exchange")


def test_scans_read_only_what_they_need(logs, plan_of):
    plan = plan_of(etl.first_failure(logs.failures), "simple")
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "props" not in read and "value" in read
    assert "EqualTo(event_type,signup)" in plan and "GreaterThan(value,90.0)" in plan


def test_enrichment_runs_in_the_jvm_without_unpartitioned_windows(table, plan_of):
    curve = survival.km_curve(table)
    plan = plan_of(features.enrich(table, curve), "simple")
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    for window in re.findall(r"Window \[.*", plan):
        assert not window.rstrip().endswith("[]"), window


def test_alert_filter_reaches_one_projection(table, plan_of):
    plan = plan_of(alerts.alerts(features.health_features(table), "2024-06-01 00:00:00"), "simple")
    assert "Exchange" not in plan and "Python" not in plan and len(plan) < 20_000


def test_top_alerts_limit_before_the_shuffle(table, plan_of):
    rows = alerts.alerts(features.health_features(table), "2024-06-01 00:00:00")
    plan = plan_of(alerts.calendar_top(rows), "simple")
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(fleet.lowest_health(features.health_features(table)), "simple")


@pytest.mark.parametrize(("fan_in", "levels"), [(0, {(1, "_epoch"), (2, "_bucket"), (3, "time")}), (1 << 16, {(1, "time")})])
def test_scans_use_as_many_levels_as_points_need(table, plan_of, monkeypatch, fan_in, levels):
    monkeypatch.setattr(survival, "FAN_IN", fan_in)
    plan = plan_of(survival.km_curve(table), "simple")
    windows = re.findall(r"Window \[.*\], \[(group.*?)\], \[(\S+)", plan)
    assert {(len(keys.split(",")), order.split("#")[0]) for keys, order in windows} == levels


def test_queries_leave_no_cached_data(spark, table):
    from millwatch.plans.catalogue import QUERIES
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    QUERIES["enriched_fleet"](spark, FOLDER).count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_figures_by_group_do_not_shuffle_the_fleet(spark, table, plan_of):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = plan_of(survival.add_survival_at_horizons(table, survival.km_curve(table)), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cox_iterations_store_nothing(spark, table):
    from pathlib import Path

    from millwatch.operators.cox import fit_cox
    scratch = Path(work_dir(spark)) / "millwatch"
    before = len(list(scratch.iterdir()))
    fit_cox(table, ["vibration", "age"]).count()
    assert len(list(scratch.iterdir())) == before + 3  # rows, ranks of the times, and rows with their bucket
