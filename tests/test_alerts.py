"""Alert rules at their limits, unknown readings, ordering, calendar and history."""

import itertools
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millwatch.config import AlertRules
from millwatch.functions import alerting as rules
from millwatch.operators import alerts

FLEET = "machineID long, model string, age int, time double, global_health_score double, degradation_rate double, error_count long"
AS_OF = "2024-06-01 00:00:00"


def python_level(rul, p, r):
    base = next(level for level, limit in (("CRITIQUE", 7), ("HAUTE", 14), ("MOYENNE", 30), ("BASSE", 1e9)) if rul <= limit)
    if p > 0.8 or r > 0.8:
        return "CRITIQUE"
    if p > 0.6 or r > 0.6:
        return "HAUTE" if base in ("BASSE", "MOYENNE") else base
    if p > 0.4 and base == "BASSE":
        return "MOYENNE"
    return base


def test_levels_on_a_grid_of_limits(spark):
    ruls = [-1.0, 6.99, 7.0, 7.01, 14.0, 14.01, 30.0, 30.01, 365.0, 400.0]
    chances = [0.0, 0.39, 0.4, 0.41, 0.6, 0.61, 0.8, 0.81, 1.0]
    cases = list(itertools.product(ruls, chances, chances))
    df = spark.createDataFrame(cases, "rul double, p double, r double")
    columns = (F.col("rul"), F.col("p"), F.col("r"))
    got = df.withColumns({"level": rules.alert_level(*columns), "raised": rules.raises_alert(*columns)}).collect()
    for row in got:
        want = python_level(row.rul, row.p, row.r)
        assert row.level == want
        assert row.raised == (want != "BASSE")


def test_unknown_readings_count_as_worst_case(spark):
    df = spark.createDataFrame([(1, "m", 10, 100.0, None, None, None), (2, "m", 10, 100.0, 130.0, 5.0, 25)], FLEET)
    a, b = alerts.score_risk(df).orderBy("machineID").collect()
    assert (a.health_risk, a.degradation_risk, a.age_risk, a.error_risk, a.probability) == (1, 1, 0.5, 1, 1)
    assert (b.health_risk, b.degradation_risk, b.age_risk, b.error_risk, b.probability) == (0, 0.5, 0.5, 0.5, 0)
    assert a.alert_level == "CRITIQUE" and b.total_risk == pytest.approx(0.3 * 0.5 + 0.2 * 0.5 + 0.1 * 0.5)


def test_rows_that_cannot_be_scored_are_left_out(spark):
    df = spark.createDataFrame([(1, "m", None, 5.0, 50.0, 1.0, 1), (None, "m", 3, 5.0, 50.0, 1.0, 1),
                                (3, "m", 3, None, 50.0, 1.0, 1), (4, None, 3, 5.0, 50.0, 1.0, 1)], FLEET)
    rows = alerts.alerts(df, AS_OF).collect()
    assert [(r.machine_id, r.model) for r in rows] == [(4, "Unknown")]


def test_alert_row(spark):
    df = spark.createDataFrame([(7, "model2", 10, 12.34, 61.25, 2.0, 20)], FLEET)
    r = alerts.alerts(df, AS_OF).first()
    assert (r.alert_level, r.rul_days, r.prob_failure, r.recommended_action, r.priority) == (
        "HAUTE", 12.3, 0.388, "CETTE_SEMAINE", 1)
    assert (r.maintenance_deadline, r.health_score, r.age, str(r.timestamp)) == ("2024-06-11", 61.2, 10, AS_OF)


def test_defaults_for_absent_columns(spark):
    df = spark.createDataFrame([(1,)], "machineID long")
    r = alerts.alerts(df, AS_OF).first()
    assert (r.rul_days, r.prob_failure, r.alert_level, r.health_score, r.age, r.model) == (30, 0.5, "MOYENNE", 50, 0, "Unknown")


def test_predictions_replace_the_heuristics(spark):
    df = spark.createDataFrame([(1, "m", 1, 300.0, 100.0, 0.0, 0, 0.95, 0.2)], FLEET + ", pred_proba double, pred_rul double")
    r = alerts.alerts(df, AS_OF, predicted_probability="pred_proba", predicted_rul="pred_rul").first()
    assert (r.alert_level, r.rul_days, r.prob_failure) == ("CRITIQUE", 1.0, 0.95)


def _alert_rows(spark, ruls, health=80.0):
    rows = [(i, f"model{i % 2}", 1, float(r), health, 0.0, 0) for i, r in enumerate(ruls)]
    return alerts.alerts(spark.createDataFrame(rows, FLEET), AS_OF)


def test_order_is_total(spark):
    rows = alerts.ranked(_alert_rows(spark, [20, 3, 9, 3, 25]).repartition(4)).collect()
    assert [r.machine_id for r in rows] == [1, 3, 2, 0, 4]


def test_calendar(spark):
    ruls = [1.0, 2.0, 2.1, 8.9, 9.0, 23.0, 29.9, 30.0]
    rows = _alert_rows(spark, ruls)
    calendar = alerts.maintenance_calendar(rows).orderBy("week", "position").collect()
    assert [(r.week_label, r.position, r.machine_id) for r in calendar] == [
        ("Semaine_1", 1, 2), ("Semaine_1", 2, 3), ("Semaine_2", 1, 4), ("Semaine_3", None, None),
        ("Semaine_4", 1, 5), ("Semaine_4", 2, 6), ("Semaine_4", 3, 7)]
    counts = {r.week_label: r.alerts for r in alerts.calendar_week_counts(rows).collect()}
    assert counts == {"Semaine_1": 2, "Semaine_2": 1, "Semaine_3": 0, "Semaine_4": 3}
    assert {r.machine_id for r in alerts.overdue(rows).collect()} == {0, 1}


def test_calendar_positions_of_a_crowded_week(spark):
    rows = _alert_rows(spark, [5.0] * 300 + [20.0] * 10)
    placed = alerts.maintenance_calendar(rows).where("week = 1").orderBy("position").collect()
    assert [(r.position, r.machine_id) for r in placed] == [(i + 1, i) for i in range(300)]
    top = alerts.calendar_top(rows).where("week = 1").orderBy("position").collect()
    assert [r.machine_id for r in top] == [0, 1, 2, 3, 4]


def test_statistics(spark):
    rows = _alert_rows(spark, [1, 2, 10, 200])
    assert [(r.alert_level, r.alerts) for r in alerts.stats_by_level(rows).orderBy("priority").collect()] == [
        ("CRITIQUE", 2), ("HAUTE", 1), ("MOYENNE", 0), ("BASSE", 0)]
    assert [r.alert_level for r in alerts.nonzero_levels(rows).collect()] == ["CRITIQUE", "HAUTE"]
    assert {r.model: r.alerts for r in alerts.stats_by_model(rows).collect()} == {"model0": 2, "model1": 1}


def test_history_appends_by_day(spark, tmp_path):
    path = str(tmp_path / "history")
    for day in ("2024-06-01", "2024-06-02"):
        rows = spark.createDataFrame([(1, "m", 1, 5.0, 80.0, 0.0, 0)], FLEET)
        alerts.append_history(alerts.alerts(rows, f"{day} 00:00:00"), path)
    history = spark.read.parquet(path)
    assert history.count() == 2 and history.select("as_of_date").distinct().count() == 2
    # a day that runs again replaces its own alerts only, also with fewer of them
    two = spark.createDataFrame([(i, "m", 1, 5.0, 80.0, 0.0, 0) for i in (1, 2, 3)], FLEET)
    counts = lambda: {str(r[0]): r[1] for r in spark.read.parquet(path).groupBy("as_of_date").count().collect()}
    for rows, want in ((two, 3), (two, 3), (two.limit(1), 1)):
        alerts.append_history(alerts.alerts(rows, "2024-06-02 00:00:00"), path)
        assert counts() == {"2024-06-01": 1, "2024-06-02": want}
    alerts.append_history(alerts.alerts(two.limit(0), "2024-06-02 00:00:00"), path)
    assert counts()["2024-06-02"] == 1
    assert alerts.clear_day(spark, path, "2024-06-02") and not alerts.clear_day(spark, path, "2024-06-03")
    assert counts() == {"2024-06-01": 1}


def test_custom_rules(spark):
    df = spark.createDataFrame([(1, "m", 1, 50.0, 55.0, 0.0, 0)], FLEET)
    assert alerts.alerts(df, AS_OF).first().alert_level == "MOYENNE"
    assert alerts.alerts(df, AS_OF, AlertRules(medium_above=0.5)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(*[st.sampled_from([0.0, 0.2, 0.25, 0.45, 0.6, 0.8, 1.0])] * 3, st.permutations([5, 20, 60]))
def test_alerts_are_the_scores_above_the_lowest_level(spark, critical, high, medium, limits):
    """Whatever the rules, the filter loses no machine that the scoring puts above the lowest level."""
    levels = tuple(replace(level, max_rul_days=days) for level, days in zip(AlertRules().levels, [*limits, 365]))
    own = AlertRules(levels=levels, critical_above=critical, high_above=high, medium_above=medium)
    rows = [(i, "m", i % 20, float(r), float(h), 0.0, 0) for i, (r, h) in enumerate(itertools.product((1, 10, 30, 100), (0, 30, 55, 70, 90, 100)))]
    df = spark.createDataFrame(rows, FLEET)
    want = {r.machineID: r.alert_level for r in alerts.score_risk(df, own).where("alert_level <> 'BASSE'").collect()}
    assert {r.machine_id: r.alert_level for r in alerts.alerts(df, AS_OF, own).collect()} == want
