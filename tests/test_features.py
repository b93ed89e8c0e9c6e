"""Scores, risk classes and bands at their limits, with NULL and NaN readings."""

import pytest
from pyspark.sql import functions as F

from millwatch import config
from millwatch.functions import risk
from millwatch.functions.numeric import half_even, nan_to_null
from millwatch.operators import features
from millwatch.operators.prep import convert_types, normalise_columns

FLEET = "machineID long, model string, age int, time double, event int, volt double, rotate double, " \
        "pressure double, vibration double, error_count long, maint_count long"


def machine(**changes):
    row = dict(machineID=1, model="model1", age=2, time=50.0, event=1, volt=170.0, rotate=450.0, pressure=100.0,
               vibration=38.0, error_count=10, maint_count=20)
    row.update(changes)
    return tuple(row.values())


def scored(spark, *rows):
    df = features.health_features(spark.createDataFrame(list(rows), FLEET), fill=False)
    return df.orderBy("machineID").collect()


def test_scores_and_health(spark):
    r = scored(spark, machine())[0]
    assert (r.vibration_score, r.pressure_score, r.error_score, r.maintenance_score, r.age_score) == (94, 100, 80, 60, 90)
    assert r.global_health_score == 87.2
    assert r.degradation_rate == half(38 / 3, 4) and r.risk_factor == half((100 - 87.2) * r.degradation_rate, 2)
    assert r.vibration_pressure_ratio == pytest.approx(0.38) and r.error_maintenance_ratio == half(10 / 21, 2)


def half(x, digits):
    import numpy as np
    return float(np.round(x, digits))


def test_score_limits(spark):
    low = scored(spark, machine(vibration=200.0, pressure=10.0, error_count=99, maint_count=99, age=40))[0]
    assert (low.vibration_score, low.pressure_score, low.error_score, low.maintenance_score, low.age_score) == (0, 0, 0, 100, 0)
    calm = scored(spark, machine(vibration=20.0, error_count=0, maint_count=40, age=0))[0]
    assert calm.vibration_score == 130 and calm.global_health_score == 100


def test_missing_readings_stay_unknown(spark):
    a, b, c = scored(spark, machine(machineID=1, age=None), machine(machineID=2, vibration=None),
                     machine(machineID=3, pressure=0.0, maint_count=None))
    assert a.age_score is None and a.global_health_score is None and a.risk_level == "FAIBLE"
    assert b.vibration_score is None and b.vibration_pressure_ratio == 0 and b.degradation_rate is None
    assert c.vibration_pressure_ratio == 0 and c.error_maintenance_ratio is None


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 50.0)], "machineID long, vibration double")
    rows = nan_to_null(df).orderBy("machineID").collect()
    assert rows[0].vibration is None and rows[1].vibration == 50
    level = features.add_risk_level(nan_to_null(df)).where("machineID = 1").first().risk_level
    assert level == "MODÉRÉ"  # health column absent: neutral 50, and an unknown vibration triggers nothing


@pytest.mark.parametrize("health, vibration, errors, level", [
    (29.99, 0, 0, "CRITIQUE"), (30, 0, 0, "ÉLEVÉ"), (49.99, 0, 0, "ÉLEVÉ"), (50, 0, 0, "MODÉRÉ"), (69.99, 0, 0, "MODÉRÉ"),
    (70, 0, 0, "FAIBLE"), (80, 45.01, 0, "CRITIQUE"), (80, 45, 0, "ÉLEVÉ"), (80, 40.01, 0, "ÉLEVÉ"), (80, 40, 0, "FAIBLE"),
    (80, 0, 41, "CRITIQUE"), (80, 0, 40, "ÉLEVÉ"), (80, 0, 31, "ÉLEVÉ"), (80, 0, 30, "FAIBLE"), (None, 0, 0, "FAIBLE"),
    (None, 46, None, "CRITIQUE"), (60, None, None, "MODÉRÉ")])
def test_risk_level(spark, health, vibration, errors, level):
    row = tuple(v if v is None else float(v) for v in (health, vibration, errors))
    df = spark.createDataFrame([row], "global_health_score double, vibration double, error_count double")
    assert features.add_risk_level(df).first().risk_level == level


def test_custom_thresholds(spark):
    df = spark.createDataFrame([(60.0, 1.0, 1)], "global_health_score double, vibration double, error_count long")
    strict = config.RiskThresholds(critical_health=65)
    assert features.add_risk_level(df, strict).first().risk_level == "CRITIQUE"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x double").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("level, s30, combined", [
    ("FAIBLE", 0.29, "CRITIQUE"), ("FAIBLE", 0.3, "ÉLEVÉ"), ("MODÉRÉ", 0.59, "ÉLEVÉ"), ("MODÉRÉ", 0.6, "MODÉRÉ"),
    ("CRITIQUE", 0.5, "CRITIQUE"), ("ÉLEVÉ", 0.29, "CRITIQUE"), ("ÉLEVÉ", 0.5, "ÉLEVÉ"), ("FAIBLE", None, "FAIBLE")])
def test_escalation(spark, level, s30, combined):
    assert one(spark, s30, lambda x: risk.escalated_risk(F.lit(level), x)) == combined


@pytest.mark.parametrize("health, band, cut", [
    (0.0, "Critique", None), (29.9, "Critique", "Critique"), (30.0, "Élevé", "Critique"), (60.0, "Modéré", "Élevé"),
    (79.9, "Modéré", "Modéré"), (80.0, "Faible", "Modéré"), (100.0, "Faible", "Faible"), (None, "Faible", None)])
def test_bands(spark, health, band, cut):
    assert one(spark, health, risk.health_band) == band
    assert one(spark, health, risk.health_band_right_closed) == cut


@pytest.mark.parametrize("health, level, action", [
    (29.9, "CRITIQUE", "ARRÊT IMMÉDIAT"), (30.0, "ÉLEVÉ", "MAINTENANCE URGENTE"), (50.0, "MODÉRÉ", "SURVEILLANCE"),
    (70.0, "FAIBLE", "SURVEILLANCE")])
def test_health_only_rules(spark, health, level, action):
    assert one(spark, health, risk.risk_from_health) == level
    assert one(spark, health, risk.attention_action) == action


@pytest.mark.parametrize("value, digits, want", [(0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (-1.5, 0, -2.0), (None, 1, None)])
def test_rounding_is_half_even(spark, value, digits, want):
    assert one(spark, value, lambda x: half_even(x, digits)) == want


@pytest.mark.parametrize("model, label", [("model1", "B"), ("MODEL2", "A"), ("model3", "C"), ("model9", "C"), (None, "C")])
def test_model_labels(spark, model, label):
    df = spark.createDataFrame([(model,)], "model string")
    assert features.add_model_label(df).first().model_label == label


def test_labels_are_composed_unicode():
    assert config.ELEVE.encode() == b"\xc3\x89LEV\xc3\x89" and config.MODERE.encode() == b"MOD\xc3\x89R\xc3\x89"


def test_absent_columns_are_tolerated(spark):
    df = spark.createDataFrame([(1, 40.0)], "machineID long, vibration double")
    r = features.add_risk_factor(features.add_degradation(features.add_global_health(
        features.add_component_scores(df)))).first()
    assert r.global_health_score == 27.0 and r.degradation_rate == 0 and "pressure_score" not in r.asDict()
    bare = features.add_global_health(spark.createDataFrame([(1,)], "machineID long")).first()
    assert bare.global_health_score == 0


def test_raw_variant_agrees_before_rounding(spark):
    rows = [machine(machineID=i, vibration=35 + i / 7, pressure=95 + i / 3, error_count=i) for i in range(30)]
    df = spark.createDataFrame(rows, FLEET)
    raw = {r.machineID: r for r in features.raw_health_features(df).collect()}
    for r in features.health_features(df).collect():
        assert r.global_health_score == half(raw[r.machineID].global_health_score, 2)
        assert r.degradation_rate == half(raw[r.machineID].degradation_rate, 4)


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Machine ID", " Volt ", "Error Count"])
    assert normalise_columns(df).columns == ["machineID", "volt", "error_count"]
    assert normalise_columns(df.toDF("machineid", "a", "b")).columns[0] == "machineID"


def test_type_coercion(spark):
    df = spark.createDataFrame([("1", "1.5", "x"), ("3.0", "bad", "y"), ("", None, "z")], "i string, d string, s string")
    out = convert_types(df, {"i": "bigint", "d": "double", "absent": "int"})
    assert dict(out.dtypes) == {"i": "bigint", "d": "double", "s": "string"}
    assert [(r.i, r.d) for r in out.collect()] == [(1, 1.5), (3, None), (None, None)]
