"""Named queries over the driver tables: each builds the machine logs and calls the engine.

Results are narrow tables. Doubles are rounded for comparison here and only here.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millwatch import config
from millwatch.functions import alerting as alert_rules, health as health_rules, risk as risk_rules
from millwatch.functions.numeric import half_even
from millwatch.operators import (
    alerts as alerting, cox, dossier as dossiers, economics, etl, features, fleet, forest, logrank, metrics, ml,
    prep, quality, reports, split, survival,
)
from millwatch.plans.jobs import fleet_table, load_and_prepare, train_job
from millwatch.session import configure, materialise, work_dir
from millwatch.sources import driver_tables, readers, schemas, sinks
from millwatch.streaming import alerts as alert_streams, telemetry as windows
from millwatch.streaming.alerts import write_stream

AS_OF = "2024-06-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- shared inputs

def _logs(spark: SparkSession, folder: str) -> readers.RawLogs:
    return driver_tables.raw_logs(spark, folder)


def _fleet(spark: SparkSession, folder: str) -> DataFrame:
    return fleet_table(_logs(spark, folder))


def _health(spark: SparkSession, folder: str) -> DataFrame:
    return features.health_features(_fleet(spark, folder))


def _raw_health(spark: SparkSession, folder: str) -> DataFrame:
    return features.raw_health_features(_fleet(spark, folder))


def _stored_health(spark: SparkSession, folder: str) -> DataFrame:
    """Health features as a table, for consumers that filter on what they derive from them."""
    return materialise(_health(spark, folder), "health")


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alerting.alerts(_stored_health(spark, folder), AS_OF)


def _stored_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(_alerts(spark, folder), "alerts")


def _analysis(spark: SparkSession, folder: str) -> DataFrame:
    return _analysed(_fleet(spark, folder))


def _analysed(rows: DataFrame) -> DataFrame:
    return dossiers.analysed(features.raw_health_features(rows), survival.rul_columns(rows))


def _with_dropouts(rows: DataFrame) -> DataFrame:
    """Fleet whose sensors failed to report on part of the machines."""
    return rows.withColumns({
        "vibration": F.when(F.col("age") >= 3, F.col("vibration")),
        "pressure": F.when(F.col("maint_count") >= 10, F.col("pressure")),
        "volt": F.when(F.col("event") == 1, F.col("volt")),
        "error_count": F.when(F.col("age") <= 18, F.col("error_count"))})


def _scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    score = (100 - F.col("global_health_score")) / 100
    return _health(spark, folder).select(
        "machineID", "time", F.col("event").alias("label"), score.alias("score"),
        (score > 0.27).cast("int").alias("prediction"), (90 - 100 * score).alias("expected_life"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: half_even(F.col(f.name), digits)
                           for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def _text_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# ---------------------------------------------------------------- sources

@query
def scan_survival_table(spark, folder):
    path = f"{work_dir(configure(spark)).rstrip('/')}/millwatch/scan-{uuid.uuid4().hex}.csv"
    sinks.write_survival_table(etl.survival_table(_logs(spark, folder)), path, "csv")
    return _round(readers.read_survival_table(spark, path))


@query
def scan_raw_logs(spark, folder):
    logs, out = _logs(spark, folder), None
    for name, df in logs.tables().items():
        read = readers.conform(df, schemas.RAW_LOGS[name])
        at = F.col("datetime") if "datetime" in read.columns else F.lit(None).cast("timestamp")
        part = read.select("machineID", at.alias("at")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("machineID").alias("machines"),
            F.date_format(F.min("at"), "yyyy-MM-dd HH:mm:ss").alias("first"),
            F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last")).withColumn("log", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def parse_datetime(spark, folder):
    text = F.when(F.col("event_type") == "view", "n/a").otherwise(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    rows = driver_tables.events(spark, folder).select("event_id", text.alias("datetime"))
    return readers.parse_datetime(rows).select("event_id", F.unix_seconds("datetime").alias("seconds"))


# ---------------------------------------------------------------- cleaning

@query
def normalize_columns(spark, folder):
    messy = _logs(spark, folder).telemetry.toDF("DateTime ", "Machine ID", " VOLT", "Rotate", "Pressure", "vibration")
    return prep.normalise_columns(messy).select("machineID", F.unix_micros("datetime").alias("micros"), "volt",
                                                "rotate", "pressure", "vibration")


def _mixed_code(number: Column) -> Column:
    """Texts that parse as int, and the ways in which texts do not: decimals, overflow, junk, blank."""
    kind = number % 6
    return (F.when(kind == 0, (number % 1000).cast("string")).when(kind == 1, "3.0").when(kind == 2, " -7 ")
            .when(kind == 3, "99999999999").when(kind == 4, F.col("event_type")).otherwise(""))


@query
def convert_types(spark, folder):
    text = driver_tables.events(spark, folder).select(
        F.col("event_id").cast("string"), F.col("value").cast("string"), _mixed_code(F.col("event_id")).alias("code"))
    return prep.convert_types(text, {"event_id": "bigint", "value": "double", "code": "int"})


@query
def fill_median(spark, folder):
    rows = prep.fill_median(_with_dropouts(_fleet(spark, folder)))
    return _round(rows.select("machineID", "vibration", "pressure", "volt", "rotate",
                              F.col("error_count").cast("double").alias("error_count")))


@query
def fill_mean(spark, folder):
    rows = prep.fill_mean(_with_dropouts(_fleet(spark, folder)), ["vibration", "pressure", "volt", "error_count"])
    return _round(rows.select("machineID", "vibration", "pressure", "volt", "error_count"))


@query
def fill_forward(spark, folder):
    rows = _logs(spark, folder).telemetry.select(
        "machineID", "datetime", F.when(F.col("pressure") >= 95, F.col("vibration")).alias("vibration"),
        F.when(F.col("rotate") < 455, F.col("volt")).alias("volt"))
    filled = prep.fill_forward(rows, ["vibration", "volt"])
    return filled.select("machineID", F.unix_micros("datetime").alias("micros"), "vibration", "volt")


@query
def fill_zero(spark, folder):
    rows = prep.fill_constant(_with_dropouts(_fleet(spark, folder)), ["vibration", "error_count"])
    return _round(rows.select("machineID", "vibration", "error_count"))


@query
def model_label(spark, folder):
    return features.add_model_label(_logs(spark, folder).machines).select("machineID", "model", "model_label")


# ---------------------------------------------------------------- ETL

@query
def telemetry_bounds(spark, folder):
    return etl.telemetry_bounds(_logs(spark, folder).telemetry).select(
        "machineID", _text_time("start_time"), _text_time("last_telemetry_time"))


@query
def first_failure(spark, folder):
    return etl.first_failure(_logs(spark, folder).failures).select("machineID", _text_time("failure_time"))


@query
def telemetry_means(spark, folder):
    return _round(etl.telemetry_means(_logs(spark, folder).telemetry))


@query
def event_counts(spark, folder):
    logs = _logs(spark, folder)
    return etl.event_counts(logs.errors, logs.maint)


@query
def survival_table(spark, folder):
    return _round(etl.survival_table(_logs(spark, folder)))


# ---------------------------------------------------------------- features

@query
def component_scores(spark, folder):
    return _round(features.add_component_scores(_fleet(spark, folder)).select("machineID", *config.COMPONENT_SCORES))


@query
def global_health(spark, folder):
    return _health(spark, folder).select("machineID", "global_health_score")


@query
def global_health_raw(spark, folder):
    return _round(_raw_health(spark, folder).select("machineID", "global_health_score", "degradation_rate"))


@query
def degradation_rate(spark, folder):
    return _health(spark, folder).select("machineID", "degradation_rate")


@query
def risk_factor(spark, folder):
    return _health(spark, folder).select("machineID", "risk_factor")


@query
def interaction_features(spark, folder):
    return _round(_health(spark, folder).select("machineID", "vibration_pressure_ratio", "error_maintenance_ratio"))


@query
def risk_level(spark, folder):
    return _health(spark, folder).select("machineID", "risk_level")


@query
def health_band(spark, folder):
    return _health(spark, folder).select("machineID", risk_rules.health_band(F.col("global_health_score")).alias("band"))


@query
def health_band_cut(spark, folder):
    return _health(spark, folder).select(
        "machineID", risk_rules.health_band_right_closed(F.col("global_health_score")).alias("band"))


@query
def risk_from_health(spark, folder):
    return _raw_health(spark, folder).select(
        "machineID", risk_rules.risk_from_health(F.col("global_health_score")).alias("risk_level"),
        F.lit(0.8).alias("confidence"))


@query
def enriched_fleet(spark, folder):
    rows = features.enrich(_fleet(spark, folder))
    return _round(rows.select(
        "machineID", "model", "model_label", "time", "event", "global_health_score", "degradation_rate", "risk_factor",
        "vibration_pressure_ratio", "error_maintenance_ratio", "risk_level",
        *[f"survival_at_{h}" for h in config.HORIZONS], "survival_at_time", "combined_risk"))


@query
def combined_risk(spark, folder):
    rows = _fleet(spark, folder)
    escalated = features.add_combined_risk(
        survival.add_survival_at_horizons(features.health_features(rows), survival.km_curve(rows)))
    return escalated.select("machineID", "risk_level", "combined_risk")


# ---------------------------------------------------------------- survival analysis

@query
def km_curve(spark, folder):
    return _round(survival.km_curve(_fleet(spark, folder)))


@query
def km_pooled(spark, folder):
    return _round(survival.km_curve(_fleet(spark, folder), None))


@query
def km_confidence(spark, folder):
    curve = survival.km_confidence(_fleet(spark, folder))
    return _round(curve.select("group", "time", "survival", "lower", "upper"))


@query
def km_summary(spark, folder):
    return _round(survival.km_summary(_fleet(spark, folder)))


@query
def survival_at_horizons(spark, folder):
    rows = _fleet(spark, folder)
    joined = survival.add_survival_at_horizons(rows, survival.km_curve(rows))
    return _round(joined.select("machineID", *[f"survival_at_{h}" for h in config.HORIZONS]))


@query
def survival_at_time(spark, folder):
    rows = _fleet(spark, folder)
    joined = survival.add_survival_at_time(rows, survival.km_curve(rows))
    return _round(joined.select("machineID", "survival_at_time"))


@query
def survival_as_of(spark, folder):
    """Survival of each machine's model at a time of the machine's own, mostly between two points of the curve."""
    rows = _fleet(spark, folder)
    asked = rows.select("machineID", "model", (F.col("age") * 5.3 + F.col("time") / 7 - 4).alias("asked"))
    return _round(survival.add_survival_as_of(asked, survival.km_curve(rows), at="asked").select("machineID", "asked", "survival_as_of"))


@query
def logrank_pairs(spark, folder):
    return _round(logrank.logrank_pairs(_fleet(spark, folder)).select(
        "group_a", "group_b", "statistic", "significant"))


@query
def logrank_p_value(spark, folder):
    """The p value and its band of significance."""
    p = F.col("p_value")
    band = F.when(p < 0.001, "<0.001").when(p < 0.01, "<0.01").when(p < 0.05, "<0.05").when(p < 0.1, "<0.1").otherwise(">=0.1")
    return _round(logrank.logrank_pairs(_fleet(spark, folder)).select("group_a", "group_b", "p_value", band.alias("p_band")))


@query
def cox_fit(spark, folder):
    return cox.fit_cox(_fleet(spark, folder))


@query
def cox_gradient(spark, folder):
    """Gradient of the partial likelihood at the fitted coefficients: zero, except for aliased covariates, which have none."""
    rows = _fleet(spark, folder)
    fitted = cox.fit_cox(rows)
    coefficients = {r["feature"]: r["coef"] for r in fitted.collect()}
    score = cox.partial_likelihood(rows, {c: b for c, b in coefficients.items() if b is not None}).where("quantity = 'gradient'")
    found = fitted.join(score.select(F.col("first").alias("feature"), F.abs("value").alias("gradient")), "feature", "left")
    return _round(found.select("feature", F.isnull("coef").alias("aliased"), "gradient"), 4)


@query
def cox_score(spark, folder):
    """Efron's partial likelihood and its derivatives over all covariates, at fixed coefficients."""
    rows = _fleet(spark, folder)
    names = cox.numeric_features(rows, ("time", "event", "machineID", "model"))
    return _round(cox.partial_likelihood(rows, {c: 0.01 for c in names}), 3)


@query
def rul_estimates(spark, folder):
    return _round(survival.rul_estimates(_fleet(spark, folder)))


# ---------------------------------------------------------------- quality and profile

@query
def missing_values(spark, folder):
    return quality.missing_values(_with_dropouts(_fleet(spark, folder)))


@query
def data_types(spark, folder):
    return quality.data_types(_with_dropouts(_fleet(spark, folder)))


@query
def validate_schema(spark, folder):
    return quality.schema_check(_logs(spark, folder).telemetry)


@query
def survival_consistency(spark, folder):
    return _round(quality.survival_consistency(_fleet(spark, folder)))


@query
def validation_report(spark, folder):
    return _round(quality.validation_report(_with_dropouts(_fleet(spark, folder)).drop("rotate")))


@query
def data_quality_summary(spark, folder):
    return quality.data_quality_summary(_with_dropouts(_fleet(spark, folder)))


@query
def describe_numeric(spark, folder):
    return _round(quality.describe_numeric(_fleet(spark, folder)))


@query
def describe_string(spark, folder):
    return quality.describe_string(_health(spark, folder).select("model", "risk_level", "model_label"))


@query
def fleet_statistics(spark, folder):
    return _round(quality.fleet_statistics(_health(spark, folder)))


@query
def machines_by_model(spark, folder):
    return quality.machines_by_model(_fleet(spark, folder))


@query
def distinct_models(spark, folder):
    return fleet.distinct_models(_fleet(spark, folder))


# ---------------------------------------------------------------- fleet overview

@query
def fleet_kpis(spark, folder):
    rows = _fleet(spark, folder)
    curve = survival.km_curve(rows)
    return _round(fleet.fleet_kpis(survival.add_survival_at_horizons(features.health_features(rows), curve),
                                   critical_below=70, high_risk_below=75))


@query
def health_range(spark, folder):
    return fleet.health_range(_health(spark, folder), 70, 80).select("machineID", "global_health_score")


@query
def health_range_stats(spark, folder):
    return _round(fleet.health_range_stats(_health(spark, folder), 70, 80))


@query
def health_histogram(spark, folder):
    return _round(fleet.health_histogram(_health(spark, folder)))


@query
def health_histogram_by_group(spark, folder):
    return _round(fleet.health_histogram(_health(spark, folder), "risk_level"))


@query
def health_quartiles(spark, folder):
    return _round(fleet.health_quartiles(_health(spark, folder), "model_label"))


@query
def health_stats_grouping_sets(spark, folder):
    return _round(fleet.health_by_grouping_sets(_health(spark, folder)))


@query
def risk_distribution(spark, folder):
    return fleet.risk_distribution(_health(spark, folder))


@query
def risk_heatmap(spark, folder):
    return fleet.risk_heatmap(_health(spark, folder))


@query
def risk_heatmap_t(spark, folder):
    return fleet.risk_heatmap_long(_health(spark, folder), "model")


@query
def fleet_risk_distribution(spark, folder):
    """Machines by the level told from all readings, and how many of them have which level in their dossiers, told from health alone."""
    rows = _fleet(spark, folder)
    analysed = _analysed(rows).select(*rows.columns, F.col("risk_level").alias("dossier_level"))
    return fleet.risk_distribution(features.health_features(analysed), others={"dossier_level": "dossiers"})


@query
def critical_machines(spark, folder):
    return fleet.fleet_risk(_stored_health(spark, folder))


@query
def machine_lookup(spark, folder):
    wanted = _logs(spark, folder).machines.where(F.col("age") >= 15)
    return fleet.machine_lookup(_health(spark, folder), wanted).select("machineID", "model", "global_health_score")


@query
def machine_metrics(spark, folder):
    return _round(fleet.machine_metrics(_fleet(spark, folder)))


@query
def machine_detail(spark, folder):
    return _round(fleet.machine_detail(_health(spark, folder)))


@query
def alert_center(spark, folder):
    return _round(fleet.alert_center(_health(spark, folder), 75))


@query
def top5_at_risk(spark, folder):
    return fleet.lowest_health(_health(spark, folder)).select("machineID", "model", "global_health_score")


@query
def recent_alerts(spark, folder):
    return fleet.recent_alerts(_health(spark, folder), below=72)


@query
def health_trend(spark, folder):
    logs = _logs(spark, folder)
    weekly = windows.telemetry_windows(logs.telemetry, "7 days").select(
        "machineID", F.col("window_start").alias("timestamp"), F.col("vibration_mean").alias("vibration"),
        F.col("pressure_mean").alias("pressure")).join(logs.machines, "machineID", "left")
    trend = fleet.health_trend(features.add_global_health(features.add_component_scores(weekly), digits=None))
    return _round(trend.select("machineID", _text_time("timestamp"), "global_health_score"))


# ---------------------------------------------------------------- alerts and calendar

@query
def risk_score(spark, folder):
    scored = alerting.score_risk(_stored_health(spark, folder))
    return _round(scored.select("machineID", "health_risk", "degradation_risk", "age_risk", "error_risk", "total_risk"))


@query
def alert_level_base(spark, folder):
    return _fleet(spark, folder).select("machineID", alert_rules.base_level(F.col("time")).alias("level"))


@query
def prob_failure(spark, folder):
    scored = alerting.score_risk(_stored_health(spark, folder))
    return _round(scored.select("machineID", F.col("probability").alias("prob_failure")))


@query
def alert_level(spark, folder):
    return alerting.score_risk(_stored_health(spark, folder)).select("machineID", "base_level", "alert_level")


@query
def alerts(spark, folder):
    ranked = alerting.ranked(_alerts(spark, folder))
    return ranked.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def maintenance_calendar(spark, folder):
    calendar = alerting.maintenance_calendar(_stored_alerts(spark, folder))
    return calendar.select("week_label", "position", "machine_id", "model", "alert_level", "rul_days",
                           "maintenance_deadline")


@query
def calendar_week_counts(spark, folder):
    return alerting.calendar_week_counts(_alerts(spark, folder))


@query
def calendar_top5(spark, folder):
    return alerting.calendar_top(_alerts(spark, folder)).select("week_label", "position", "machine_id", "rul_days")


@query
def alert_stats_by_level(spark, folder):
    return alerting.stats_by_level(_alerts(spark, folder))


@query
def alert_stats_by_model(spark, folder):
    return alerting.stats_by_model(_alerts(spark, folder))


@query
def alert_levels_nonzero(spark, folder):
    return alerting.nonzero_levels(_alerts(spark, folder)).select("alert_level", "alerts")


@query
def critical_risks(spark, folder):
    return reports.critical_risks(_stored_alerts(spark, folder)).select("position", "line")


# ---------------------------------------------------------------- economics

@query
def machine_economics(spark, folder):
    return economics.machine_economics(_health(spark, folder))


@query
def roi_by_model(spark, folder):
    return economics.roi_by_model(_fleet(spark, folder))


@query
def fleet_economics(spark, folder):
    return economics.fleet_economics(_fleet(spark, folder))


@query
def machine_economics_override(spark, folder):
    """Costs under other settings than the built-in ones: dearer hours, two known models, higher limits."""
    rules = config.Economics(hourly_downtime_cost=350.0, emergency_repair_cost=900.0, downtime_hours={"model1": 8.0, "model3": 2.5},
                             default_downtime_hours=1.0, high_priority_above=3000, medium_priority_above=1400)
    return economics.machine_economics(_health(spark, folder), rules).select(
        "machineID", "cost_unplanned_downtime", "potential_savings", "savings_percent", "priority")


# ---------------------------------------------------------------- dossiers

@query
def anomalies(spark, folder):
    limits = config.AnomalyLimits(max_vibration=40, min_pressure=99, max_pressure=101, max_errors=30)
    return dossiers.anomalies(_fleet(spark, folder), limits)


@query
def recommendations(spark, folder):
    return dossiers.recommendations(_analysis(spark, folder))


@query
def band_recommendations(spark, folder):
    return dossiers.band_recommendations(_health(spark, folder))


@query
def machine_dossier(spark, folder):
    requested = _logs(spark, folder).machines.select("machineID").union(spark.range(-2, 0).toDF("machineID"))
    rows = dossiers.dossier(_analysis(spark, folder), requested)
    return _round(rows.select(
        "machineID", "identification.model", "identification.age", "identification.pattern_failure",
        "sante_globale.score_global", "sante_globale.sante_mecanique", "sante_globale.sante_pression",
        "prediction_risque.risk_level", "prediction_risque.confidence", "estimation_rul.rul_median",
        "estimation_rul.survival_30d", "estimation_rul.survival_90d", "estimation_rul.current_survival_time",
        F.size("anomalies_detectees").alias("anomalies"),
        F.concat_ws(" / ", "recommandations_maintenance").alias("recommendations"),
        "indicateurs_techniques.vibration", "indicateurs_techniques.pression", "indicateurs_techniques.rotation",
        "indicateurs_techniques.erreurs_cumulees", "indicateurs_techniques.maintenances_realisees"))


@query
def trained_dossier(spark, folder):
    """Dossiers with the classifier's level and probabilities and the failure pattern."""
    rows = _fleet(spark, folder)
    labelled = materialise(features.add_risk_level(features.raw_health_features(rows)), "health")
    patterned = ml.assign_failure_patterns(labelled, ml.train_failure_patterns(labelled))
    predicted = ml.predict_risk(patterned, ml.train_risk_classifier(labelled))
    cards = dossiers.dossier(dossiers.analysed(predicted, survival.rul_columns(rows)))
    return _round(cards.select(
        "machineID", "identification.pattern_failure", "prediction_risque.risk_level", "prediction_risque.confidence",
        F.explode("prediction_risque.probabilities").alias("level", "probability"), "estimation_rul.rul_median"))


@query
def context_string(spark, folder):
    rows = dossiers.dossier(_analysis(spark, folder))
    return rows.select("machineID", dossiers.context_string().alias("context"))


# ---------------------------------------------------------------- reports

@query
def executive_kpis(spark, folder):
    health = _stored_health(spark, folder)
    return reports.executive_kpis(health, economics.fleet_economics(health), alerting.alerts(health, AS_OF))


@query
def roi_analysis(spark, folder):
    return reports.roi_analysis(economics.fleet_economics(_fleet(spark, folder)))


@query
def projections(spark, folder):
    return reports.projections(economics.fleet_economics(_fleet(spark, folder)))


@query
def instructions(spark, folder):
    health = _stored_health(spark, folder)
    strategy = reports.strategic_recommendations(economics.fleet_economics(health))
    return strategy.unionByName(reports.instructions(alerting.alerts(health, AS_OF)))


@query
def maintenance_report(spark, folder):
    parts = spark.read.parquet(f"{folder}/part.parquet").select(
        F.col("p_partkey").alias("position"), F.col("p_name").alias("part"), F.col("p_size").alias("quantity"),
        F.when(F.col("p_size") < 10, "HAUTE").otherwise("BASSE").alias("urgency"))
    return reports.maintenance_sections(_stored_alerts(spark, folder), parts)


@query
def executive_report(spark, folder):
    rows = _stored_health(spark, folder)
    return reports.executive_report(rows, materialise(economics.fleet_economics(rows), "economics"),
                                    materialise(alerting.alerts(rows, AS_OF), "alerts"), AS_OF)


@query
def model_alerts(spark, folder):
    """Alerts whose probability and remaining life come from the forests."""
    rows = _stored_health(spark, folder)
    scored = materialise(ml.score_fleet(rows, ml.train_classifier(rows).model, ml.train_regressor(rows).model), "scored")
    return _round(alerting.alerts(scored, AS_OF, predicted_probability="pred_proba", predicted_rul="pred_rul").select(
        "machine_id", "alert_level", "rul_days", "prob_failure", "risk_score"))


@query
def model_decision_pack(spark, folder):
    rows = _stored_health(spark, folder)
    scored = ml.score_fleet(rows, ml.train_classifier(rows).model)
    return reports.decision_pack(scored, economics.fleet_economics(rows), "pred_proba")


@query
def alert_history(spark, folder):
    """Two days of alerts, the first one run twice, written to a history and read back, counted by day and level."""
    rows = _stored_health(spark, folder)
    path = f"{work_dir(spark).rstrip('/')}/millwatch/history-{uuid.uuid4().hex}"
    for day in ("2024-06-01 00:00:00", "2024-06-02 00:00:00", "2024-06-01 00:00:00"):
        alerting.append_history(alerting.alerts(rows, day), path)
    return spark.read.parquet(path).groupBy(F.col("as_of_date").cast("string").alias("day"), "alert_level").agg(
        F.count("*").alias("alerts"))


@query
def alerts_total(spark, folder):
    """Alerts by model with the total next to the counts."""
    return _alerts(spark, folder).rollup("model").agg(F.count("*").alias("alerts"))


@query
def technical_prompt(spark, folder):
    rows = _stored_health(spark, folder)
    figures = ml.train_classifier(rows).metrics.unionByName(ml.train_regressor(rows).metrics)
    return reports.technical_prompt(figures, quality.fleet_statistics(rows))


@query
def statistics_bundle(spark, folder):
    """Every figure of the bundle as a row."""
    rows = _stored_health(spark, folder).select(*config.SURVIVAL_COLUMNS, "global_health_score", "risk_level", "model_label")
    return _round(quality.long_form(quality.statistics(rows), quality.BUNDLE_KEYS))


@query
def replaced_dataset(spark, folder):
    """Machines that readers of a dataset see: one that began before it was replaced, one after, and one of a version made current again."""
    place = f"{work_dir(configure(spark)).rstrip('/')}/millwatch/dataset-{uuid.uuid4().hex}"
    rows, data = _fleet(spark, folder), readers.Catalogue({"fleet": f"{place}/fleet"})
    seen = []
    for version, part in (("1", rows), ("2", rows.where("age >= 10"))):
        sinks.write_survival_table(part, f"{place}/upload-{version}.csv", "csv")
        sinks.replace_dataset(spark, f"{place}/upload-{version}.csv", f"{place}/fleet", version)
        seen.append(data.read(spark, "fleet"))
    sinks.make_current(spark, f"{place}/fleet", "1")
    seen.append(data.read(spark, "fleet"))
    out = None
    for name, table in zip(("before", "after", "restored"), seen):
        part = table.agg(F.lit(name).alias("reader"), F.count(F.lit(1)).alias("machines"), F.sum("event").alias("failures"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def decision_pack(spark, folder):
    rows = _fleet(spark, folder)
    return reports.decision_pack(features.health_features(rows), economics.fleet_economics(rows))


@query
def report_prompts(spark, folder):
    rows = _fleet(spark, folder)
    health = features.raw_health_features(rows)
    cards = dossiers.dossier(dossiers.analysed(health, survival.rul_columns(rows)))
    return reports.machine_prompts(cards, economics.fleet_economics(rows), fleet.fleet_kpis(health))


@query
def technical_report(spark, folder):
    rows = _stored_health(spark, folder)
    trained = [ml.train_classifier(rows), ml.train_regressor(rows)]
    weights = trained[0].importance.unionByName(trained[1].importance)
    return reports.technical_sections(
        trained[0].metrics.unionByName(trained[1].metrics), ml.top_features(weights), quality.data_quality_summary(rows))


# ---------------------------------------------------------------- what is written and read again

def _place(spark: SparkSession, name: str) -> str:
    return f"{work_dir(configure(spark)).rstrip('/')}/millwatch/{name}-{uuid.uuid4().hex}"


@query
def training_report_file(spark, folder):
    """A report of metrics written as JSON and read again."""
    report = metrics.classification_report(_scored_labels(spark, folder))
    rows = report.select(F.lit("scored").alias("model"), F.lit("f1").alias("metric"), F.col("scope").alias("label"), F.col("f1").alias("value"))
    path = _place(spark, "report")
    sinks.write_metrics(rows, path)
    return _round(sinks.read_metrics(spark, path))


@query
def decision_pack_file(spark, folder):
    """The decision pack written as a text file: its lines and where they stand."""
    rows = _fleet(spark, folder)
    pack = materialise(reports.decision_pack(features.health_features(rows), economics.fleet_economics(rows)), "pack")
    path = _place(spark, "pack")
    sinks.write_lines(reports.decision_pack_lines(pack, AS_OF), path)
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("place", "line"))
    return text.where("line <> ''")


@query
def saved_models(spark, folder):
    """Machines whose scores differ between the trained models and those saved and loaded again, and a model that was never saved."""
    rows, path = _stored_health(spark, folder), _place(spark, "models")
    clf, reg = ml.train_classifier(rows), ml.train_regressor(rows)
    sinks.save_models({"classifier": clf.model, "regressor": reg.model}, path)
    loaded = sinks.load_models(spark, ("classifier", "regressor", "never"), path)
    one = ml.score_fleet(rows, clf.model, reg.model).select("machineID", "pred_proba", "pred_rul")
    two = ml.score_fleet(rows, loaded["classifier"], loaded["regressor"]).select("machineID", F.col("pred_proba").alias("p"), F.col("pred_rul").alias("r"))
    return one.join(two, "machineID").agg(F.count("*").alias("machines"), F.count_if((F.col("pred_proba") != F.col("p")) | (F.col("pred_rul") != F.col("r"))).alias("differ"),
                                          F.lit(len(loaded)).alias("models"))


@query
def load_and_validate(spark, folder):
    """Tables that are loaded and enriched, and one that is rejected because columns are missing."""
    rows, place = _fleet(spark, folder), _place(spark, "upload")
    out = None
    for name, part in (("whole", rows), ("old", rows.where("age >= 10")), ("short", rows.drop("volt", "age"))):
        sinks.write_survival_table(part, f"{place}-{name}.csv", "csv")
        try:
            found = load_and_prepare(spark, f"{place}-{name}.csv").agg(F.count("*").alias("machines"), F.count("combined_risk").alias("enriched"))
            row = found.select(F.lit(name).alias("upload"), F.lit(None).cast("string").alias("problem"), "machines", "enriched")
        except ValueError as problem:
            row = spark.range(1).select(F.lit(name).alias("upload"), F.lit(str(problem)).alias("problem"), F.lit(0).cast("long").alias("machines"), F.lit(0).cast("long").alias("enriched"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def training_job(spark, folder):
    """Sample sizes in the report of the whole training job, which loads, enriches, trains, saves and reports."""
    place = _place(spark, "job")
    sinks.write_survival_table(_fleet(spark, folder), f"{place}.csv", "csv")
    trained = train_job(spark, f"{place}.csv", place)
    report = sinks.read_metrics(spark, f"{place}/training_report")
    return report.where("metric IN ('n_samples_train', 'n_samples_test')").select("model", "metric", F.col("value").cast("long").alias("rows"), F.lit(len(trained)).alias("models"))


@query
def alert_stream(spark, folder):
    """Alerts of a stream of fleet snapshots, written to a history by batch and read again."""
    place = _place(spark, "stream")
    rows = _fleet(spark, folder)
    rows.repartition(3).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    running = alert_streams.write_history(alert_streams.alert_stream(stream, AS_OF), f"{place}/history", f"{place}/state", once=True)
    running.awaitTermination()
    return spark.read.parquet(f"{place}/history").select("machine_id", "alert_level", "rul_days", "prob_failure", "risk_score")


@query
def telemetry_stream(spark, folder):
    """Sliding windows of a stream of readings, closed by its watermark: all but those that later readings could still change."""
    place = _place(spark, "readings")
    rows = _logs(spark, folder).telemetry
    last = rows.agg(F.max("datetime")).first()[0]
    rows.withColumn("_day", F.to_date("datetime")).repartition(4, "_day").drop("_day").write.parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    rolled = windows.telemetry_windows(stream, "14 days", "7 days", "1 hour")
    write_stream(rolled, f"{place}/out", f"{place}/state", once=True).awaitTermination()
    closed = spark.read.schema(rolled.schema).parquet(f"{place}/out").where(F.col("window_end") <= F.lit(last) - F.expr("INTERVAL 15 DAYS"))
    return _round(closed.select("machineID", _text_time("window_start"), "rotate_mean", "pressure_std", "readings"))


# ---------------------------------------------------------------- machine learning

@query
def random_split(spark, folder):
    return split.random_split(_fleet(spark, folder)).select("machineID", "is_test")


@query
def stratified_split(spark, folder):
    return split.stratified_split(_fleet(spark, folder)).select("machineID", "event", "is_test")


@query
def classification_report(spark, folder):
    return _round(metrics.classification_report(_scored_labels(spark, folder)))


@query
def roc_auc(spark, folder):
    return _round(metrics.roc_auc(_scored_labels(spark, folder)))


@query
def regression_metrics(spark, folder):
    return _round(metrics.regression_metrics(_scored_labels(spark, folder), "time", "expected_life"))


@query
def standardize(spark, folder):
    rows = ml.standardise(_fleet(spark, folder))
    return _round(rows.select("machineID", *[f"{c}_z" for c in config.CLUSTER_FEATURES]))


@query
def rf_classifier(spark, folder):
    return ml.train_classifier(_health(spark, folder)).metrics


@query
def rf_regressor(spark, folder):
    return ml.train_regressor(_health(spark, folder)).metrics


def _importances(rows: DataFrame) -> DataFrame:
    return ml.train_classifier(rows).importance.unionByName(ml.train_regressor(rows).importance)


@query
def split_sizes(spark, folder):
    """What the forests are trained and tested on, by label."""
    rows = _stored_health(spark, folder)
    stratified = split.stratified_split(rows).groupBy(F.lit("classifier").alias("model"), F.col("event").alias("label"), "is_test")
    random = split.random_split(rows).groupBy(F.lit("regressor").alias("model"), F.lit(None).cast("int").alias("label"), "is_test")
    return stratified.agg(F.count("*").alias("machines")).unionByName(random.agg(F.count("*").alias("machines")))


@query
def performance_summary(spark, folder):
    rows = _stored_health(spark, folder)
    return _round(ml.performance_summary([ml.train_classifier(rows), ml.train_regressor(rows)]))


@query
def classifier_grid(spark, folder):
    """Cross-validated search over ``ml.CLASSIFIER_GRID``, with the score of each of its 24 combinations."""
    return _round(ml.train_classifier(_stored_health(spark, folder), grid=ml.CLASSIFIER_GRID).metrics)


@query
def regressor_grid(spark, folder):
    """Cross-validated search over ``ml.REGRESSOR_GRID``, with the score of each of its 12 combinations."""
    return _round(ml.train_regressor(_stored_health(spark, folder), grid=ml.REGRESSOR_GRID).metrics)


@query
def feature_importance(spark, folder):
    return _importances(_stored_health(spark, folder))


@query
def top_features(spark, folder):
    return ml.top_features(_importances(_stored_health(spark, folder)))


@query
def optimal_features(spark, folder):
    """The features that training picks by itself, in order."""
    names = ml.optimal_features(_stored_health(spark, folder).drop("pressure"))
    return spark.createDataFrame(list(enumerate(names, 1)), "position int, feature string")


@query
def top_features_certificate(spark, folder):
    """Of each model's top features: how many, and how many of the other features are more important than the last of them."""
    weights = materialise(_importances(_stored_health(spark, folder)), "weights")
    top = ml.top_features(weights).select("model", "feature", "position", "importance")
    least = top.groupBy("model").agg(F.count("*").alias("top"), F.min("importance").alias("least"), F.max("position").alias("last"))
    rest = weights.join(top.select("model", "feature"), ["model", "feature"], "left_anti").join(least, "model")
    return rest.groupBy("model", "top", "last").agg(F.count_if(F.col("importance") > F.col("least")).alias("above"), F.count("*").alias("others"))


@query
def grid_certificate(spark, folder):
    """Combinations that both grids scored, and how many of them score better than the chosen one."""
    rows, out = _stored_health(spark, folder), None
    for trained, sign in ((ml.train_classifier(rows, grid=ml.CLASSIFIER_GRID), 1), (ml.train_regressor(rows, grid=ml.REGRESSOR_GRID), -1)):
        same = [F.col(k) == v for k, v in trained.chosen.items()]
        chosen = trained.scores.where(same[0] & same[1] & same[2] & same[3]).select(F.col("score").alias("chosen"))
        part = trained.scores.join(chosen).groupBy(F.lit(trained.name).alias("model")).agg(
            F.count("*").alias("combinations"), F.count_if(sign * (F.col("score") - F.col("chosen")) > 1e-8).alias("better"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def risk_classifier(spark, folder):
    rows = features.add_risk_level(_raw_health(spark, folder))
    predicted = ml.predict_risk(rows, ml.train_risk_classifier(rows))
    return predicted.groupBy("risk_level").agg(F.count(F.lit(1)).alias("machines"))


@query
def risk_prediction(spark, folder):
    rows = features.add_risk_level(_raw_health(spark, folder))
    predicted = ml.predict_risk(rows, ml.train_risk_classifier(rows))
    return _round(predicted.select("machineID", "risk_level", "confidence", F.explode("probabilities").alias("level", "probability")))


@query
def predicted_risk_distribution(spark, folder):
    rows = features.add_risk_level(_raw_health(spark, folder))
    return fleet.risk_distribution(ml.predict_risk(rows, ml.train_risk_classifier(rows)))


@query
def failure_pattern(spark, folder):
    rows = _fleet(spark, folder)
    return ml.assign_failure_patterns(rows, ml.train_failure_patterns(rows)).select("machineID", "failure_pattern")


@query
def score_fleet(spark, folder):
    rows = _stored_health(spark, folder)
    scored = ml.score_fleet(rows, ml.train_classifier(rows).model, ml.train_regressor(rows).model)
    return _round(scored.select("machineID", "pred_proba", "pred_rul"))


def _forests(rows: DataFrame) -> list[tuple[str, ml.Trained, DataFrame]]:
    trained = (ml.train_classifier(rows), ml.train_regressor(rows))
    return [(t.name, t, forest.node_table(rows.sparkSession, t.model.stages[-1])) for t in trained]


@query
def forest_nodes(spark, folder):
    """Nodes of both forests by tree and depth, with what must hold of them: children split their parent's rows, and lower its impurity."""
    out = None
    for name, _, nodes in _forests(_stored_health(spark, folder)):
        child = nodes.select("tree", F.col("parent").alias("node"), F.col("n").alias("child_n"), (F.col("n") * F.col("impurity")).alias("child_i"))
        held = child.groupBy("tree", "node").agg(F.sum("child_n").alias("child_n"), F.sum("child_i").alias("child_i"), F.count("*").alias("children"))
        inner = nodes.where("left >= 0").join(held, ["tree", "node"], "left")
        whole = (F.col("children") == 2) & (F.col("child_n") == F.col("n")) & (F.col("child_i") <= F.col("n") * F.col("impurity") + 1e-6)
        leaves = nodes.where("left < 0").select(F.lit("leaf").alias("kind"), (F.col("feature") == -1).alias("sound"))
        none = spark.createDataFrame([("inner", True), ("leaf", True)], "kind string, sound boolean")  # a forest may have no inner node
        both = inner.select(F.lit("inner").alias("kind"), whole.alias("sound")).unionByName(leaves).unionByName(none)
        part = both.groupBy("kind").agg(F.lit(name).alias("model"), F.coalesce(F.count_if(~F.col("sound")), F.lit(0)).alias("unsound"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def forest_predictions(spark, folder):
    """Scores of the saved models less those of a walk down the node table: nothing, for every machine."""
    rows = _stored_health(spark, folder)
    (_, clf, one), (_, reg, two) = _forests(rows)
    depth = ml.DEFAULT_DEPTH
    walked = forest.predictions(rows, one, clf.features, {"walked_proba": (10_000, depth, 2)}, "class:1")
    walked = forest.predictions(walked, two, reg.features, {"walked_rul": (10_000, depth, 2)}, "prediction")
    scored = ml.score_fleet(walked, clf.model, reg.model)
    return _round(scored.select("machineID", F.abs(F.col("pred_proba") - F.col("walked_proba")).alias("proba_off"),
                                F.abs(F.col("pred_rul") - F.greatest(F.lit(1.0), "walked_rul")).alias("rul_off")))


@query
def risk_prediction_walked(spark, folder):
    """Predicted risk levels and confidences less those of a walk down the node table."""
    rows = materialise(features.add_risk_level(_raw_health(spark, folder)), "labelled")
    model = ml.train_risk_classifier(rows)
    nodes, labels = forest.node_table(spark, model.stages[-2]), model.stages[-1].getLabels()
    predicted = ml.predict_risk(rows, model)
    for k in range(len(labels)):
        predicted = forest.predictions(predicted, nodes, config.SCORING_FEATURES, {f"w{k}": (10_000, ml.DEFAULT_DEPTH, 2)}, f"class:{k}")
    off = F.greatest(*[F.abs(F.col("probabilities")[name] - F.col(f"w{k}")) for k, name in enumerate(labels)], F.lit(0.0))
    return _round(predicted.select("machineID", off.alias("off"), (F.col("probabilities")[F.col("risk_level")] == F.col("confidence")).alias("is_level")))


@query
def importance_walked(spark, folder):
    """Importances less the sums of impurity decrease over the node table."""
    out = None
    for name, trained, nodes in _forests(_stored_health(spark, folder)):
        found = forest.importances(nodes, list(trained.features)).withColumnRenamed("importance", "summed")
        part = trained.importance.join(found, "feature").select("model", "feature", F.abs(F.col("importance") - F.col("summed")).alias("off"))
        out = part if out is None else out.unionByName(part)
    return _round(out)


@query
def pattern_certificate(spark, folder):
    """Machines of all clusters, and the proof that the clustering is stationary."""
    rows = _fleet(spark, folder)
    found = ml.pattern_certificate(rows, ml.train_failure_patterns(rows))
    return _round(found.agg(F.sum("machines").alias("machines"), F.sum("nearest").alias("nearest"), F.max("off_centre").alias("off_centre")))


# ---------------------------------------------------------------- windowed telemetry

@query
def telemetry_tumbling(spark, folder):
    rolled = windows.telemetry_windows(_logs(spark, folder).telemetry, "1 day")
    return _round(rolled.select("machineID", _text_time("window_start"), "volt_mean", "pressure_mean",
                                "vibration_mean", "vibration_std", "rotate_std", "readings"))


@query
def telemetry_sliding(spark, folder):
    rolled = windows.telemetry_windows(_logs(spark, folder).telemetry, "14 days", "7 days")
    return _round(rolled.select("machineID", _text_time("window_start"), "rotate_mean", "pressure_std", "readings"))


@query
def error_windows(spark, folder):
    logs = _logs(spark, folder)
    return windows.event_windows(logs.errors, logs.maint).select(
        "machineID", _text_time("window_start"), "error_count", "maint_count")


@query
def error_sessions(spark, folder):
    return windows.error_sessions(_logs(spark, folder).errors).select(
        "machineID", _text_time("window_start"), _text_time("window_end"), "errors")
