"""End-to-end jobs: survival table, enriched fleet, training and daily alerts."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from millwatch.operators import alerts as alerting, etl, features, ml
from millwatch.operators.economics import fleet_economics
from millwatch.operators.quality import require_columns
from millwatch.operators.reports import decision_pack, decision_pack_lines, executive_report, maintenance_report
from millwatch.session import configure, materialise
from millwatch.sources import sinks
from millwatch.sources.readers import RawLogs, read_survival_table

log = logging.getLogger(__name__)


def fleet_table(logs: RawLogs) -> DataFrame:
    """Survival table written once, so that everything after it reads machines instead of raw logs."""
    return materialise(etl.survival_table(logs), "survival")


def load_and_prepare(spark: SparkSession, path: str) -> DataFrame:
    """Load a survival table, reject it when columns are missing, and enrich it."""
    configure(spark)
    return features.enrich(materialise(require_columns(read_survival_table(spark, path)), "survival"))


def train_job(spark: SparkSession, source: str, target: str, classifier_grid: dict | None = None,
              regressor_grid: dict | None = None) -> dict[str, ml.Trained]:
    """Train both models and save them with their report; one failing model does not stop the other."""
    fleet = materialise(load_and_prepare(spark, source), "enriched")
    trained: dict[str, ml.Trained] = {}
    for name, train, grid in (("classifier", ml.train_classifier, classifier_grid),
                              ("regressor", ml.train_regressor, regressor_grid)):
        try:
            trained[name] = train(fleet, grid=grid)
        except Exception:
            log.exception("training the %s failed", name)
    sinks.save_models({name: t.model for name, t in trained.items()}, target)
    if trained:
        sinks.write_metrics(ml.performance_summary(list(trained.values())), f"{target.rstrip('/')}/training_report")
    return trained


def alert_job(spark: SparkSession, source: str, target: str, as_of: datetime, models: str | None = None) -> DataFrame:
    """Score the fleet, put the alerts into the history and write the text reports."""
    configure(spark)
    fleet = materialise(features.health_features(require_columns(read_survival_table(spark, source))), "fleet")
    loaded = sinks.load_models(spark, ("classifier", "regressor"), models) if models else {}
    scored = ml.score_fleet(fleet, loaded.get("classifier"), loaded.get("regressor"))
    rows = materialise(alerting.alerts(
        scored, as_of, predicted_probability="pred_proba" if "classifier" in loaded else None,
        predicted_rul="pred_rul" if "regressor" in loaded else None), "alerts")
    target = target.rstrip("/")
    if rows.isEmpty():
        alerting.clear_day(spark, f"{target}/alert_history", str(as_of)[:10])
    else:
        alerting.append_history(rows, f"{target}/alert_history")
    economics = materialise(fleet_economics(fleet), "economics")
    sinks.write_lines(executive_report(fleet, economics, rows, as_of), f"{target}/executive_report")
    sinks.write_lines(maintenance_report(rows, as_of), f"{target}/maintenance_report")
    pack = decision_pack(scored, economics, "pred_proba" if "classifier" in loaded else None)
    sinks.write_lines(decision_pack_lines(pack, as_of), f"{target}/decision_pack")
    return rows
