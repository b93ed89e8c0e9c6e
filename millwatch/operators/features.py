"""Health, risk and survival features of the fleet table."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, functions as F

from millwatch import config
from millwatch.functions import health, risk
from millwatch.operators.prep import fill_median
from millwatch.operators.survival import add_survival_at_horizons, add_survival_at_time, km_curve
from millwatch.session import materialise


def add_component_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(health.component_scores(df.columns))


def add_global_health(df: DataFrame, weights: Mapping[str, float] = config.HEALTH_WEIGHTS,
                      digits: int | None = 2) -> DataFrame:
    return df.withColumn("global_health_score", health.global_health(df.columns, weights, digits))


def add_degradation(df: DataFrame, digits: int | None = 4) -> DataFrame:
    return df.withColumn("degradation_rate", health.degradation_rate(df.columns, digits))


def add_risk_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_factor", health.risk_factor(df.columns))


def add_interactions(df: DataFrame) -> DataFrame:
    ratios = health.interaction_ratios(df.columns)
    return df.withColumns(ratios) if ratios else df


def add_risk_level(df: DataFrame, limits: config.RiskThresholds = config.RISK) -> DataFrame:
    return df.withColumn("risk_level", risk.risk_level(df.columns, limits))


def add_model_label(df: DataFrame) -> DataFrame:
    return df.withColumn("model_label", health.model_label(F.col("model")))


def health_features(df: DataFrame, fill: bool = True) -> DataFrame:
    """Row-wise features. The only step that looks beyond the row is the median fill."""
    if fill:
        df = fill_median(df)
    for step in (add_component_scores, add_global_health, add_degradation, add_risk_factor,
                 add_interactions, add_risk_level, add_model_label):
        df = step(df)
    return df


def raw_health_features(df: DataFrame) -> DataFrame:
    """Unrounded variant used by the per-machine analysis: scores, health and degradation only."""
    df = add_global_health(add_component_scores(df), digits=None)
    return add_degradation(df, digits=None)


def add_combined_risk(df: DataFrame, rule: config.EscalationRule = config.ESCALATION) -> DataFrame:
    return df.withColumn("combined_risk", risk.escalated_risk(
        F.col("risk_level"), F.col("survival_at_30"), rule))


def enrich(df: DataFrame, curve: DataFrame | None = None) -> DataFrame:
    """All features of the fleet table, including survival probabilities of the machine's model.

    ``df`` is read several times (features, curves); pass a materialised table. ``curve``
    is the Kaplan-Meier curve by model where the caller already has it.
    """
    if curve is None:
        curve = materialise(km_curve(df), "curve")
    featured = add_survival_at_horizons(health_features(df), curve)
    return add_combined_risk(add_survival_at_time(featured, curve))
