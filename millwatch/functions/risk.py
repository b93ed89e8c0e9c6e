"""Risk classes, escalation by survival probability, and health bands."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, functions as F

from millwatch.config import CRITIQUE, ELEVE, ESCALATION, FAIBLE, MODERE, RISK
from millwatch.config import EscalationRule, RiskThresholds


def risk_level(columns: Iterable[str], limits: RiskThresholds = RISK) -> Column:
    """Ordered rules; a missing reading never triggers a rule, an absent column has a neutral value."""
    present = set(columns)
    health = F.col("global_health_score") if "global_health_score" in present else F.lit(50.0)
    vibration = F.col("vibration") if "vibration" in present else F.lit(0.0)
    errors = F.col("error_count") if "error_count" in present else F.lit(0)

    def crossed(min_health, max_vibration, max_errors):
        return (health < min_health) | (vibration > max_vibration) | (errors > max_errors)

    return (
        F.when(crossed(limits.critical_health, limits.critical_vibration, limits.critical_errors), CRITIQUE)
        .when(crossed(limits.high_health, limits.high_vibration, limits.high_errors), ELEVE)
        .when(health < limits.moderate_health, MODERE)
        .otherwise(FAIBLE)
    )


def escalated_risk(level: Column, survival_30: Column, rule: EscalationRule = ESCALATION) -> Column:
    return (
        F.when(survival_30 < rule.to_critical, CRITIQUE)
        .when((survival_30 < rule.to_high) & ~level.isin(CRITIQUE, ELEVE), ELEVE)
        .otherwise(level)
    )


def risk_from_health(health: Column, limits: RiskThresholds = RISK) -> Column:
    """Fallback class when no trained classifier is available."""
    return (
        F.when(health < limits.critical_health, CRITIQUE)
        .when(health < limits.high_health, ELEVE)
        .when(health < limits.moderate_health, MODERE)
        .otherwise(FAIBLE)
    )


# Band limits and labels of the fleet overview.

def health_band(health: Column) -> Column:
    return (F.when(health < 30, "Critique").when(health < 60, "Élevé")
            .when(health < 80, "Modéré").otherwise("Faible"))


def health_band_right_closed(health: Column) -> Column:
    """Bands (0,30], (30,60], (60,80], (80,100]; anything else has no band."""
    inside = (health > 0) & (health <= 100)
    return F.when(inside, F.when(health <= 30, "Critique").when(health <= 60, "Élevé")
                  .when(health <= 80, "Modéré").otherwise("Faible"))


def attention_action(health: Column) -> Column:
    return (F.when(health < 30, "ARRÊT IMMÉDIAT").when(health < 50, "MAINTENANCE URGENTE")
            .otherwise("SURVEILLANCE"))


def recent_alert_risk(health: Column) -> Column:
    return F.when(health < 30, "Critique").otherwise("Élevé")


def recent_alert_action(health: Column) -> Column:
    return F.when(health < 30, "Maintenance Immédiate").otherwise("Planifier")
