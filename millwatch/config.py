"""Business rules of the engine as immutable settings.

Every operator takes the settings it needs as an argument whose default is the
matching constant below, so a caller overrides a rule with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# Column names, labels and thresholds that define the results.

SURVIVAL_COLUMNS = (
    "machineID", "model", "age", "time", "event",
    "volt", "rotate", "pressure", "vibration",
    "error_count", "maint_count",
)

SENSORS = ("volt", "rotate", "pressure", "vibration")

MEDIAN_FILLED = ("vibration", "pressure", "volt", "rotate", "error_count")

COMPONENT_SCORES = (
    "vibration_score", "pressure_score", "error_score", "maintenance_score", "age_score",
)

SCORING_FEATURES = ("global_health_score", "vibration", "error_count", "degradation_rate")
EXTRA_FEATURES = ("pressure", "volt", "rotate", "age", "maint_count", "risk_factor")
CLUSTER_FEATURES = ("vibration", "pressure", "error_count")

HEALTH_WEIGHTS: Mapping[str, float] = MappingProxyType({
    "vibration": 0.30, "pressure": 0.25, "error": 0.20, "maintenance": 0.15, "age": 0.10,
})

CRITIQUE, ELEVE, MODERE, FAIBLE = "CRITIQUE", "ÉLEVÉ", "MODÉRÉ", "FAIBLE"
HAUTE, MOYENNE, BASSE = "HAUTE", "MOYENNE", "BASSE"

HORIZONS = (30, 90, 180)

MODEL_LABELS: Mapping[str, str] = MappingProxyType({
    "model1": "B", "model2": "A", "model3": "C", "model4": "C",
})
DEFAULT_MODEL_LABEL = "C"


@dataclass(frozen=True)
class RiskThresholds:
    """A machine reaches a level when any one of the level's limits is crossed."""

    critical_health: float = 30
    critical_vibration: float = 45
    critical_errors: float = 40
    high_health: float = 50
    high_vibration: float = 40
    high_errors: float = 30
    moderate_health: float = 70


@dataclass(frozen=True)
class EscalationRule:
    """Survival probabilities at 30 days under which the heuristic level is raised."""

    to_critical: float = 0.3
    to_high: float = 0.6


@dataclass(frozen=True)
class AlertLevel:
    name: str
    max_rul_days: float
    action: str
    priority: int


@dataclass(frozen=True)
class AlertRules:
    # Levels, factor weights and escalation limits.
    levels: tuple[AlertLevel, ...] = (
        AlertLevel("CRITIQUE", 7, "IMMÉDIAT", 0),
        AlertLevel("HAUTE", 14, "CETTE_SEMAINE", 1),
        AlertLevel("MOYENNE", 30, "CE_MOIS", 2),
        AlertLevel("BASSE", 365, "SURVEILLANCE", 3),
    )
    lead_time_days: float = 2.0
    health_weight: float = 0.4
    degradation_weight: float = 0.3
    age_weight: float = 0.2
    error_weight: float = 0.1
    degradation_scale: float = 10
    age_scale: float = 20
    error_scale: float = 50
    critical_above: float = 0.8
    high_above: float = 0.6
    medium_above: float = 0.4


@dataclass(frozen=True)
class Economics:
    # Costs in euros, hours of downtime by machine model.
    hourly_downtime_cost: float = 500.0
    planned_maintenance_cost: float = 200.0
    emergency_repair_cost: float = 1500.0
    investment_per_machine: float = 100.0
    failures_per_year: float = 2.0
    downtime_hours: Mapping[str, float] = field(default_factory=lambda: MappingProxyType(
        {"model1": 4.0, "model2": 6.0, "model3": 5.0, "model4": 3.5}))
    default_downtime_hours: float = 5.0
    high_priority_above: float = 2000
    medium_priority_above: float = 1000


@dataclass(frozen=True)
class AnomalyLimits:
    max_vibration: float = 45
    min_pressure: float = 95
    max_pressure: float = 105
    max_errors: float = 40


@dataclass(frozen=True)
class Training:
    seed: int = 42
    test_fraction: float = 0.2
    trees: int = 100
    risk_trees: int = 50
    folds: int = 5
    max_clusters: int = 3


RISK = RiskThresholds()
ESCALATION = EscalationRule()
ALERTS = AlertRules()
ECONOMICS = Economics()
ANOMALIES = AnomalyLimits()
TRAINING = Training()
