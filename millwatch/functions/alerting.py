"""Alert scoring as pure column expressions, usable on batch and streaming DataFrames."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, functions as F

from millwatch.config import ALERTS, AlertRules, BASSE, CRITIQUE, HAUTE, MOYENNE


def _reading(columns: Iterable[str], name: str, default: float) -> Column:
    return F.col(name).cast("double") if name in set(columns) else F.lit(float(default))


def _capped(value: Column) -> Column:
    """min(1, value), where an unknown value counts as the worst case."""
    return F.least(F.lit(1.0), F.coalesce(value, F.lit(1.0)))


def risk_factors(columns: Iterable[str], rules: AlertRules = ALERTS) -> dict[str, Column]:
    columns = list(columns)
    health = _reading(columns, "global_health_score", 50)
    degradation = _reading(columns, "degradation_rate", 0)
    age = _reading(columns, "age", 0)
    errors = _reading(columns, "error_count", 0)
    return {
        "health_risk": F.greatest(F.lit(0.0), _capped((100 - health) / 100)),
        "degradation_risk": _capped(degradation / rules.degradation_scale),
        "age_risk": _capped(age / rules.age_scale),
        "error_risk": _capped(errors / rules.error_scale),
    }


def total_risk(factors: dict[str, Column], rules: AlertRules = ALERTS) -> Column:
    weighted = (
        factors["health_risk"] * rules.health_weight
        + factors["degradation_risk"] * rules.degradation_weight
        + factors["age_risk"] * rules.age_weight
        + factors["error_risk"] * rules.error_weight
    )
    return F.least(F.lit(1.0), weighted)


def failure_probability(columns: Iterable[str]) -> Column:
    """Heuristic probability from the health score; unknown health counts as certain failure."""
    health = _reading(columns, "global_health_score", 50)
    return F.greatest(F.lit(0.0), _capped((100 - health) / 100))


def remaining_life(columns: Iterable[str], predicted: str | None = None) -> Column:
    """Remaining useful life in days: a regressor's output (at least 1), else the row's ``time``."""
    if predicted is not None:
        return F.greatest(F.lit(1.0), F.col(predicted))
    return _reading(columns, "time", 30)


def base_level(rul: Column, rules: AlertRules = ALERTS) -> Column:
    rule = None
    for level in rules.levels[:-1]:
        reached = rul <= level.max_rul_days
        rule = F.when(reached, level.name) if rule is None else rule.when(reached, level.name)
    return rule.otherwise(rules.levels[-1].name)


def alert_level(rul: Column, probability: Column, risk: Column, rules: AlertRules = ALERTS) -> Column:
    base = base_level(rul, rules)
    urgent = (probability > rules.high_above) | (risk > rules.high_above)
    return (
        F.when((probability > rules.critical_above) | (risk > rules.critical_above), CRITIQUE)
        .when(urgent & base.isin(BASSE, MOYENNE), HAUTE)
        .when(~urgent & (probability > rules.medium_above) & (base == BASSE), MOYENNE)
        .otherwise(base)
    )


def raises_alert(rul: Column, probability: Column, risk: Column, rules: AlertRules = ALERTS) -> Column:
    """True where ``alert_level`` is above the lowest level, as one flat predicate.

    Filtering on the level itself would copy the whole rule tree below every projection
    the optimiser pushes the filter through.
    """
    urgent = min(rules.critical_above, rules.high_above)
    return ((rul <= max(level.max_rul_days for level in rules.levels[:-1])) | (risk > urgent)
            | (probability > min(rules.medium_above, urgent)))


def level_attribute(level: Column, attribute: str, rules: AlertRules = ALERTS) -> Column:
    """Attribute of an alert level (``action``, ``priority``, ...) from the rules."""
    pairs = [F.lit(v) for entry in rules.levels for v in (entry.name, getattr(entry, attribute))]
    return F.try_element_at(F.create_map(*pairs), level)
