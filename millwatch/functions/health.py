"""Component and global health expressions."""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, functions as F

from millwatch import config
from millwatch.functions.numeric import clip, half_even, ratio_or_zero

# Which raw reading each component score is derived from, and how.
# 35 mm/s and 100 bar are the nominal vibration and pressure.
COMPONENTS: Mapping[str, tuple[str, object]] = {
    "vibration": ("vibration", lambda c: clip(100 - (c - 35) * 2, 0, None, c)),
    "pressure": ("pressure", lambda c: clip(100 - F.abs(c - 100) * 2, 0, None, c)),
    "error": ("error_count", lambda c: clip(100 - c * 2, 0, None, c)),
    "maintenance": ("maint_count", lambda c: clip(c * 3, None, 100, c)),
    "age": ("age", lambda c: clip(100 - c * 5, 0, None, c)),
}


def component_scores(columns: Iterable[str]) -> dict[str, Column]:
    """Score expressions for the components whose reading exists in ``columns``."""
    present = set(columns)
    return {
        f"{name}_score": formula(F.col(reading).cast("double"))
        for name, (reading, formula) in COMPONENTS.items() if reading in present
    }


def global_health(columns: Iterable[str],
                  weights: Mapping[str, float] = config.HEALTH_WEIGHTS,
                  digits: int | None = 2) -> Column:
    """Weighted sum of the present component scores, clipped to 0..100; NULL if a score is."""
    present = set(columns)
    parts = [name for name in weights if f"{name}_score" in present]
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(f"{name}_score") * F.lit(float(weights[name]))
    sources = [COMPONENTS[n][0] if n in COMPONENTS and COMPONENTS[n][0] in present else f"{n}_score" for n in parts]
    score = clip(total, 0, 100, *[F.col(c) for c in sources])
    return score if digits is None else half_even(score, digits)


def degradation_rate(columns: Iterable[str], digits: int | None = 4) -> Column:
    if not {"vibration", "age"} <= set(columns):
        return F.lit(0.0)
    rate = F.try_divide(F.col("vibration"), F.col("age") + 1)
    return rate if digits is None else half_even(rate, digits)


def risk_factor(columns: Iterable[str]) -> Column:
    if not {"global_health_score", "degradation_rate"} <= set(columns):
        return F.lit(0.0)
    return half_even((100 - F.col("global_health_score")) * F.col("degradation_rate"), 2)


def interaction_ratios(columns: Iterable[str]) -> dict[str, Column]:
    present = set(columns)
    ratios = {}
    if {"vibration", "pressure"} <= present:
        ratios["vibration_pressure_ratio"] = ratio_or_zero(F.col("vibration"), F.col("pressure"))
    if {"error_count", "maint_count"} <= present:
        ratios["error_maintenance_ratio"] = half_even(
            F.try_divide(F.col("error_count"), F.col("maint_count") + 1), 2)
    return ratios


def model_label(model: Column) -> Column:
    labels = F.create_map(*[F.lit(v) for pair in config.MODEL_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(labels, F.lower(model)), F.lit(config.DEFAULT_MODEL_LABEL))
