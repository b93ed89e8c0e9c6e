"""Fleet overview: KPIs, distributions, rankings and machine look-ups."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from millwatch.functions import risk
from millwatch.functions.health import model_label
from millwatch.functions.numeric import half_even
from millwatch.operators.quantiles import exact_quantiles

LEVELS = {"critical": risk.CRITIQUE, "high": risk.ELEVE, "moderate": risk.MODERE, "low": risk.FAIBLE}
HEATMAP_METRICS = ("global_health_score", "vibration", "error_count")


def fleet_kpis(df: DataFrame, critical_below: float = 30, high_risk_below: float = 40) -> DataFrame:
    """One row of key figures; ``df`` has one row per machine."""
    health = F.col("global_health_score")
    survival = F.avg("survival_at_30") if "survival_at_30" in df.columns else F.lit(None).cast("double")
    return df.agg(
        F.count("machineID").alias("machines"), F.avg(health).alias("avg_health"),
        F.count_if((health < critical_below) & F.col("machineID").isNotNull()).alias("critical_machines"),
        F.count_if(health < high_risk_below).alias("high_risk_machines"),
        (F.avg("event") * 100).alias("failure_rate"), survival.alias("avg_survival_30"))


def health_range(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("global_health_score").between(low, high))


def health_range_stats(df: DataFrame, low: float, high: float) -> DataFrame:
    health = F.col("global_health_score")
    inside = F.when(health.between(low, high), health)
    return df.agg(F.count(inside).alias("machines"), F.count(F.lit(1)).alias("fleet"),
                  F.avg(inside).alias("mean"), F.stddev_samp(inside).alias("std"),
                  F.min(inside).alias("min"), F.max(inside).alias("max"))


def health_histogram(df: DataFrame, group: str | None = None, bins: int = 15) -> DataFrame:
    """Machines per equal-width bin of 0..100; a score of 100 belongs to the last bin."""
    health = F.col("global_health_score")
    bin_ = F.least(F.expr(f"width_bucket(global_health_score, 0D, 100D, {bins})"), F.lit(bins)).cast("int")
    keys = [F.col(group).alias("group")] if group else []
    width = 100.0 / bins
    counted = df.where(health.isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("machines"))
    return counted.withColumns({"low": (F.col("bin") - 1) * width, "high": F.col("bin") * width})


def health_quartiles(df: DataFrame, group: str) -> DataFrame:
    """Five-number summary of health per group, with exact quartiles."""
    health = "global_health_score"
    spread = df.groupBy(group).agg(F.count(health).alias("machines"), F.min(health).alias("min"),
                                   F.max(health).alias("max"))
    quartiles = exact_quantiles(df, [health], (0.25, 0.5, 0.75), by=[group]).groupBy(group).agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    renamed = quartiles.withColumnRenamed(group, "_group")
    return spread.join(renamed, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col(group).alias("group"), "machines", "min", "q25", "q50", "q75", "max")


def health_by_grouping_sets(df: DataFrame, columns: Sequence[str] = ("model_label", "risk_level", "model")) -> DataFrame:
    """Health statistics for the whole fleet and by each of ``columns``, in one aggregation."""
    grouped = df.groupingSets([[F.col(c)] for c in columns] + [[]], *[F.col(c) for c in columns])
    stats = grouped.agg(
        F.grouping_id(*columns).alias("_set"), F.count(F.lit(1)).alias("machines"),
        F.avg("global_health_score").alias("mean"), F.min("global_health_score").alias("min"),
        F.max("global_health_score").alias("max"))
    everything = 2 ** len(columns) - 1
    dimension, value = F.lit("fleet"), F.lit(None).cast("string")
    for position, column in enumerate(columns):
        own = F.col("_set") == everything - 2 ** (len(columns) - 1 - position)
        dimension = F.when(own, column).otherwise(dimension)
        value = F.when(own, F.col(column)).otherwise(value)
    return stats.select(dimension.alias("dimension"), value.alias("value"), "machines", "mean", "min", "max")


def risk_distribution(df: DataFrame, column: str = "risk_level", others: Mapping[str, str] | None = None) -> DataFrame:
    """Machines by level; ``others`` names further columns of levels, whose levels are counted within each as ``<name>_<level>``."""
    counts = [F.count_if(F.col(other) == level).alias(f"{name}_{short}") for other, name in (others or {}).items() for short, level in LEVELS.items()]
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("machines"), *counts)


def risk_heatmap(df: DataFrame, group: str = "model_label") -> DataFrame:
    """Mean health, vibration and errors per group, two decimals."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[
        half_even(F.avg(m), 2).alias(m) for m in HEATMAP_METRICS])


def risk_heatmap_long(df: DataFrame, group: str = "model") -> DataFrame:
    """The heat map with one row per metric and group value."""
    return risk_heatmap(df, group).select(group, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in HEATMAP_METRICS])).alias("e")).select(group, "e.*")


def risk_heatmap_transposed(df: DataFrame, group: str = "model", values: Sequence[str] | None = None) -> DataFrame:
    """The heat map with one row per metric and one column per group value, all of them unless named."""
    return risk_heatmap_long(df, group).groupBy("metric").pivot(group, list(values) if values else None).agg(F.max("value"))


def machine_lookup(df: DataFrame, machine_ids: DataFrame | Iterable[int]) -> DataFrame:
    """Rows of the requested machines; a table of ids becomes a semi join."""
    if isinstance(machine_ids, DataFrame):
        return df.join(machine_ids.select("machineID"), "machineID", "left_semi")
    return df.where(F.col("machineID").isin(*machine_ids))


def machine_metrics(df: DataFrame) -> DataFrame:
    """Mean technical metrics per machine; absent optional columns read 0."""
    def mean(column):
        return F.avg(column) if column in df.columns else F.lit(0.0)
    return df.groupBy("machineID").agg(mean("vibration").alias("vibration"), mean("pressure").alias("pressure"),
                                       mean("error_count").alias("errors"), mean("rotate").alias("rotation"))


def machine_ids(df: DataFrame) -> DataFrame:
    return df.select("machineID").distinct()


def distinct_models(df: DataFrame) -> DataFrame:
    return df.select("model").distinct()


DETAIL_COLUMNS = ("machineID", "model", "model_label", "global_health_score", "risk_level", "vibration", "error_count")


def machine_detail(df: DataFrame) -> DataFrame:
    columns = [c for c in DETAIL_COLUMNS if c in df.columns]
    return df.select(*columns).orderBy(F.desc("global_health_score"), "machineID")


def alert_center(df: DataFrame, threshold: float = 40) -> DataFrame:
    health = F.col("global_health_score")
    return df.where(health <= threshold).select(
        "machineID", "model", health, "vibration", "error_count",
        risk.attention_action(health).alias("action")).orderBy(health, "machineID")


def lowest_health(df: DataFrame, count: int = 5) -> DataFrame:
    return df.where(F.col("global_health_score").isNotNull()).orderBy("global_health_score", "machineID").limit(count)


def recent_alerts(df: DataFrame, below: float = 40, count: int = 10, probability: str | None = None,
                  rul: str | None = None) -> DataFrame:
    """First machines under the health limit, as display rows."""
    health = F.col("global_health_score")
    shown = df.where(health < below).orderBy("machineID").limit(count)

    def text(column, digits):
        return F.format_string(f"%.{digits}f", half_even(F.col(column), digits)) if column else F.lit("N/A")

    return shown.select(
        F.concat(F.lit("Machine "), F.col("machineID").cast("string")).alias("machine"),
        F.format_string("%s (Label: %s)", "model", model_label(F.col("model"))).alias("model"),
        F.format_string("%.1f", half_even(health, 1)).alias("health"),
        risk.recent_alert_risk(health).alias("risk"), text(probability, 2).alias("failure_probability"),
        text(rul, 1).alias("predicted_rul"), risk.recent_alert_action(health).alias("action"))


def fleet_risk(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """Machines at the two highest levels, one row each: the list next to ``risk_distribution``."""
    return df.where(F.col(level).isin(risk.CRITIQUE, risk.ELEVE)).select("machineID", F.col(level).alias("risk_level"))


def health_trend(history: DataFrame, time: str = "timestamp") -> DataFrame:
    """Health of each machine over time, for tables that carry a time stamp."""
    if time not in history.columns:
        raise ValueError(f"no {time!r} column: a trend needs a time-stamped history")
    return history.select("machineID", time, "global_health_score").orderBy("machineID", time)
