"""Costs, savings and return on investment per machine, per model and for the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.config import BASSE, ECONOMICS, Economics, HAUTE, MOYENNE
from millwatch.functions.numeric import half_even


def downtime_hours(model: Column, rules: Economics = ECONOMICS) -> Column:
    default = F.lit(float(rules.default_downtime_hours))
    if not rules.downtime_hours:
        return default
    hours = F.create_map(*[F.lit(v) for pair in rules.downtime_hours.items() for v in pair])
    return F.coalesce(F.try_element_at(hours, model), default)


def unplanned_cost(model: Column, rules: Economics = ECONOMICS) -> Column:
    return downtime_hours(model, rules) * rules.hourly_downtime_cost + rules.emergency_repair_cost


def potential_savings(model: Column, rules: Economics = ECONOMICS) -> Column:
    return F.greatest(F.lit(0.0), unplanned_cost(model, rules) - rules.planned_maintenance_cost)


def machine_economics(df: DataFrame, rules: Economics = ECONOMICS) -> DataFrame:
    """Cost profile and maintenance priority of every machine."""
    unplanned, savings = F.col("_unplanned"), F.col("_savings")
    priced = df.withColumns({
        "_unplanned": unplanned_cost(F.col("model"), rules), "_savings": potential_savings(F.col("model"), rules)})
    return priced.select(
        "machineID", "model",
        half_even(unplanned, 2).alias("cost_unplanned_downtime"),
        F.lit(rules.planned_maintenance_cost).alias("cost_planned_maintenance"),
        half_even(savings, 2).alias("potential_savings"),
        half_even(F.when(unplanned > 0, savings / unplanned * 100).otherwise(0.0), 1).alias("savings_percent"),
        half_even(F.col("global_health_score"), 1).alias("health_score"),
        F.when(savings > rules.high_priority_above, HAUTE)
        .when(savings > rules.medium_priority_above, MOYENNE).otherwise(BASSE).alias("priority"))


def _valued_models(df: DataFrame, rules: Economics) -> DataFrame:
    sized = df.groupBy("model").agg(F.count(F.lit(1)).alias("machines"))
    annual, invested = F.col("_annual"), float(rules.investment_per_machine)
    valued = sized.withColumn("_annual", potential_savings(F.col("model"), rules) * rules.failures_per_year)
    roi = (annual - invested) / invested * 100 if invested > 0 else F.lit(0.0)
    payback = F.when(annual > 0, 12.0 * invested / annual).otherwise(12.0)
    return valued.select(
        "model", "machines", half_even(annual, 2).alias("annual_savings"),
        F.lit(round(invested, 2)).alias("annual_investment"),
        half_even(annual - invested, 2).alias("annual_net_benefit"),
        half_even(roi, 1).alias("roi_percent"), half_even(payback, 1).alias("payback_months"))


def roi_by_model(df: DataFrame, rules: Economics = ECONOMICS) -> DataFrame:
    """Annual return per machine of each known model, with the number of machines."""
    return _valued_models(df, rules).where(F.col("model").isNotNull())


def fleet_economics(df: DataFrame, rules: Economics = ECONOMICS) -> DataFrame:
    """One row of fleet totals; savings add up the rounded per-machine figures of each model.

    Machines without a model count in the fleet size only.
    """
    priced = F.when(F.col("model").isNotNull(), F.col("machines")).otherwise(0)
    totals = _valued_models(df, rules).agg(
        F.coalesce(F.sum(F.col("annual_savings") * priced), F.lit(0.0)).alias("savings"),
        F.coalesce(F.sum(F.col("annual_investment") * priced), F.lit(0.0)).alias("investment"),
        F.coalesce(F.sum("machines"), F.lit(0)).alias("fleet_size"))
    net = F.col("savings") - F.col("investment")
    return totals.select(
        half_even(F.col("savings"), 2).alias("total_fleet_savings"),
        half_even(F.col("investment"), 2).alias("total_ml_investment"),
        half_even(net, 2).alias("total_net_benefit"),
        half_even(F.when(F.col("investment") > 0, net / F.col("investment") * 100).otherwise(0.0), 1)
        .alias("total_roi_percent"),
        "fleet_size")
