"""Alert generation, the maintenance calendar and alert statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millwatch.config import ALERTS, AlertRules, CRITIQUE
from millwatch.functions import alerting
from millwatch.functions.numeric import MICROS_PER_DAY, half_even
from millwatch.operators.scan import SUM, running


def _scored(df: DataFrame, rules: AlertRules, predicted_probability: str | None,
            predicted_rul: str | None) -> DataFrame:
    factors = alerting.risk_factors(df.columns, rules)
    probability = F.col(predicted_probability) if predicted_probability else alerting.failure_probability(df.columns)
    named = df.withColumns({"rul": alerting.remaining_life(df.columns, predicted_rul),
                            "probability": probability, **factors})
    scored = named.withColumn("total_risk", alerting.total_risk({name: F.col(name) for name in factors}, rules))
    known = F.col("rul").isNotNull() & F.col("machineID").isNotNull()
    if "age" in df.columns:
        known = known & F.col("age").isNotNull()
    return scored.where(known)


def _levelled(scored: DataFrame, rules: AlertRules) -> DataFrame:
    return scored.withColumns({
        "base_level": alerting.base_level(F.col("rul"), rules),
        "alert_level": alerting.alert_level(F.col("rul"), F.col("probability"), F.col("total_risk"), rules)})


def score_risk(df: DataFrame, rules: AlertRules = ALERTS, predicted_probability: str | None = None,
               predicted_rul: str | None = None) -> DataFrame:
    """Add ``rul``, ``probability``, the four risk factors, ``total_risk`` and the alert levels.

    Row-wise, so the same projection serves batch tables and streams. Rows without an id,
    an age or a remaining life cannot be scored and are left out.
    """
    return _levelled(_scored(df, rules, predicted_probability, predicted_rul), rules)


def deadline(rul: Column, as_of: Column, rules: AlertRules = ALERTS) -> Column:
    """Calendar day ``as_of`` + remaining life - lead time, as ``yyyy-MM-dd``."""
    shift = F.floor((rul - rules.lead_time_days) * F.lit(float(MICROS_PER_DAY)))
    return F.date_format(F.timestamp_micros(F.unix_micros(as_of) + shift), "yyyy-MM-dd")


def alerts(df: DataFrame, as_of: datetime | str, rules: AlertRules = ALERTS,
           predicted_probability: str | None = None, predicted_rul: str | None = None) -> DataFrame:
    """Alerts of every machine above the lowest level (unordered; see ``ranked``).

    Pass stored health features: the filter on the risk is pushed to the source, and over
    features that are still expressions it would repeat them in one oversized method.
    """
    moment = F.lit(str(as_of)).cast("timestamp")
    scored = _scored(df, rules, predicted_probability, predicted_rul)
    raised = scored.where(alerting.raises_alert(F.col("rul"), F.col("probability"), F.col("total_risk"), rules))
    level = F.col("alert_level")
    columns = set(df.columns)
    return _levelled(raised, rules).select(
        F.col("machineID").cast("long").alias("machine_id"),
        (F.coalesce(F.col("model"), F.lit("Unknown")) if "model" in columns else F.lit("Unknown")).alias("model"),
        level, half_even(F.col("rul"), 1).alias("rul_days"),
        half_even(F.col("probability"), 3).alias("prob_failure"),
        half_even(F.col("total_risk"), 3).alias("risk_score"),
        alerting.level_attribute(level, "action", rules).alias("recommended_action"),
        deadline(F.col("rul"), moment, rules).alias("maintenance_deadline"),
        alerting.level_attribute(level, "priority", rules).alias("priority"),
        half_even(F.col("global_health_score") if "global_health_score" in columns else F.lit(50.0), 1)
        .alias("health_score"),
        (F.col("age") if "age" in columns else F.lit(0)).cast("int").alias("age"),
        moment.alias("timestamp"))


def ranked(alert_rows: DataFrame) -> DataFrame:
    """Alerts in the order they are reported: severity, then probability, then machine."""
    return alert_rows.orderBy("priority", F.desc("prob_failure"), "machine_id")


def append_history(alert_rows: DataFrame, path: str, **keys: int) -> None:
    """Add a run's alerts to the history table; a day that is run again replaces its own alerts and no others.

    The table is partitioned by the day of the run, and below it by ``keys`` such as a batch number. Only partitions
    that receive rows are overwritten; a day whose second run raises no alert at all is cleared with ``clear_day``.
    """
    keyed = alert_rows.withColumn("as_of_date", F.to_date("timestamp")).withColumns({k: F.lit(v) for k, v in keys.items()})
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("as_of_date", *keys).parquet(path))


def clear_day(spark: SparkSession, path: str, day: str) -> bool:
    """Take the alerts of one day (``YYYY-MM-DD``) out of the history; False when it holds none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/as_of_date={day}")
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def scheduled(alert_rows: DataFrame, weeks_ahead: int = 4, rules: AlertRules = ALERTS) -> DataFrame:
    """Alerts that fall due within the horizon, with ``days_until`` and the week number."""
    days = F.col("rul_days") - rules.lead_time_days
    week = F.least(F.lit(weeks_ahead - 1), F.floor(F.col("days_until") / 7)) + 1
    return (alert_rows.withColumn("days_until", days)
            .where((F.col("days_until") > 0) & (F.col("days_until") <= weeks_ahead * 7))
            .withColumn("week", week.cast("int")))


def overdue(alert_rows: DataFrame, rules: AlertRules = ALERTS) -> DataFrame:
    """Alerts whose deadline has passed; the calendar leaves them out."""
    return alert_rows.where(F.col("rul_days") - rules.lead_time_days <= 0)


def maintenance_calendar(alert_rows: DataFrame, weeks_ahead: int = 4, rules: AlertRules = ALERTS) -> DataFrame:
    """Scheduled alerts with their position inside the week; an empty week is one row without machine.

    The position is a running count along (priority, probability), then blocks of machine ids, so a
    week that holds most of the fleet is ranked in parallel. ``alert_rows`` is read several times; pass a
    materialised table.
    """
    due = scheduled(alert_rows, weeks_ahead, rules)
    counted = due.withColumns({
        "_rank": -F.col("prob_failure"), "_block": F.shiftright("machine_id", 16), "_one": F.lit(1).cast("long")})
    path = [["priority", "_rank"], ["_block"], ["machine_id"]]
    placed = running(counted, ["week"], path, {"position": ("_one", SUM)}).drop("_rank", "_block", "_one")
    return placed.unionByName(_empty_weeks(due, weeks_ahead), allowMissingColumns=True).withColumn(
        "week_label", _week_label())


def _week_label() -> Column:
    return F.concat(F.lit("Semaine_"), F.col("week").cast("string"))


def _weeks(df: DataFrame, weeks_ahead: int) -> DataFrame:
    return df.sparkSession.range(1, weeks_ahead + 1).select(F.col("id").cast("int").alias("week"))


def _empty_weeks(due: DataFrame, weeks_ahead: int) -> DataFrame:
    return _weeks(due, weeks_ahead).join(due.select("week").distinct(), "week", "left_anti")


def calendar_week_counts(alert_rows: DataFrame, weeks_ahead: int = 4, rules: AlertRules = ALERTS) -> DataFrame:
    counts = scheduled(alert_rows, weeks_ahead, rules).groupBy("week").agg(F.count(F.lit(1)).alias("alerts"))
    return _weeks(alert_rows, weeks_ahead).join(counts, "week", "left").select(
        _week_label().alias("week_label"), F.coalesce("alerts", F.lit(0)).alias("alerts"))


def calendar_top(alert_rows: DataFrame, weeks_ahead: int = 4, per_week: int = 5,
                 rules: AlertRules = ALERTS) -> DataFrame:
    """First alerts of each week; tasks keep only their own best ``per_week`` before the shuffle."""
    order = Window.partitionBy("week").orderBy("priority", F.desc("prob_failure"), "machine_id")
    return (scheduled(alert_rows, weeks_ahead, rules)
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_week)
            .withColumn("week_label", _week_label()))


def stats_by_level(alert_rows: DataFrame, rules: AlertRules = ALERTS) -> DataFrame:
    """Counts of all four levels, zero included."""
    wide = alert_rows.agg(*[
        F.count_if(F.col("alert_level") == level.name).alias(level.name) for level in rules.levels])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(level.name).alias("alert_level"), F.lit(level.priority).alias("priority"),
                 F.col(level.name).alias("alerts")) for level in rules.levels])).alias("r")).select("r.*")


def nonzero_levels(alert_rows: DataFrame, rules: AlertRules = ALERTS) -> DataFrame:
    return stats_by_level(alert_rows, rules).where(F.col("alerts") > 0).orderBy("priority")


def stats_by_model(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupBy("model").agg(F.count(F.lit(1)).alias("alerts"))


def critical(alert_rows: DataFrame, limit: int) -> DataFrame:
    """The first critical alerts in report order."""
    return ranked(alert_rows.where(F.col("alert_level") == CRITIQUE)).limit(limit)
