"""Raw machine logs to one survival row per machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millwatch import config
from millwatch.functions.numeric import days_between
from millwatch.sources.readers import RawLogs


def telemetry_bounds(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("machineID").agg(
        F.min("datetime").alias("start_time"), F.max("datetime").alias("last_telemetry_time"))


def first_failure(failures: DataFrame) -> DataFrame:
    return failures.groupBy("machineID").agg(F.min("datetime").alias("failure_time"))


def telemetry_means(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("machineID").agg(*[F.avg(c).alias(c) for c in config.SENSORS])


def event_counts(errors: DataFrame, maint: DataFrame) -> DataFrame:
    """Error and maintenance rows per machine, in one aggregation over both logs."""
    logs = errors.select("machineID", F.lit(1).alias("e"), F.lit(0).alias("m")).unionByName(
        maint.select("machineID", F.lit(0).alias("e"), F.lit(1).alias("m")))
    return logs.groupBy("machineID").agg(
        F.sum("e").alias("error_count"), F.sum("m").alias("maint_count"))


def machine_history(logs: RawLogs) -> DataFrame:
    """Everything the logs say about a machine, from a single shuffle by machine.

    The four logs are stacked as slim rows and aggregated once. The map side reduces them to
    one row per machine and task first, so a machine that owns a third of all readings
    costs no more to shuffle than any other. Machines without a reading are left out.
    """
    def rows(df: DataFrame, kind: str) -> DataFrame:
        sensors = config.SENSORS if kind == "reading" else ()
        return df.where(F.col("machineID").isNotNull()).select(
            "machineID", "datetime", F.lit(kind).alias("kind"), *sensors)

    stacked = rows(logs.telemetry, "reading")
    for df, kind in ((logs.failures, "failure"), (logs.errors, "error"), (logs.maint, "maintenance")):
        stacked = stacked.unionByName(rows(df, kind), allowMissingColumns=True)

    def when(kind: str, value=F.lit(1)):
        return F.when(F.col("kind") == kind, value)

    at = F.col("datetime")
    return stacked.groupBy("machineID").agg(
        F.min(when("reading", at)).alias("start_time"),
        F.max(when("reading", at)).alias("last_telemetry_time"),
        F.min(when("failure", at)).alias("failure_time"),
        *[F.avg(c).alias(c) for c in config.SENSORS],
        F.count(when("error")).alias("error_count"),
        F.count(when("maintenance")).alias("maint_count"),
        F.count(when("reading")).alias("readings"),
    ).where(F.col("readings") > 0).drop("readings")


def survival_table(logs: RawLogs) -> DataFrame:
    """One row per machine with readings: lifetime, failure flag, sensor means, counts, model, age."""
    history = machine_history(logs)
    failed = F.col("failure_time").isNotNull()
    end_time = F.coalesce("failure_time", "last_telemetry_time")
    timed = history.withColumns({
        "event": failed.cast("int"), "time": days_between(F.col("start_time"), end_time)})
    attributes = logs.machines.select("machineID", "model", "age")
    return timed.join(attributes, "machineID", "left").select(*config.SURVIVAL_COLUMNS)
