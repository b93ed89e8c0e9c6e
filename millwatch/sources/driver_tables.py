"""Maps the generic ``events`` and ``customer`` tables to the five machine logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millwatch.session import configure
from millwatch.sources.readers import RawLogs

# Fixed value: 2024-01-01T00:00:00Z in microseconds; event time is stretched fourfold from there.
EPOCH_MICROS = 1_704_067_200_000_000
STRETCH = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    moved = f"(unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_MICROS}) * {STRETCH} + {EPOCH_MICROS}"
    return table(spark, folder, "events").selectExpr("*", f"timestamp_micros({moved}) AS datetime")


def raw_logs(spark: SparkSession, folder: str) -> RawLogs:
    rows = events(spark, folder)
    coded = "concat('{0}', CAST(1 + event_id % {1} AS STRING)) AS {2}"
    return RawLogs(
        telemetry=rows.selectExpr(
            "datetime", "user_id AS machineID", "150 + value / 5 AS volt",
            "CAST(430 + event_id % 40 AS DOUBLE) AS rotate", "90 + CAST(event_id % 41 AS DOUBLE) / 2 AS pressure",
            "35 + value / 10 AS vibration"),
        errors=rows.where("event_type IN ('error', 'click')").selectExpr(
            "datetime", "user_id AS machineID", coded.format("error", 5, "errorID")),
        failures=rows.where("event_type = 'signup' AND value > 90").selectExpr(
            "datetime", "user_id AS machineID", coded.format("comp", 4, "failure")),
        maint=rows.where("event_type = 'purchase'").selectExpr(
            "datetime", "user_id AS machineID", coded.format("comp", 4, "comp")),
        machines=table(spark, folder, "customer").selectExpr(
            "c_custkey AS machineID", "concat('model', CAST(1 + c_nationkey % 4 AS STRING)) AS model",
            "CAST((c_custkey * 7) % 21 AS INT) AS age"))
