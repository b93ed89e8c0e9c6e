"""Validation and profiling of a fleet table."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millwatch import config
from millwatch.operators.quantiles import exact_quantiles


def missing_columns(df: DataFrame, required: Sequence[str] = config.SURVIVAL_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str] = config.SURVIVAL_COLUMNS) -> DataFrame:
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def _counts(df: DataFrame) -> DataFrame:
    """One row per column: values present and missing, from one pass."""
    wide = df.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("present"),
                             F.count_if(F.col(f"`{c}`").isNull()).alias("missing")).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("data_type"),
                 F.col(f"`{c}`.present").alias("present"), F.col(f"`{c}`.missing").alias("missing"))
        for c, kind in df.dtypes])).alias("c")).select("c.*")


def missing_values(df: DataFrame) -> DataFrame:
    return _counts(df).select("column", "missing")


def data_types(df: DataFrame) -> DataFrame:
    """Type of every column with the number of values it holds."""
    return _counts(df).select("column", "data_type", "present")


def schema_check(df: DataFrame, required: Sequence[str] = config.SURVIVAL_COLUMNS) -> DataFrame:
    """Every required column: is it there, and how many values does it hold."""
    counted = _counts(df).select("column", "present")
    extra = [(c, 0) for c in missing_columns(df, required)]
    found = counted.where(F.col("column").isin(*required)).select(
        "column", F.lit(True).alias("exists"), "present")
    absent = df.sparkSession.createDataFrame(extra, "column string, present bigint").select(
        "column", F.lit(False).alias("exists"), "present")
    return found.unionByName(absent)


def survival_consistency(df: DataFrame) -> DataFrame:
    failed, censored = F.col("event") == 1, F.col("event") == 0
    return df.agg(
        F.coalesce(F.sum("event"), F.lit(0)).cast("long").alias("total_events"),
        F.count_if(censored).alias("total_censored"),
        F.coalesce(F.avg(F.when(failed, F.col("time"))), F.lit(0.0)).alias("avg_time_failure"),
        F.coalesce(F.avg(F.when(censored, F.col("time"))), F.lit(0.0)).alias("avg_time_censored"))


def validation_report(df: DataFrame, required: Sequence[str] = config.SURVIVAL_COLUMNS) -> DataFrame:
    """Whole validation as rows ``(check, column, value)``, computed in one aggregation.

    Checks: shape, missing required columns, missing values, and survival consistency.
    """
    def row(check: str, column: str | None, value: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                        value.cast("double").alias("value"))

    aggregates = {f"_null_{c}": F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns}
    aggregates["_rows"] = F.count(F.lit(1))
    rows = [row("rows", None, F.col("_rows")), row("columns", None, F.lit(len(df.columns)))]
    rows += [row("missing_column", c, F.lit(1)) for c in missing_columns(df, required)]
    rows += [row("missing_values", c, F.col(f"`_null_{c}`")) for c in df.columns]
    if {"time", "event"} <= set(df.columns):
        failed, censored = F.col("event") == 1, F.col("event") == 0
        aggregates.update(
            _total_events=F.coalesce(F.sum("event"), F.lit(0)), _total_censored=F.count_if(censored),
            _avg_time_failure=F.coalesce(F.avg(F.when(failed, F.col("time"))), F.lit(0.0)),
            _avg_time_censored=F.coalesce(F.avg(F.when(censored, F.col("time"))), F.lit(0.0)))
        rows += [row(f"survival_{name}", None, F.col(f"_{name}")) for name in (
            "total_events", "total_censored", "avg_time_failure", "avg_time_censored")]
    wide = df.agg(*[a.alias(name) for name, a in aggregates.items()])
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _columns_of(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def describe_numeric(df: DataFrame) -> DataFrame:
    """``(column, count, mean, std, min, q25, q50, q75, max)`` with exact quartiles."""
    columns = _columns_of(df, T.NumericType)
    wide = df.agg(*[F.struct(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    moments = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns
    ])).alias("e")).select("e.column", "e.s.*")
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75)).groupBy("column").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_string(df: DataFrame) -> DataFrame:
    """``(column, count, unique, top, freq)``; ties for the top value go to the smallest one."""
    columns = _columns_of(df, T.StringType)
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("e")).select("e.*")
    counted = values.groupBy("column", "value").agg(F.count("value").alias("n"))
    known = F.col("value").isNotNull()
    summary = counted.groupBy("column").agg(
        F.sum("n").alias("count"), F.count_if(known).alias("unique"), F.max("n").alias("freq"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "value"))).alias("_first"))
    return summary.select("column", "count", "unique", F.col("_first.value").alias("top"), "freq")


def data_quality_summary(df: DataFrame) -> DataFrame:
    return _counts(df).agg(F.sum("missing").alias("total_missing"), F.count(F.lit(1)).alias("columns"))


def fleet_statistics(df: DataFrame) -> DataFrame:
    present = set(df.columns)

    def average(column: str):
        return F.avg(column) if column in present else F.lit(0.0)

    return df.agg(
        F.count(F.lit(1)).alias("total_machines"),
        (F.count_distinct("model") if "model" in present else F.lit(0)).alias("unique_models"),
        average("age").alias("avg_age"), average("global_health_score").alias("avg_health"),
        (average("event") * 100).alias("failure_rate"))


def machines_by_model(df: DataFrame) -> DataFrame:
    return df.where(F.col("model").isNotNull()).groupBy("model").agg(F.count(F.lit(1)).alias("machines"))


def long_form(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Rows ``(part, key, metric, value, text)`` of several tables: one row per figure, numbers in ``value``, others in ``text``.

    ``keys`` names the column of a part that identifies its rows.
    """
    out = None
    for part, table in tables.items():
        key = keys.get(part)
        figures = [c for c in table.columns if c != key]
        number = {c: isinstance(table.schema[c].dataType, T.NumericType) for c in figures}
        rows = table.select(F.lit(part).alias("part"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), (F.col(c) if number[c] else F.lit(None)).cast("double").alias("value"),
                     (F.lit(None) if number[c] else F.col(c)).cast("string").alias("text")) for c in figures])).alias("e")
        ).select("part", "key", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


#: The identifying column of each part of the bundle.
BUNDLE_KEYS = {"numeric": "column", "text": "column", "missing": "column", "types": "column", "by_model": "model"}


def statistics(df: DataFrame) -> dict[str, DataFrame]:
    """The statistics bundle: numeric and text profile, fleet figures, machines by model."""
    bundle = {"numeric": describe_numeric(df), "text": describe_string(df), "missing": missing_values(df),
              "types": data_types(df), "fleet": fleet_statistics(df)}
    if "model" in df.columns:
        bundle["by_model"] = machines_by_model(df)
    return bundle
