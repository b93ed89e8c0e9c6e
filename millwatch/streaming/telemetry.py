"""Windowed telemetry and event roll-ups; the same functions serve batch and streaming input."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from millwatch import config


def _watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("datetime", delay) if df.isStreaming else df


MILLIS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def _millis(interval: str) -> int:
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?\b", interval.lower())
    if not parts or any(unit not in MILLIS for _, unit in parts):
        raise ValueError(f"not a fixed interval: {interval!r}")
    return sum(int(n) * MILLIS[unit] for n, unit in parts)


def pane_length(width: str, slide: str) -> str:
    """The longest stretch that all windows begin and end with: the greatest common divisor of width and slide."""
    return f"{math.gcd(_millis(width), _millis(slide))} milliseconds"


def telemetry_windows(telemetry: DataFrame, width: str = "1 day", slide: str | None = None,
                      delay: str = "1 hour") -> DataFrame:
    """Mean and deviation of every sensor per machine and tumbling (or sliding) window.

    Sliding windows overlap: readings are first aggregated to panes (count, mean, sum of squared deviations), and only
    panes are copied into the windows that hold them. NULL readings count for no sensor figure.
    """
    rows = _watermarked(telemetry, delay)
    if not slide:
        stats = [agg(c).alias(f"{c}_{name}") for c in config.SENSORS
                 for name, agg in (("mean", F.avg), ("std", F.stddev_samp))]
        return _flat(rows.groupBy(F.window("datetime", width).alias("window"), "machineID").agg(
            *stats, F.count(F.lit(1)).alias("readings")))
    panes = rows.groupBy(F.window("datetime", pane_length(width, slide)).alias("pane"), "machineID").agg(
        F.count(F.lit(1)).alias("readings"),
        *[part for c in config.SENSORS for part in (
            F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_m"), (F.var_pop(c) * F.count(c)).alias(f"{c}_q"))])
    windows = panes.groupBy(F.window(F.window_time("pane"), width, slide).alias("window"), "machineID")
    return _flat(windows.agg(*[f for c in config.SENSORS for f in _merged(c)], F.sum("readings").alias("readings")))


def _merged(sensor: str) -> list[Column]:
    """Mean and sample deviation over panes of n readings with mean m.

    The squares about the common mean are those inside the panes and n (m - mean)^2 of each; the latter are taken from
    covariances with m, which are about the plain average of the means, so that no large squares cancel.
    """
    known = F.col(f"{sensor}_n") > 0
    n, m = F.when(known, F.col(f"{sensor}_n").cast("double")), F.when(known, F.col(f"{sensor}_m"))
    total, center = F.sum(n), F.avg(m)
    mean = F.sum(n * m) / total
    about_center = F.count(m) * (F.covar_pop(n * m, m) - center * F.covar_pop(n, m))
    squares = F.sum(F.coalesce(F.col(f"{sensor}_q"), F.lit(0.0))) + about_center - total * (mean - center) * (mean - center)
    return [mean.alias(f"{sensor}_mean"), F.when(total > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (total - 1))).alias(f"{sensor}_std")]


def event_windows(errors: DataFrame, maint: DataFrame, width: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Error and maintenance counts per machine and window, both logs in one aggregation."""
    rows = errors.select("datetime", "machineID", F.lit("error").alias("kind")).unionByName(
        maint.select("datetime", "machineID", F.lit("maintenance").alias("kind")))
    rolled = _watermarked(rows, delay).groupBy(F.window("datetime", width).alias("window"), "machineID").agg(
        F.count_if(F.col("kind") == "error").alias("error_count"),
        F.count_if(F.col("kind") == "maintenance").alias("maint_count"))
    return _flat(rolled)


def error_sessions(errors: DataFrame, gap: str = "12 hours", delay: str = "1 hour",
                   block: str = "1 day") -> DataFrame:
    """Bursts of errors per machine: errors that follow each other within ``gap``.

    A stream keeps one open session per machine. A batch finds the sessions of each machine
    and ``block`` first and merges those that touch: the merge sees a machine's sessions,
    whose number is bounded by elapsed time, and never its rows.
    """
    session = F.session_window("datetime", gap).alias("window")
    if errors.isStreaming:
        return _flat(_watermarked(errors, delay).groupBy(session, "machineID").agg(F.count(F.lit(1)).alias("errors")))
    blocks = errors.withColumn("_block", F.window("datetime", block).getField("start"))
    pieces = blocks.groupBy("machineID", "_block", session).agg(F.count(F.lit(1)).alias("errors")).select(
        "machineID", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "errors")
    order = Window.partitionBy("machineID").orderBy("start")
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = pieces.withColumn("_apart", (F.col("start") > F.max("end").over(seen)).cast("int"))
    numbered = marked.withColumn("_session", F.sum(F.coalesce("_apart", F.lit(0))).over(upto))
    return numbered.groupBy("machineID", "_session").agg(
        F.min("start").alias("window_start"), F.max("end").alias("window_end"), F.sum("errors").alias("errors")
    ).drop("_session")


def _flat(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c not in ("window", "machineID")]
    return df.select("machineID", F.col("window.start").alias("window_start"),
                     F.col("window.end").alias("window_end"), *others)
