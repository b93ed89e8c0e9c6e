"""Kaplan-Meier curves per group, their summaries, and look-ups for single machines."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millwatch import config
from millwatch.functions.numeric import MICROS_PER_DAY, half_even
from millwatch.operators.scan import LAST, PRODUCT, SUM, running
from millwatch.session import materialise

POOLED = "fleet"

# No window sees many more than 2^16 rows. Up to so many points one level is enough; more go through a prefix tree over the
# microseconds of time: 2^16 per bucket, 2^16 buckets per epoch of 71 minutes, and ten years have 73,000 epochs.
FAN_IN_BITS = 16
FAN_IN = 1 << FAN_IN_BITS
PATH = [["_epoch"], ["_bucket"], ["time"]]

# A product of many steps that should be exactly one half may land a few ulps above it.
HALF_TOLERANCE = 1e-12


def bucketed(points: DataFrame, most: int | None = None) -> DataFrame:
    """Add the epoch and bucket of each point's ``time``, the outer levels of ``PATH``; not where there are ``most`` points, and those are few."""
    if most is not None and most <= FAN_IN:
        return points
    micros = F.floor(F.col("time") * F.lit(float(MICROS_PER_DAY)))
    return points.withColumns({"_epoch": F.shiftright(micros, 2 * FAN_IN_BITS), "_bucket": F.shiftright(micros, FAN_IN_BITS)})


def scan(points: DataFrame, measures, keys: Sequence[str] = ("group",), descending: bool = False) -> DataFrame:
    """Running measures over ``time`` per ``keys``; ``points`` come from ``bucketed`` and are distinct."""
    return running(points, list(keys), PATH if "_bucket" in points.columns else PATH[-1:], measures, descending)


def observations(df: DataFrame, group: str | None = "model", time: str = "time",
                 event: str = "event") -> DataFrame:
    """Distinct ``(group, time)`` with failures ``d`` and observations ``m`` at that time.

    This reduces the fleet to the points every estimator below works on; identical durations
    collapse on the map side.
    """
    key = F.col(group) if group else F.lit(POOLED)
    rows = df.select(key.alias("group"), F.col(time).cast("double").alias("time"),
                     F.col(event).cast("long").alias("event")).dropna()
    return rows.groupBy("group", "time").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("m"))


def estimation_grid(df: DataFrame, group: str | None = "model", time: str = "time", event: str = "event") -> DataFrame:
    """The distinct points, stored once because the scans read them several times; their count comes from the stored table."""
    points = materialise(observations(df, group, time, event), "grid")
    return bucketed(points, points.count())


def curve_of(points: DataFrame, variance: bool = False, min_rows: int = 2) -> DataFrame:
    """Groups with fewer than ``min_rows`` observations are left out.

    A group's size is the sum of the counts from both ends, so no row is joined to its group.
    """
    counted = scan(points, {"n": ("m", SUM)}, descending=True)
    n, d = F.col("n"), F.col("d")
    steps = counted.withColumns({
        "_keep": 1 - d / n,
        "_greenwood": F.when(n > d, d / (n * (n - d)).cast("double")).otherwise(0.0)})
    measures = {"survival": ("_keep", PRODUCT)}
    if variance:
        measures["variance"] = ("_greenwood", SUM)
    curve = scan(steps, {**measures, "_upto": ("m", SUM)}).where(F.col("_upto") + n - F.col("m") >= min_rows).select(
        "group", "time", n.alias("n_at_risk"), d, *measures)
    starts = (points.groupBy("group").agg(F.min("time").alias("first"), F.sum("m").alias("n_at_risk"))
              .where((F.col("first") > 0) & (F.col("n_at_risk") >= min_rows))
              .select("group", F.lit(0.0).alias("time"), "n_at_risk", F.lit(0).cast("long").alias("d"),
                      *[F.lit(1.0 if m == "survival" else 0.0).alias(m) for m in measures]))
    return curve.unionByName(starts)


def km_curve(df: DataFrame, group: str | None = "model", time: str = "time",
             event: str = "event", min_rows: int = 2, variance: bool = False) -> DataFrame:
    """Kaplan-Meier estimate: ``(group, time, n_at_risk, d, survival)`` per distinct time.

    Starts with a row (0, survival 1) unless the group has observations at time 0.
    """
    return curve_of(estimation_grid(df, group, time, event), variance, min_rows)


def km_confidence(df: DataFrame, group: str | None = "model", z: float = 1.96) -> DataFrame:
    """Curve with the log-log confidence band from Greenwood's variance."""
    curve = km_curve(df, group, variance=True)
    survival = F.col("survival")
    inner = (survival > 0) & (survival < 1)
    width = F.lit(z) * F.sqrt("variance") / F.log(survival)
    return curve.withColumns({
        "lower": F.when(inner, F.pow(survival, F.exp(-width))).otherwise(survival),
        "upper": F.when(inner, F.pow(survival, F.exp(width))).otherwise(survival)})


def survival_at(curve: DataFrame, horizons: Sequence[float], beyond: str = "carry") -> DataFrame:
    """Survival of each group at fixed horizons: one column ``survival_at_<h>`` per horizon.

    The as-of look-up is an aggregation: the last curve point not after the horizon. Past
    the group's last time the value is carried on, or NULL with ``beyond='null'``.
    """
    if beyond not in ("carry", "null"):
        raise ValueError("beyond must be 'carry' or 'null'")
    last = F.max("time")
    return curve.groupBy("group").agg(*[
        _horizon_value(h, last, beyond).alias(f"survival_at_{h}") for h in horizons])


def _horizon_value(horizon: float, last: Column, beyond: str) -> Column:
    known = F.coalesce(
        F.max_by("survival", F.when(F.col("time") <= horizon, F.col("time"))), F.lit(1.0))
    return known if beyond == "carry" else F.when(last >= horizon, known)


def median_survival(curve_time: str = "time", survival: str = "survival") -> Column:
    """Aggregate: first time at which the curve is at or below one half, NULL if it never is."""
    return F.min(F.when(F.col(survival) <= 0.5 + HALF_TOLERANCE, F.col(curve_time)))


def km_summary(df: DataFrame, group: str | None = "model",
               horizons: Sequence[float] = config.HORIZONS) -> DataFrame:
    """Per group: median, survival at the horizons (NULL past the last time), event counts."""
    curve = km_curve(df, group)
    last = F.max("time")
    summary = curve.groupBy("group").agg(
        median_survival().alias("median_survival_time"),
        *[_horizon_value(h, last, "null").alias(f"survival_at_{h}") for h in horizons],
        F.sum("d").alias("total_events"), F.max("n_at_risk").alias("total_observations"))
    return summary.withColumn("event_rate", F.col("total_events") / F.col("total_observations"))


def add_survival_at_horizons(df: DataFrame, curve: DataFrame, group: str = "model",
                             horizons: Sequence[float] = config.HORIZONS) -> DataFrame:
    """Give every machine its group's survival at the horizons; NULL where the group has no curve."""
    points = materialise(survival_at(curve, horizons), "horizons")  # the planner knows its size, one row per group
    return df.join(points.withColumnRenamed("group", group), group, "left").select(
        *df.columns, *[f"survival_at_{h}" for h in horizons])


def add_survival_at_time(df: DataFrame, curve: DataFrame, group: str = "model",
                         time: str = "time") -> DataFrame:
    """Survival of the machine's group at the machine's own time, which is a point of the curve."""
    points = curve.select(F.col("group").alias(group), F.col("time").alias(time),
                          F.col("survival").alias("survival_at_time"))
    return df.join(points, [group, time], "left").select(*df.columns, "survival_at_time")


def add_survival_as_of(df: DataFrame, curve: DataFrame, group: str = "model", at: str = "time",
                       output: str = "survival_as_of") -> DataFrame:
    """Survival of the row's group at any time ``at``: the last point of the curve not after it.

    Curve points and the distinct times asked for are merged in one order and the last point is carried along the prefix
    tree, so neither a group's curve nor its rows meet in one task. Past the last point its value holds on; before
    the first, in a group without a curve, and for a NULL group or time the result is NULL.
    """
    wanted = df.select(F.col(group).alias("group"), F.col(at).cast("double").alias("time")).dropna().distinct()
    points = curve.select("group", "time", F.struct("time", "survival").alias("_point"))
    merged = wanted.select("group", "time", F.lit(None).cast(points.schema["_point"].dataType).alias("_point")).unionByName(points)
    merged = merged.groupBy("group", "time").agg(F.max("_point").alias("_point"))
    carried = scan(bucketed(merged), {"_last": ("_point", LAST)}).select(
        F.col("group").alias("_group"), F.col("time").alias("_at"), F.col("_last.survival").alias("_found"))
    met = df[group].eqNullSafe(carried["_group"]) & (df[at].cast("double") == carried["_at"])
    return df.join(carried, met, "left").select(*[df[c] for c in df.columns if c != output], F.col("_found").alias(output))


def rul_columns(df: DataFrame) -> dict[str, Column]:
    """Pooled remaining-life figures and the machine's current time, as columns over the rows of ``df``.

    Constants stand in where the fleet has no observation to fit a curve on.
    """
    last = F.max("time")
    pooled = km_curve(df, None, min_rows=1).agg(
        F.count(F.lit(1)).alias("points"),
        half_even(median_survival(), 1).alias("median"),
        half_even(_horizon_value(30, last, "carry"), 3).alias("s30"),
        half_even(_horizon_value(90, last, "carry"), 3).alias("s90")).first()
    median, s30, s90 = (pooled["median"], pooled["s30"], pooled["s90"]) if pooled["points"] else (100.0, 0.8, 0.6)
    return {"rul_median": F.lit(median).cast("double"), "survival_30d": F.lit(s30), "survival_90d": F.lit(s90),
            "current_survival_time": F.col("time")}


def rul_estimates(df: DataFrame) -> DataFrame:
    """``rul_columns`` as a table by machine."""
    return df.select("machineID", *[c.alias(name) for name, c in rul_columns(df).items()])
