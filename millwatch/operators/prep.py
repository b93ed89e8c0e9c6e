"""Cleaning: column names, coerced types and the fill policies."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from millwatch import config
from millwatch.operators.quantiles import exact_quantiles
from millwatch.operators.scan import fill_gaps


def normalise_name(name: str) -> str:
    key = name.strip().lower().replace(" ", "_")
    return "machineID" if key in ("machineid", "machine_id") else key


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])


def convert_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns that exist; values that do not parse become NULL.

    Text that holds an integer written as a decimal ("3.0") still reads as that integer.
    """
    actual = dict(df.dtypes)
    casts = {}
    for name, target in types.items():
        if name not in actual or actual[name] == target:
            continue
        value = F.col(name)
        if actual[name] == "string" and target in ("int", "bigint", "smallint", "tinyint"):
            value = value.try_cast("double")
        casts[name] = value.try_cast(target)
    return df.withColumns(casts) if casts else df


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    return df.na.fill(value, [c for c in columns if c in df.columns])


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in present]).first()
    return _fill_from(df, means.asDict())


def fill_median(df: DataFrame, columns: Sequence[str] = config.MEDIAN_FILLED) -> DataFrame:
    """Fill NULLs with the exact column median.

    The medians are fitted first, for the columns that have a NULL at all, and enter the
    plan as literals; the fill itself is a projection.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present]).first()
    gappy = [c for c in present if gaps[c]]
    if not gappy:
        return df
    medians = {r["column"]: r["value"] for r in exact_quantiles(df, gappy, (0.5,)).collect()}
    return _fill_from(df, medians)


def _fill_from(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast("double")) for c, v in values.items()})


def fill_forward(df: DataFrame, columns: Sequence[str], key: str = "machineID",
                 order: Sequence[str] = ("datetime",), bucket_seconds: int = 3600) -> DataFrame:
    """Carry the last known reading forward per machine, then the next known one backward."""
    bucketed = df.withColumn("_bucket", F.floor(F.unix_seconds(order[0]) / bucket_seconds))
    filled = fill_gaps(bucketed, [key], [["_bucket"], list(order)], {c: c for c in columns})
    return filled.select(*df.columns)
