"""Null-safe numeric column helpers.

Spark's ``greatest``/``least`` skip NULL and order NaN above every number, while the
rules of this engine treat a missing reading as "unknown". The helpers below keep NULL
as NULL; NaN is turned into NULL once, when a table is loaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MICROS_PER_DAY = 86_400_000_000


def half_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to the even neighbour of the scaled double."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip(value: Column, floor: float | None, ceiling: float | None, *readings: Column) -> Column:
    """Limit ``value`` to floor..ceiling; NULL when one of the ``readings`` behind it is NULL.

    The guard looks at the readings, not at ``value``, so a derived expression occurs once.
    """
    limited = value
    if floor is not None:
        limited = F.greatest(F.lit(float(floor)), limited)
    if ceiling is not None:
        limited = F.least(F.lit(float(ceiling)), limited)
    known = None
    for reading in readings:
        known = reading.isNotNull() if known is None else known & reading.isNotNull()
    return limited if known is None else F.when(known, limited)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def days_between(start: Column, end: Column) -> Column:
    """Elapsed days with microsecond precision."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_DAY))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floating = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floating})


def has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def leading_bits(value: Column, digits: int) -> Column:
    """Bucket of a double that never decreases with it: binary exponent and leading ``digits`` bits, for any size and sign."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    bucket = (exponent + 1100) * 2**digits + F.floor(size / F.pow(F.lit(2.0), exponent) * 2**digits)
    beyond = F.lit(2300 * 2**digits)
    finite = F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * bucket.cast("long"))
    return F.when(size == float("inf"), F.signum(value).cast("long") * beyond).otherwise(finite).cast("long")
