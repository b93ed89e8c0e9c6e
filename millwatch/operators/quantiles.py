"""Exact quantiles in two passes, without sorting or gathering a column in one task.

Pass one brackets every requested rank with an approximate percentile, whose rank error is
bounded. Pass two counts the distinct values inside the brackets and folds everything
outside into one counter per gap, so the final running count covers only the few rows
around each rank, and goes through buckets of bounded size.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.functions.numeric import leading_bits
from millwatch.operators.scan import SUM, running
from millwatch.session import materialise

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Rows ``(*by, column, probability, value)`` with linear interpolation between ranks.

    NULLs are ignored; a column without values yields NULL. About 8 / ``accuracy`` of a group's distinct
    values per rank are left for the last step, which counts them through buckets of their
    leading bits, so no task sees more of them than one bucket holds.
    """
    by = list(by)
    probabilities = sorted(set(float(p) for p in probabilities))
    slack = 4.0 / accuracy
    bounds = [b for p in probabilities for b in (max(p - slack, 0.0), min(p + slack, 1.0))]

    source = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    brackets = source.groupBy(*by).agg(*[
        F.percentile_approx(c, bounds, accuracy).alias(f"_bounds_{c}") for c in columns])

    if by:
        # Stored, so the planner knows that it has one row per group and need not shuffle the source by it.
        bracketed = _join_groups(source, materialise(brackets, "brackets"), by)
    else:
        known = brackets.first()
        bracketed = source.withColumns({
            f"_bounds_{c}": F.lit(known[f"_bounds_{c}"]).cast("array<double>") for c in columns})

    folded = bracketed.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"),
                 F.expr(_fold(f"`{c}`", f"`_bounds_{c}`", len(probabilities))).alias("slot"))
        for c in columns])).alias("entry")).select(*by, "entry.*")
    counted = folded.groupBy(*by, "column", "slot").agg(
        F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))

    # Keys that may be NULL are joined as texts; the slot of the NULLs comes first and counts nothing.
    names = [f"_key_{i}" for i in range(len(by))]
    keyed = counted.withColumns({
        **{k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(names, by)},
        "_value": F.coalesce("slot.value", F.lit(float("-inf"))), "_gap": F.coalesce("slot.gap", F.lit(-1))})
    keyed = keyed.withColumn("_bucket", leading_bits(F.col("_value"), 20))
    ranked = running(keyed, [*names, "column"], [["_bucket"], ["_value", "_gap"]], {"upto": ("n", SUM)})
    totals = counted.groupBy(*by, "column").agg(F.sum("n").alias("total"))
    totals = totals.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(names, by)})
    ranked = ranked.join(totals.select(*names, "column", "total"), [*names, "column"])
    picks = []
    for p in probabilities:
        position = (F.col("total") - 1) * F.lit(p)
        picks.append(F.struct(
            F.lit(p).alias("probability"),
            F.min(_value_at(F.floor(position))).alias("low"),
            F.min(_value_at(F.ceil(position))).alias("high"),
            F.max(position - F.floor(position)).alias("part")))
    found = ranked.groupBy(*by, "column").agg(F.array(*picks).alias("found"))
    flat = found.select(*by, "column", F.explode("found").alias("q"))
    return flat.select(*by, "column", "q.probability",
                       (F.col("q.low") + (F.col("q.high") - F.col("q.low")) * F.col("q.part")).alias("value"))


def _value_at(rank: Column) -> Column:
    """Value of the 0-based ``rank`` when this slot holds it, else NULL.

    A gap knows its two end values only. A rank further inside a gap would mean that the
    approximate percentile broke its error bound, which fails the query.
    """
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    value = (F.when(rank == last, F.col("most")).when(rank == first, F.col("least"))
             .when(F.col("least") == F.col("most"), F.col("least"))
             .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")))
    return F.when((rank >= first) & (rank <= last), value)


def _join_groups(source: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach each group's brackets; groups with a NULL key keep theirs."""
    renamed = brackets.withColumnsRenamed({c: f"_group_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_group_{c}")) for c in by]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    return source.join(renamed, condition).drop(*[f"_group_{c}" for c in by])


def _fold(value: str, bounds: str, ranks: int) -> str:
    """SQL of a value's slot: itself inside a bracket, else one shared slot for the gap it lies in."""
    inside = " OR ".join(
        f"{value} BETWEEN get({bounds}, {2 * i}) AND get({bounds}, {2 * i + 1})" for i in range(ranks))
    gaps = " ".join(
        f"WHEN {value} > get({bounds}, {2 * i + 1}) THEN get({bounds}, {2 * i + 1})" for i in reversed(range(ranks)))
    return f"""CASE WHEN {value} IS NULL THEN NULL
        WHEN {inside} THEN named_struct('value', {value}, 'gap', 0)
        ELSE named_struct('value', CASE {gaps} ELSE double('-Infinity') END, 'gap', 1) END"""
