"""Distributed running totals over an order that may hold billions of rows per group.

A window ``partitionBy(group).orderBy(position)`` puts a whole group into one task. Here
the position is described by a *path* of columns from coarse to fine, such as
``[[hour], [timestamp]]``. Each level runs a window inside one bucket of the level above,
buckets are summarised by an ordinary aggregation, and the summaries are scanned the same
way one level up. No window sees more rows than one bucket has children, however large or
skewed the group is, and every step is a plain aggregation, window or equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Path = Sequence[Sequence[str]]


@dataclass(frozen=True)
class Measure:
    """An associative running measure: how to total it, and how to join two stretches of it."""

    total: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    identity: object


SUM = Measure(F.sum, lambda before, here: before + here, 0)
PRODUCT = Measure(F.product, lambda before, here: before * here, 1.0)
#: The largest value so far; of structs that begin with the position, the last known one.
LAST = Measure(F.max, lambda before, here: F.greatest(before, here), None)

Measures = Mapping[str, tuple[str, Measure]]


def _ordering(columns: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in columns]


def _flat(path: Path) -> list[str]:
    return [c for level in path for c in level]


def running(df: DataFrame, keys: Sequence[str], path: Path, measures: Measures,
            descending: bool = False) -> DataFrame:
    """Add inclusive running measures per ``keys`` along ``path``.

    ``measures`` maps an output column to ``(input column, Measure)``; inputs hold no NULL (``LAST``
    skips them) and rows are unique in ``keys + path``.
    """
    return _scan(df, list(keys), [list(level) for level in path], measures, descending, Window.currentRow)


def _scan(df, keys, path, measures, descending, upto):
    *outer, leaf = path
    bucket = keys + _flat(outer)
    window = (Window.partitionBy(*(bucket or [F.lit(0)])).orderBy(*_ordering(leaf, descending))
              .rowsBetween(Window.unboundedPreceding, upto))
    local = df.withColumns({
        out: F.coalesce(m.total(F.col(source)).over(window), F.lit(m.identity))
        for out, (source, m) in measures.items()})
    if not outer:
        return local
    totals = df.groupBy(*bucket).agg(
        *[m.total(F.col(source)).alias(f"_total_{out}") for out, (source, m) in measures.items()])
    before = _scan(totals, keys, outer,
                   {f"_before_{out}": (f"_total_{out}", m) for out, (_, m) in measures.items()},
                   descending, -1)
    before = before.select(*bucket, *[f"_before_{out}" for out in measures])
    joined = local.join(before, bucket)
    return joined.withColumns({
        out: m.combine(F.col(f"_before_{out}"), F.col(out)) for out, (_, m) in measures.items()
    }).drop(*[f"_before_{out}" for out in measures])


def fan_in(df: DataFrame, keys: Sequence[str], path: Path) -> DataFrame:
    """The most rows that one window of a scan along ``path`` sees, by level from coarse to fine."""
    out = None
    for level in range(len(path)):
        bucket, children = list(keys) + _flat(path[:level]), list(keys) + _flat(path[:level + 1])
        sizes = df.select(*children).distinct().groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows"))
        most = sizes.agg(F.lit(level).alias("level"), F.max("rows").alias("rows"))
        out = most if out is None else out.unionByName(most)
    return out


def fill_gaps(df: DataFrame, keys: Sequence[str], path: Path, columns: Mapping[str, str]) -> DataFrame:
    """Last known value at or before each row, else the first known one after it.

    ``path`` has two levels. Inside a bucket both directions share one sort; across buckets
    only each bucket's first and last known values travel. The rows are shuffled once.
    """
    keys, (outer, leaf) = list(keys), [list(level) for level in path]
    bucket = keys + outer
    inside = Window.partitionBy(*bucket).orderBy(*leaf)
    backward = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = df.withColumns({
        **{f"_last_{out}": F.last(source, ignorenulls=True).over(backward) for out, source in columns.items()},
        **{f"_next_{out}": F.first(source, ignorenulls=True).over(forward) for out, source in columns.items()}})

    position = F.struct(*leaf)
    ends = df.groupBy(*bucket).agg(
        *[F.max_by(F.col(source), F.when(F.col(source).isNotNull(), position)).alias(f"_end_{out}")
          for out, source in columns.items()],
        *[F.min_by(F.col(source), F.when(F.col(source).isNotNull(), position)).alias(f"_start_{out}")
          for out, source in columns.items()])
    across = Window.partitionBy(*keys).orderBy(*outer)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *bucket,
        *[F.last(f"_end_{out}", ignorenulls=True).over(earlier).alias(f"_before_{out}") for out in columns],
        *[F.first(f"_start_{out}", ignorenulls=True).over(later).alias(f"_after_{out}") for out in columns])
    joined = local.join(carried, bucket, "left")
    return joined.withColumns({
        out: F.coalesce(f"_last_{out}", f"_before_{out}", f"_next_{out}", f"_after_{out}") for out in columns
    }).drop(*[f"_{kind}_{out}" for kind in ("last", "next", "before", "after") for out in columns])
