"""Helpers the corpus operators share: whitespace words, table access, Arrow batches, scratch folders."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.session import work_dir

SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def boxed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and all other columns as one struct, so that no column an operator adds can meet one of theirs."""
    filler = "_"
    while filler in docs.columns:
        filler += "_"
    return docs.select(F.struct(F.lit(0).alias(filler), *[F.col(f"`{c}`") for c in docs.columns if c not in keep]).alias("_row"), *keep)


def unboxed(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """The columns that ``boxed`` took, in their order and with their values."""
    return df.select(*[F.col(c) if c in keep else F.col("_row").getField(c).alias(c) for c in columns])


def dealt(rows: DataFrame, key: str = "key", member: str = "id", block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of ``rows`` with themselves on ``key``, to be joined on ``key`` and ``block``.

    Keys of more than ``block`` members are split: on the right each member is in one block, on the left in all of them, so that every
    pair of members still meets once and no task sees a whole large key.
    """
    large = stored(rows.groupBy(key).agg(F.count("*").alias("blocks")).where(F.col("blocks") > block), "large-keys")
    large = large.select(F.col(key).alias("_large"), F.ceil(F.col("blocks") / block).cast("int").alias("blocks"))
    known = rows.join(large, rows[key] == large["_large"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("_large")
    left = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left, known.withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")).drop("blocks")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share (``spark.checkpoint.dir``)."""
    return f"{work_dir(spark).rstrip('/')}/millwatch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    target = scratch(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes at most; one longer value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(sizes + 64) - 1) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, end - start)


def release() -> None:
    """Give memory that this worker no longer uses back to the system: workers are kept for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The values of a text column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()
