"""Minimax contiguous partition of a corpus into shards of near equal bytes.

Equal texts are one atomic group. Groups stand in the order of the MD5 of their text, and runs of
groups that share the first ``BLOCK_DIGITS`` hex digits are the ordered atoms: 65,536 sizes at most, whatever
the corpus, which is all that reaches the driver. The smallest feasible capacity is found by binary
search; a greedy walk checks each candidate and finally makes the cuts. An atom above the capacity
(a text copied into a large part of the corpus) gets a shard of its own, so it does not loosen the others.

NULL texts have no bytes and form a group with the empty ones. Rows are never dropped; repeated rows take
a slot each. Columns of the input stay unless they bear the name of a column added here. Without rows there are no shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OVERHEAD = 16
BLOCK_DIGITS = 4
#: Rows of one block are numbered in parts of about so many.
PART_ROWS = 100_000


def _reach(ends: np.ndarray, at: int, capacity: int) -> int:
    """End of the longest run of atoms from ``at`` within the capacity; one atom at least."""
    before = int(ends[at - 1]) if at else 0
    return max(at + 1, int(np.searchsorted(ends, before + capacity, side="right")))


def feasible(ends: np.ndarray, shards: int, capacity: int) -> bool:
    """Greedy walk: do the atoms fit ``shards`` shards of ``capacity``?"""
    at = 0
    for _ in range(shards):
        if at >= len(ends):
            return True
        at = _reach(ends, at, capacity)
    return at >= len(ends)


def minimax(sizes: np.ndarray, shards: int) -> np.ndarray:
    """First atom of every shard, for the smallest capacity the greedy walk finds feasible.

    Cuts that the capacity leaves free go where the rest is divided most evenly; shards that get no
    atom start behind the last one.
    """
    ends = np.cumsum(sizes)
    low, high = 0, int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if feasible(ends, shards, middle):
            high = middle
        else:
            low = middle + 1
    n = len(sizes)
    least = [n]  # from behind: where a shard must start at the earliest, so that it and the later ones can hold the rest
    for _ in range(shards):
        stop = least[-1]
        base = int(ends[stop - 1]) - low if stop else 0
        least.append(min(max(stop - 1, 0), int(np.searchsorted(ends, base, side="left")) + 1 if base > 0 else 0))
    least = least[::-1]
    starts = [0]
    for k in range(1, shards):
        at = starts[-1]
        if at >= n:
            starts.append(n)
            continue
        before = int(ends[at - 1]) if at else 0
        goal = before + (int(ends[-1]) - before) / (shards - k + 1)
        even = int(np.searchsorted(ends, goal)) + 1
        if even - 1 > at and goal - ends[even - 2] < ends[min(even, n) - 1] - goal:
            even -= 1
        starts.append(min(max(even, at + 1, least[k]), _reach(ends, at, low)))
    return np.array(starts, dtype=np.int64)


def assign(docs: DataFrame, shards: int, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    added = ("size", "text_crc32", "shard", "slot", "_digest", "_block", "_part", "_parts", "_from", "_slot", "_before")
    plain = docs.drop(*[c for c in docs.columns if c.lower() in added])
    sized = plain.select(
        "*", (F.octet_length(value) + OVERHEAD).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        F.md5(value.cast("binary")).alias("_digest"),
    ).withColumn("_block", F.conv(F.substring("_digest", 1, BLOCK_DIGITS), 16, 10).cast("int"))

    blocks = sized.groupBy("_block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("_block")
    plan = _plan(blocks["_block"].to_numpy(), blocks["size"].to_numpy(), blocks["n"].to_numpy(), shards)
    atoms = spark.createDataFrame(plan, "_block int, shard int, _from long, _parts int")
    # 16^BLOCK_DIGITS rows of 20 bytes at most
    placed = sized.join(F.broadcast(atoms), "_block").withColumn("_part", F.pmod(F.xxhash64(order, "_digest"), F.col("_parts")))
    parts = placed.groupBy("_block", "_part").agg(F.count("*").alias("_slot"))
    before = F.sum("_slot").over(Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_block", "_part", F.coalesce(before, F.lit(0)).alias("_before")).where(F.col("_before") > 0)
    rank = F.row_number().over(Window.partitionBy("_block", "_part").orderBy("_digest", F.col(order).asc_nulls_last()))
    ranked = placed.withColumn("_slot", rank)
    slot = F.col("_from") + F.coalesce(F.col("_before"), F.lit(0)) + F.col("_slot") - 1
    return ranked.join(parts, ["_block", "_part"], "left").withColumn("slot", slot.cast("long")).select(
        *plain.columns, "size", "text_crc32", "shard", "slot")


def _plan(block: np.ndarray, size: np.ndarray, n: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """(block, shard, first slot, parts) of every block."""
    if not len(block):
        return []
    starts = minimax(size.astype(np.int64), shards)
    shard = np.searchsorted(starts, np.arange(len(block)), side="right") - 1
    total = np.cumsum(n) - n
    first = total - np.append(total, total[-1] + n[-1])[starts][shard]
    parts = -(-n // PART_ROWS)
    return list(zip(block.tolist(), shard.tolist(), first.tolist(), parts.tolist(), strict=True))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only digests and sizes go on from here; the texts are hashed once.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                   F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_minimax_shards": op5_minimax_shards}
ORACLES: dict[str, str] = {}
