"""Connected components by alternating large and small stars; each round is one stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Rounds end when the edges no longer change; their number grows with the logarithm of the longest
    path. Minima are pre-aggregated before each shuffle, so a node with many edges costs one row per task.
    """
    stars = stored(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    state = None
    while True:
        both = stars.union(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        top = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(top, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        stars = stored(small.select("e.*").where("hi <> lo").distinct(), "edges")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == state or not now[0]:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                stars.select("lo", "lo").distinct())
        state = now
