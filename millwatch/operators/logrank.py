"""Pairwise log-rank tests between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millwatch.functions.survival_stats import chi2_tail_1df
from millwatch.operators.scan import SUM
from millwatch.operators.survival import bucketed, observations, scan
from millwatch.session import materialise

# Groups of one block: a point is sent to every block of partners and meets the block's groups there.
BLOCK = 64


def logrank_pairs(df: DataFrame, group: str = "model", time: str = "time", event: str = "event",
                  alpha: float = 0.05) -> DataFrame:
    """``(group_a, group_b, statistic, p_value, significant)`` for every pair of groups, a < b.

    Works on the distinct ``(group, time)`` points. Groups are a stored table dealt into blocks; each point is sent to the blocks
    and joins the other groups there, one row per partner, so a pair's table is the merge of two curves and
    never a join of their rows. The number of groups is not limited.
    """
    points = materialise(observations(df, group, time, event), "grid")
    groups = materialise(points.select(F.col("group").alias("partner")).distinct(), "groups")
    blocks = max(1, -(-groups.count() // BLOCK))
    dealt = groups.withColumn("_block", F.pmod(F.xxhash64("partner"), F.lit(blocks)).cast("int"))
    sent = points.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    partnered = sent.join(dealt, (sent["_block"] == dealt["_block"]) & (sent["group"] != dealt["partner"])).select(*points.columns, "partner")
    first = F.col("group") < F.col("partner")
    merged = partnered.groupBy(
        F.least("group", "partner").alias("group_a"), F.greatest("group", "partner").alias("group_b"), "time",
    ).agg(
        F.sum(F.when(first, F.col("d")).otherwise(0)).alias("d_a"), F.sum("d").alias("d"),
        F.sum(F.when(first, F.col("m")).otherwise(0)).alias("m_a"), F.sum("m").alias("m"))

    pair = ["group_a", "group_b"]
    risk = scan(bucketed(merged, points.count()), {"n_a": ("m_a", SUM), "n": ("m", SUM)}, keys=pair, descending=True)
    d, n, n_a = (F.col(c).cast("double") for c in ("d", "n", "n_a"))
    expected = n_a * d / n
    variance = F.when(n > 1, expected * ((n - n_a) / n) * ((n - d) / (n - 1))).otherwise(0.0)
    sums = risk.groupBy("group_a", "group_b").agg(
        F.sum(F.col("d_a") - expected).alias("excess"), F.sum(variance).alias("variance"))
    statistic = F.when(F.col("variance") > 0, F.col("excess") * F.col("excess") / F.col("variance"))
    tested = sums.select("group_a", "group_b", statistic.alias("statistic"))
    return tested.withColumn("p_value", chi2_tail_1df("statistic")).withColumn(
        "significant", F.col("p_value") < alpha)
