"""Train/test splits that depend on row ids only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwatch.config import TRAINING
from millwatch.operators.scan import SUM, running
from millwatch.session import materialise


def row_hash(id_column: str = "machineID", seed: int = TRAINING.seed) -> Column:
    """First 32 bits of MD5 over id and seed: the same in any engine, uniform in 0..2^32-1."""
    digest = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def random_split(df: DataFrame, test_fraction: float = TRAINING.test_fraction,
                 id_column: str = "machineID", seed: int = TRAINING.seed) -> DataFrame:
    """Add ``is_test`` by a threshold on the row hash; no shuffle."""
    return df.withColumn("is_test", row_hash(id_column, seed) < int(test_fraction * 2 ** 32))


def stratified_split(df: DataFrame, label: str = "event", test_fraction: float = TRAINING.test_fraction,
                     id_column: str = "machineID", seed: int = TRAINING.seed) -> DataFrame:
    """Add ``is_test`` so that each class contributes its exact share of test rows.

    Rows are ranked per class by hash, through 65 536 hash buckets, so the majority class is never
    sorted in one task. Class sizes are a stored table that joins the ranked rows. Rows without a label get none.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    size = F.count(F.lit(1)) * F.lit(test_fraction)
    quotas = materialise(rows.groupBy(F.col(label).alias("_label")).agg(F.bround(size).cast("long").alias("_quota")), "quotas")
    digest = row_hash(id_column, seed)
    hashed = rows.withColumns({"_hash": digest, "_bucket": F.shiftright(digest, 16), "_one": F.lit(1).cast("long")})
    ranked = running(hashed, [label], [["_bucket"], ["_hash", id_column]], {"_rank": ("_one", SUM)})
    return ranked.join(quotas, ranked[label] == quotas["_label"]).withColumn(
        "is_test", F.col("_rank") <= F.col("_quota")).select(*df.columns, "is_test")
