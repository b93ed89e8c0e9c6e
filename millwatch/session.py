"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the results depend on (UTC) or the plans profit from (AQE)."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` of the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return shared


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage like a checkpoint does, and keeps what a checkpoint loses: column
    pruning, filter push-down and the file sizes the planner's broadcast check relies on.
    """
    spark = df.sparkSession
    target = path or f"{work_dir(spark).rstrip('/')}/millwatch/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def expire_scratch(spark: SparkSession, hours: float = 24.0) -> int:
    """Retention job: delete stored intermediate tables untouched for ``hours``; returns how many.

    Results read those tables lazily, so run it when no query that began earlier is still in use.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark).rstrip('/')}/millwatch")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return 0
    limit = jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    old = [entry.getPath() for entry in store.listStatus(folder) if entry.getModificationTime() <= limit]
    return sum(bool(store.delete(path, True)) for path in old)
