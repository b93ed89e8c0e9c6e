"""Sinks: survival tables, JSON reports, text reports and models."""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from millwatch.operators.quality import require_columns
from millwatch.sources.readers import MANIFESTS, _store, manifests, read_survival_table


def write_survival_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if file_format == "csv" else writer.format(file_format).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Training report as JSON rows ``(model, metric, label, value)``."""
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The training report, or None when there is none yet."""
    if not _exists(spark, path):
        return None
    return spark.read.schema("model string, metric string, label string, value double").json(path)


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = ("block", "position")) -> None:
    """A report of a few hundred lines as one ordered text file."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def save_models(models: Mapping[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(0).collect()
        return True
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved pipeline, or None when the path holds none."""
    return PipelineModel.load(path) if _exists(spark, f"{path.rstrip('/')}/metadata") else None


def load_models(spark: SparkSession, names: Sequence[str], folder: str) -> dict[str, PipelineModel]:
    found = {name: load_model(spark, f"{folder.rstrip('/')}/{name}") for name in names}
    return {name: model for name, model in found.items() if model is not None}


def replace_dataset(spark: SparkSession, source: str, folder: str, version: str) -> str:
    """Validate a newly supplied table, store it as a version of its own and make it the current one; returns its path.

    A table that fails validation changes nothing. The swap is the creation of one empty file, whose name holds a number
    above all others and the version: readers see the old version or the new one. Earlier versions stay
    readable, so jobs that began before are not disturbed; a version that exists is not written again.
    """
    if not re.fullmatch(r"[\w.-]+", version):
        raise ValueError(f"not a version name: {version!r}")
    table = require_columns(read_survival_table(spark, source))
    target = f"{folder.rstrip('/')}/version={version}"
    table.write.mode("errorifexists").parquet(target)
    make_current(spark, folder, version)
    return target


def make_current(spark: SparkSession, folder: str, version: str) -> None:
    """Point the dataset to one of its versions, also back to an earlier one."""
    store, root = _store(spark, folder)
    if not store.exists(root.suffix(f"/version={version}")):
        raise ValueError(f"no version {version!r} in {folder!r}")
    while True:  # another writer may take the number in between
        taken = [int(name.split("-", 1)[0]) for name in manifests(spark, folder)]
        if store.createNewFile(root.suffix(f"/{MANIFESTS}/{max(taken, default=0) + 1:012d}-{version}")):
            return
