"""Readers for survival tables and raw logs, and a named dataset catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millwatch.functions.numeric import nan_to_null
from millwatch.operators.prep import convert_types, normalise_columns
from millwatch.sources import schemas

SURVIVAL_TYPES = {f.name: f.dataType.simpleString() for f in schemas.SURVIVAL.fields}


@dataclass(frozen=True)
class RawLogs:
    """The five raw inputs of the survival-table ETL."""

    telemetry: DataFrame
    errors: DataFrame
    failures: DataFrame
    maint: DataFrame
    machines: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.RAW_LOGS}


def _format_of(path: str) -> str:
    return "csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet"


def read_table(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Read CSV (every column as text, so that bad values can be coerced) or parquet."""
    file_format = file_format or _format_of(path)
    if file_format == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(file_format).load(path)


def read_survival_table(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Load a survival table: normalised names, coerced types, NaN as NULL.

    A missing path raises Spark's ``AnalysisException`` (``PATH_NOT_FOUND``).
    """
    raw = normalise_columns(read_table(spark, path, file_format))
    return nan_to_null(convert_types(raw, SURVIVAL_TYPES))


def parse_datetime(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Turn a text column into timestamps (unreadable text becomes NULL); no-op when absent."""
    if column not in df.columns:
        return df
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return df
    if isinstance(kind, T.StringType):
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    return df.withColumn(column, F.col(column).cast("timestamp"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Coerce the columns of ``schema`` that exist in ``df``; other columns pass through."""
    df = parse_datetime(normalise_columns(df))
    types = {f.name: f.dataType.simpleString() for f in schema.fields
             if not isinstance(f.dataType, T.TimestampType)}
    return nan_to_null(convert_types(df, types))


def read_raw_logs(spark: SparkSession, paths: Mapping[str, str], file_format: str | None = None) -> RawLogs:
    """Read the five logs named in ``schemas.RAW_LOGS`` from their paths."""
    return RawLogs(**{
        name: conform(read_table(spark, paths[name], file_format), schema)
        for name, schema in schemas.RAW_LOGS.items()
    })


MANIFESTS = "_current"


def _store(spark: SparkSession, folder: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of the dataset's manifests, ``<number>-<version>``, the current one last."""
    store, root = _store(spark, folder)
    place = root.suffix(f"/{MANIFESTS}")
    return sorted(entry.getPath().getName() for entry in store.listStatus(place)) if store.exists(place) else []


def current_path(spark: SparkSession, path: str) -> str:
    """Path of the current version of a versioned dataset; any other path stands for itself."""
    names = manifests(spark, path)
    return f"{path.rstrip('/')}/version={names[-1].split('-', 1)[1]}" if names else path


class Catalogue:
    """Named datasets of a deployment, resolved to paths."""

    def __init__(self, paths: Mapping[str, str]):
        self._paths = dict(paths)

    def path(self, name: str) -> str:
        if name not in self._paths:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self._paths)}")
        return self._paths[name]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The dataset as it is now: a table that is replaced later does not change under its readers."""
        return read_survival_table(spark, current_path(spark, self.path(name)))
