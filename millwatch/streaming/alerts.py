"""Stateless alert scoring of a stream of fleet snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millwatch.config import ALERTS, AlertRules
from millwatch.operators.alerts import alerts, append_history
from millwatch.operators.features import health_features


def alert_stream(snapshots: DataFrame, as_of: datetime | str, rules: AlertRules = ALERTS) -> DataFrame:
    """Alerts of every arriving snapshot row: projections and a filter, no state, no ordering."""
    return alerts(health_features(snapshots, fill=False), as_of, rules)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a parquet table; ``once`` drains what is there and stops."""
    writer = (df.writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_history(alert_rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep a stream's alerts as a history by day and batch; a batch that is replayed after a failure replaces itself."""
    writer = alert_rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: append_history(rows, path, batch=batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
