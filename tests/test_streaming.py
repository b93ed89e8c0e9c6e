"""Streaming results equal the batch results of the same functions."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from millwatch.operators.alerts import alerts
from millwatch.operators.features import health_features
from millwatch.sources import driver_tables
from millwatch.streaming import telemetry as windows
from millwatch.streaming.alerts import alert_stream, write_history, write_stream

FOLDER = "/root/testdata/sf0.001"
FAR = "2030-01-01 00:00:00"


@pytest.fixture(scope="module")
def logs(spark):
    return driver_tables.raw_logs(spark, FOLDER)


def stream_of(spark, df, folder, parts=3):
    """Write rows in time order to several files, then a sentinel row that closes every window."""
    stamped = df.withColumn("_part", F.ntile(parts).over(Window.orderBy("datetime")))
    for part in range(1, parts + 1):
        stamped.where(F.col("_part") == part).drop("_part").coalesce(1).write.parquet(f"{folder}/{part}")
    last = df.limit(1).withColumns({"datetime": F.lit(FAR).cast("timestamp"), "machineID": F.lit(-1).cast("long")})
    last.coalesce(1).write.parquet(f"{folder}/{parts + 1}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(spark, df, tmp_path, name):
    query = write_stream(df, str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_state"), once=True)
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(df.schema).parquet(str(tmp_path / f"{name}_out"))


def same(streamed, batch):
    def rows(df):
        return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.where("machineID <> -1").collect())
    assert rows(streamed) == rows(batch)


@pytest.mark.parametrize("slide", [None, "7 days"])
def test_telemetry_windows(spark, logs, tmp_path, slide):
    stream = stream_of(spark, logs.telemetry, str(tmp_path / "in"))
    arguments = dict(width="14 days", slide=slide, delay="1 day")
    same(drain(spark, windows.telemetry_windows(stream, **arguments), tmp_path, "telemetry"),
         windows.telemetry_windows(logs.telemetry, **arguments))


def test_sliding_windows_of_panes(spark, plan_of):
    """Panes give what readings copied into every window give, with NULLs, single readings and a large offset; readings are not copied."""
    rng = np.random.default_rng(3)
    rows = [(int(m), float(s), *(None if rng.random() < 0.2 else float(1e6 + rng.normal()) for _ in range(4))) for m, s in zip(rng.integers(0, 4, 600), rng.uniform(0, 40 * 86400, 600))]
    df = spark.createDataFrame(rows, "machineID long, s double, volt double, rotate double, pressure double, vibration double")
    df = df.withColumn("datetime", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    for width, slide in (("3 days", "1 day"), ("50 hours", "30 hours")):
        got = windows.telemetry_windows(df, width, slide)
        direct = df.groupBy(F.window("datetime", width, slide).alias("w"), "machineID").agg(
            F.avg("volt").alias("m"), F.stddev_samp("volt").alias("s"), F.count(F.lit(1)).alias("n"))
        want = {(r.machineID, r.w.start): (r.m, r.s, r.n) for r in direct.collect()}
        found = {(r.machineID, r.window_start): (r.volt_mean, r.volt_std, r.readings) for r in got.collect()}
        assert found.keys() == want.keys()
        for key, (m, s, n) in want.items():
            assert found[key] == (m if m is None else pytest.approx(m, rel=1e-12), s if s is None else pytest.approx(s, rel=1e-6, abs=1e-6), n)
    assert windows.pane_length("14 days", "1 hour") == "3600000 milliseconds"
    plan = plan_of(windows.telemetry_windows(df, "14 days", "1 hour"), "simple")
    assert plan.rindex("Exchange") > plan.index("Expand") if "Expand" in plan else plan.count("Exchange") == 2
    with pytest.raises(ValueError):
        windows.pane_length("1 month", "1 day")


def test_history_of_a_stream(spark, tmp_path):
    """A stream's history by batch; a batch that runs again does not double its alerts."""
    schema = "machineID long, model string, age int, time double, volt double, rotate double, pressure double, " \
             "vibration double, error_count long, maint_count long"
    snapshot = spark.createDataFrame([(i, "m", 3, 5.0, 170.0, 450.0, 100.0, 40.0, 50, 3) for i in range(40)], schema)
    snapshot.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(snapshot.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("state", "lost"):  # the second run has lost its progress and replays all batches
        query = write_history(alert_stream(stream, "2024-06-01 00:00:00"), str(tmp_path / "history"), str(tmp_path / checkpoint), once=True)
        query.awaitTermination(300)
        assert query.exception() is None
        history = spark.read.parquet(str(tmp_path / "history"))
        assert history.count() == history.select("machine_id").distinct().count() == 40


def test_event_windows(spark, logs, tmp_path):
    errors = stream_of(spark, logs.errors, str(tmp_path / "errors"))
    maint = stream_of(spark, logs.maint, str(tmp_path / "maint"))
    same(drain(spark, windows.event_windows(errors, maint, delay="60 days"), tmp_path, "events"),
         windows.event_windows(logs.errors, logs.maint))


def test_error_sessions(spark, logs, tmp_path):
    stream = stream_of(spark, logs.errors, str(tmp_path / "in"))
    same(drain(spark, windows.error_sessions(stream, "2 days", "1 day"), tmp_path, "sessions"),
         windows.error_sessions(logs.errors, "2 days"))


def test_sessions_across_blocks(spark):
    rows = [(1, t) for t in ("2024-01-01 22:00:00", "2024-01-01 23:59:59", "2024-01-02 01:00:00", "2024-01-02 05:00:00", "2024-01-02 09:00:01",
                             "2024-01-03 23:00:00", "2024-01-04 03:00:00")] + [(2, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "machineID long, t string").select("machineID", F.col("t").cast("timestamp").alias("datetime"))
    for block in ("1 hour", "1 day", "30 days"):
        got = windows.error_sessions(df, "4 hours", block=block).orderBy("machineID", "window_start").collect()
        assert [(r.machineID, str(r.window_start), str(r.window_end), r.errors) for r in got] == [
            (1, "2024-01-01 22:00:00", "2024-01-02 09:00:00", 4), (1, "2024-01-02 09:00:01", "2024-01-02 13:00:01", 1),
            (1, "2024-01-03 23:00:00", "2024-01-04 07:00:00", 2), (2, "2024-01-02 00:00:00", "2024-01-02 04:00:00", 1)]
    # the built-in operator draws the same line: errors exactly one gap apart belong together
    builtin = df.groupBy(F.session_window("datetime", "4 hours"), "machineID").count()
    assert builtin.count() == 4


def test_late_rows_are_dropped(spark, logs, tmp_path):
    folder = str(tmp_path / "in")
    stream_of(spark, logs.errors, folder)
    late = logs.errors.limit(1).withColumns({"datetime": F.lit("2020-01-01").cast("timestamp"), "machineID": F.lit(-2).cast("long")})
    late.coalesce(1).write.parquet(f"{folder}/9_late")
    stream = spark.readStream.schema(logs.errors.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = drain(spark, windows.error_sessions(stream, "2 days", "1 day"), tmp_path, "late")
    assert out.where("machineID = -2").count() == 0


def test_alert_stream(spark, tmp_path):
    rows = [(i, f"model{i % 4 + 1}", i % 20, float(i), 170.0, 450.0, 100.0, 36.0 + i % 12, i % 50, i % 30) for i in range(120)]
    schema = "machineID long, model string, age int, time double, volt double, rotate double, pressure double, " \
             "vibration double, error_count long, maint_count long"
    snapshot = spark.createDataFrame(rows, schema)
    snapshot.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(snapshot.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(spark, alert_stream(stream, "2024-06-01 00:00:00"), tmp_path, "alerts")
    batch = alerts(health_features(snapshot, fill=False), "2024-06-01 00:00:00")
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect())) and batch.count() > 0
