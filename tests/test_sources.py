"""Readers, raw-log conformance, catalogue, sinks and the survival-table ETL."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millwatch import session
from millwatch.operators import etl, quality
from millwatch.plans import jobs
from millwatch.sources import readers, schemas, sinks

HEADER = "machineid,Model,age,time,event,volt,rotate,pressure,vibration,error_count,maint count"


def csv(tmp_path, *lines, name="fleet.csv"):
    path = tmp_path / name
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_csv_is_coerced(spark, tmp_path):
    path = csv(tmp_path, "1,model1,3,10.5,1,170,450,100,40,5.0,7", "2,model2,x,NaN,0,bad,450,100,40,,7")
    df = readers.read_survival_table(spark, path).withColumnRenamed("maint_count", "maint_count")
    a, b = df.orderBy("machineID").collect()
    assert dict(df.dtypes)["machineID"] == "bigint" and dict(df.dtypes)["time"] == "double"
    assert (a.age, a.time, a.error_count, a.maint_count) == (3, 10.5, 5, 7)
    assert (b.age, b.time, b.volt, b.error_count) == (None, None, None, None)


def test_missing_file_and_missing_columns(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_survival_table(spark, str(tmp_path / "nothing.csv"))
    thin = tmp_path / "thin.csv"
    thin.write_text("machineID,model\n1,model1\n")
    with pytest.raises(ValueError, match="age"):
        jobs.load_and_prepare(spark, str(thin))
    assert quality.missing_columns(readers.read_survival_table(spark, str(thin)))[0] == "age"


def test_catalogue(spark, tmp_path):
    known = readers.Catalogue({"predictive": csv(tmp_path, "1,model1,3,10.5,1,170,450,100,40,5,7")})
    assert known.read(spark, "predictive").count() == 1
    with pytest.raises(KeyError):
        known.path("other")


def raw(spark):
    t = lambda text: text
    telemetry = spark.createDataFrame(
        [(t("2024-01-01 00:00:00"), 1, 170.0, 450.0, 100.0, 40.0), ("2024-01-11 12:00:00", 1, 172.0, None, 102.0, 42.0),
         ("2024-01-02 00:00:00", 2, 160.0, 440.0, 99.0, 39.0), ("2024-01-05 06:00:00", 2, 160.0, 440.0, 99.0, float("nan")),
         ("2024-01-01 00:00:00", 4, 1.0, 1.0, 1.0, 1.0), ("2024-01-01 00:00:00", None, 9.0, 9.0, 9.0, 9.0)],
        "datetime string, machineID long, volt double, rotate double, pressure double, vibration double")
    logs = lambda rows, code: spark.createDataFrame(rows, f"datetime string, machineID long, {code} string")
    return readers.RawLogs(
        telemetry=readers.conform(telemetry, schemas.TELEMETRY),
        errors=readers.conform(logs([("2024-01-01 01:00:00", 1, "e1"), ("2024-01-01 02:00:00", 1, "e2"),
                                     ("2024-01-01 02:00:00", 3, "e2")], "errorID"), schemas.ERRORS),
        failures=readers.conform(logs([("2024-01-06 12:00:00.500", 1, "c1"), ("2024-01-09 00:00:00", 1, "c2")], "failure"),
                                 schemas.FAILURES),
        maint=readers.conform(logs([("2024-01-03 00:00:00", 2, "c1"), ("not a time", 2, "c1")], "comp"), schemas.MAINT),
        machines=spark.createDataFrame([(1, "model1", 5), (2, "model2", 6), (3, "model3", 7)],
                                       "machineID long, model string, age int"))


def test_survival_table(spark):
    rows = {r.machineID: r for r in etl.survival_table(raw(spark)).collect()}
    assert set(rows) == {1, 2, 4}, "machines without a reading or without an id are left out"
    one, two, four = rows[1], rows[2], rows[4]
    assert (one.event, two.event) == (1, 0)
    assert one.time == pytest.approx(5.5 + 0.5 / 86400) and two.time == 3.25 and four.time == 0
    assert (one.volt, one.rotate, two.vibration) == (171.0, 450.0, 39.0)
    assert (one.error_count, one.maint_count, two.error_count, two.maint_count) == (2, 0, 0, 2)
    assert (four.model, four.age) == (None, None)
    assert etl.survival_table(raw(spark)).columns == list(schemas.SURVIVAL.names)


def test_separate_aggregates_agree_with_the_single_pass(spark):
    logs = raw(spark)
    table = {r.machineID: r for r in etl.machine_history(logs).collect()}
    for r in etl.telemetry_bounds(logs.telemetry).where("machineID IS NOT NULL").collect():
        assert (table[r.machineID].start_time, table[r.machineID].last_telemetry_time) == (r.start_time, r.last_telemetry_time)
    for r in etl.first_failure(logs.failures).collect():
        assert table[r.machineID].failure_time == r.failure_time
    for r in etl.event_counts(logs.errors, logs.maint).where("machineID <> 3").collect():
        assert (table[r.machineID].error_count, table[r.machineID].maint_count) == (r.error_count, r.maint_count)


def test_raw_logs_from_csv(spark, tmp_path):
    paths = {}
    for name, df in raw(spark).tables().items():
        paths[name] = str(tmp_path / f"{name}.csv")
        df.write.option("header", True).csv(paths[name])
    again = readers.read_raw_logs(spark, paths)
    key = lambda rows: sorted(map(str, rows))
    assert key(etl.survival_table(again).collect()) == key(etl.survival_table(raw(spark)).collect())


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_survival_table_round_trip(spark, tmp_path, file_format):
    table = etl.survival_table(raw(spark))
    path = str(tmp_path / f"out.{file_format}")
    sinks.write_survival_table(table, path, file_format)
    back = readers.read_survival_table(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


def test_new_dataset_becomes_a_version(spark, tmp_path):
    source = csv(tmp_path, "1,model1,3,10.5,1,170,450,100,40,5,7")
    with open(source, encoding="utf-8") as handle:
        good = handle.read().replace("maint count", "maint_count")
    (tmp_path / "good.csv").write_text(good, encoding="utf-8")
    path = sinks.replace_dataset(spark, str(tmp_path / "good.csv"), str(tmp_path / "data"), "2")
    assert path.endswith("version=2") and spark.read.parquet(path).count() == 1
    (tmp_path / "bad.csv").write_text("machineID\n1\n")
    with pytest.raises(ValueError):
        sinks.replace_dataset(spark, str(tmp_path / "bad.csv"), str(tmp_path / "data"), "3")


def test_current_dataset_is_swapped_as_a_whole(spark, tmp_path):
    source, folder = csv(tmp_path, "1,model1,3,10.5,1,170,450,100,40,5,7"), str(tmp_path / "data")
    with open(source, encoding="utf-8") as handle:
        good = handle.read().replace("maint count", "maint_count")
    data = readers.Catalogue({"fleet": folder, "plain": str(tmp_path / "one.csv")})
    for name, rows in (("one", 1), ("two", 2)):
        (tmp_path / f"{name}.csv").write_text(good + good.splitlines()[-1].replace("1,", "2,", 1) * (rows - 1), encoding="utf-8")
    sinks.replace_dataset(spark, str(tmp_path / "one.csv"), folder, "v1")
    before = data.read(spark, "fleet")
    sinks.replace_dataset(spark, str(tmp_path / "two.csv"), folder, "v2")
    assert (before.count(), data.read(spark, "fleet").count(), data.read(spark, "plain").count()) == (1, 2, 1)
    (tmp_path / "bad.csv").write_text("machineID\n1\n")
    for bad in (lambda: sinks.replace_dataset(spark, str(tmp_path / "bad.csv"), folder, "v3"), lambda: sinks.make_current(spark, folder, "v9"),
                lambda: sinks.replace_dataset(spark, str(tmp_path / "one.csv"), folder, "a/b")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="exist"):
        sinks.replace_dataset(spark, str(tmp_path / "one.csv"), folder, "v2")
    assert data.read(spark, "fleet").count() == 2
    sinks.make_current(spark, folder, "v1")
    assert data.read(spark, "fleet").count() == 1 and [m.split("-")[1] for m in readers.manifests(spark, folder)] == ["v1", "v2", "v1"]


def test_materialised_tables_live_in_the_shared_folder(spark):
    df = session.materialise(spark.range(5), "probe")
    assert all(session.work_dir(spark) in f for f in df.inputFiles())
    assert df.count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(Session())


def test_unparsable_time_is_null(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("soon",), (None,)], "datetime string")
    parsed = readers.parse_datetime(df)
    assert [r.datetime is None for r in parsed.collect()] == [False, True, True]
    assert readers.parse_datetime(df.withColumnRenamed("datetime", "other")).columns == ["other"]


def test_validation(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, None, 0), (3, 7.0, None)], "machineID long, time double, event int")
    report = {(r.check, r.column): r.value for r in quality.validation_report(df, ["machineID", "model"]).collect()}
    assert report[("rows", None)] == 3 and report[("columns", None)] == 3
    assert report[("missing_column", "model")] == 1 and report[("missing_values", "time")] == 1
    assert report[("survival_total_events", None)] == 1 and report[("survival_avg_time_censored", None)] == 0
    empty = quality.survival_consistency(df.where(F.lit(False))).first()
    assert (empty.total_events, empty.avg_time_failure) == (0, 0)
    assert {r.column: r.exists for r in quality.schema_check(df, ["time", "model"]).collect()} == {"time": True, "model": False}


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("a", None), (None, 8.0)], "s string, x double")
    text = quality.describe_string(df).first()
    assert (text["count"], text["unique"], text.top, text.freq) == (4, 2, "a", 2)
    number = quality.describe_numeric(df).first()
    assert (number["count"], number["mean"], number.q25, number.q50, number.q75) == (4, 3.75, 1.75, 3.0, 5.0)
    assert set(quality.statistics(df)) == {"numeric", "text", "missing", "types", "fleet"}
    assert "by_model" in quality.statistics(df.withColumnRenamed("s", "model"))
    bare = quality.fleet_statistics(df).first()
    assert (bare.total_machines, bare.unique_models, bare.avg_health) == (5, 0, 0)


def test_expired_scratch_goes_and_recent_scratch_stays(spark):
    from millwatch.session import expire_scratch, materialise
    kept = materialise(spark.range(3), "scratch-test")
    assert expire_scratch(spark, hours=24) == 0 and kept.count() == 3
