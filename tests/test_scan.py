"""Distributed running measures and exact quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.operators.prep import fill_forward, fill_mean, fill_median
from millwatch.operators.quantiles import exact_quantiles
from millwatch.operators.scan import PRODUCT, SUM, fill_gaps, running


def _rows(seed, groups=3, size=200):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        # the first group holds most rows
        for position in rng.sample(range(100_000), size * (5 if g == 0 else 1)):
            rows.append((f"g{g}", position, rng.randint(0, 5), rng.random()))
    return rows


@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_loop(spark, descending):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "g string, p long, v long, f double")
    df = df.withColumns({"hi": F.shiftright("p", 12), "lo": F.shiftright("p", 6)})
    got = {(r.g, r.p): (r.s, r.x) for r in running(
        df, ["g"], [["hi"], ["lo"], ["p"]], {"s": ("v", SUM), "x": ("f", PRODUCT)}, descending).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        total, product = 0, 1.0
        for _, p, v, f in sorted((r for r in rows if r[0] == g), reverse=descending):
            total, product = total + v, product * f
            assert got[g, p][0] == total
            assert got[g, p][1] == pytest.approx(product, rel=1e-9, abs=1e-300)


def test_fill_gaps_equals_loop(spark):
    rng = random.Random(7)
    rows = [("a" if i % 3 else "b", i, rng.random() if i > 60 and rng.random() < 0.2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, p long, v double").withColumn("bucket", F.floor(F.col("p") / 17))
    got = {(r.g, r.p): r.c for r in fill_gaps(df, ["g"], [["bucket"], ["p"]], {"c": "v"}).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        last, first = None, next(v for _, _, v in own if v is not None)
        for _, p, v in own:
            last = v if v is not None else last
            assert got[g, p] == (last if last is not None else first)


def test_fill_forward_then_backward(spark):
    rows = [(1, f"2024-01-01 0{h}:30:00", v) for h, v in enumerate([None, 2.0, None, None, 5.0, None])]
    rows += [(2, "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "machineID long, t string, v double").select(
        "machineID", F.col("t").cast("timestamp").alias("datetime"), "v")
    once = fill_forward(df, ["v"])
    assert [r.v for r in once.where("machineID = 1").orderBy("datetime").collect()] == [2, 2, 2, 2, 5, 5]
    assert once.where("machineID = 2").first().v is None
    assert once.columns == df.columns
    assert sorted(map(str, fill_forward(once, ["v"]).collect())) == sorted(map(str, once.collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 151, 4_999, 30_000])
def test_quantiles_equal_numpy(spark, size):
    rng = np.random.default_rng(size)
    # a third of all values is one and the same number
    values = np.where(rng.random(size) < 1 / 3, 42.0, rng.normal(50, 20, size))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    probabilities = (0.25, 0.5, 0.75)
    got = {r.probability: r.value for r in exact_quantiles(df, ["v"], probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("accuracy", [100, 1_000])
def test_quantiles_do_not_depend_on_the_accuracy(spark, accuracy):
    values = np.random.default_rng(8).lognormal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(16)
    got = [r.value for r in exact_quantiles(df, ["v"], (0.01, 0.5, 0.99), accuracy=accuracy).orderBy("probability").collect()]
    assert got == pytest.approx(list(np.quantile(values, [0.01, 0.5, 0.99])), rel=1e-12)


def test_quantiles_by_group_with_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 12_000), ("b", 40), (None, 7)) for v in rng.exponential(3, n)]
    rows += [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.probability): r.value for r in exact_quantiles(df, ["v"], (0.1, 0.5), by=["g"]).collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g and v is not None]
        for p in (0.1, 0.5):
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert got["c", 0.5] is None


def test_fills(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, None), (4, 7.0, None)],
                               "id long, a double, b double")
    assert [r.a for r in fill_median(df, ["a", "b", "absent"]).orderBy("id").collect()] == [1, 4, 4, 7]
    assert [r.a for r in fill_mean(df, ["a", "absent"]).orderBy("id").collect()] == [1, 4, 4, 7]
    assert fill_median(df, ["b"]).where("b IS NOT NULL").count() == 0
    whole = df.select("id")
    assert fill_median(whole, ["id"]) is whole
