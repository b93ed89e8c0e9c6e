"""Kaplan-Meier, log-rank and Cox against direct loops."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from millwatch.functions.survival_stats import chi2_tail_1df
from millwatch.operators import cox, survival
from millwatch.operators.cox import fit_cox, independent
from millwatch.operators.logrank import logrank_pairs
from millwatch.operators.scan import fan_in

SCHEMA = "machineID long, model string, time double, event int"


def fleet(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def loop_curve(rows):
    """{(group, time): (at risk, failures, survival)} by the definition."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [(t, e) for k, t, e in rows if k == g]
        if len(own) < 2:
            continue
        s = 1.0
        for t in sorted({t for t, _ in own}):
            n = sum(u >= t for u, _ in own)
            d = sum(u == t and e == 1 for u, e in own)
            s *= 1 - d / n
            out[g, t] = (n, d, s)
        if min(t for t, _ in own) > 0:
            out[g, 0.0] = (len(own), 0, 1.0)
    return out


def loop_logrank(a, b):
    excess = variance = 0.0
    for t in sorted({t for t, _ in a + b}):
        na, nb = sum(u >= t for u, _ in a), sum(u >= t for u, _ in b)
        da, db = (sum(u == t and e for u, e in x) for x in (a, b))
        n, d = na + nb, da + db
        excess += da - na * d / n
        variance += na * nb * d * (n - d) / (n * n * (n - 1)) if n > 1 else 0
    return excess ** 2 / variance if variance else None


def sample(seed, size=120, times=40):
    rng = random.Random(seed)
    # model m1 owns most machines, and a third of all machines stops at one time
    return [(rng.choice(["m1"] * 5 + ["m2", "m3"]),
             float(times) if rng.random() < 1 / 3 else rng.randint(0, times) + rng.choice([0.0, 0.25]),
             int(rng.random() < 0.7)) for _ in range(size)] + [("alone", 3.0, 1)]


@pytest.mark.parametrize(("seed", "fan_in"), [(1, 0), (2, 0), (2, 1 << 16)])
def test_km_equals_loop(spark, monkeypatch, seed, fan_in):
    monkeypatch.setattr(survival, "FAN_IN", fan_in)
    rows = sample(seed)
    got = {(r.group, r.time): (r.n_at_risk, r.d, r.survival) for r in survival.km_curve(fleet(spark, rows)).collect()}
    want = loop_curve(rows)
    assert got.keys() == want.keys()
    for key, (n, d, s) in want.items():
        assert got[key][:2] == (n, d)
        assert got[key][2] == pytest.approx(s, abs=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6).map(float), st.integers(0, 1)), min_size=4, max_size=25))
def test_km_properties(spark, rows):
    curve = survival.km_curve(fleet(spark, rows).repartition(3))
    by_group = {}
    for r in curve.orderBy("group", "time").collect():
        by_group.setdefault(r.group, []).append(r.survival)
    for values in by_group.values():
        assert all(0 <= v <= 1 for v in values)
        assert values == sorted(values, reverse=True)
    assert {(k, round(v[2], 9)) for k, v in loop_curve(rows).items()} == {
        ((r.group, r.time), round(r.survival, 9)) for r in curve.collect()}


def test_curve_inside_one_bucket(spark, monkeypatch):
    """Times a few microseconds apart share a bucket; the curve is the same as over days."""
    monkeypatch.setattr(survival, "FAN_IN", 0)
    steps = [(1 + i % 3, i % 4 > 0) for i in range(200)]
    days = [("m", float(t), int(e)) for t, e in steps]
    micros = [("m", t / 86_400_000_000, e) for _, t, e in days]
    shape = lambda rows: [(r.n_at_risk, r.d, round(r.survival, 12)) for r in survival.km_curve(fleet(spark, rows)).orderBy("time").collect()]
    assert shape(days) == shape(micros)


def test_horizon_policies(spark):
    df = fleet(spark, [("m", 10.0, 1), ("m", 40.0, 1), ("z", 0.0, 1), ("z", 200.0, 0)])
    curve = survival.km_curve(df)
    carried = {r.group: r for r in survival.survival_at(curve, (5, 30, 90)).collect()}
    assert (carried["m"].survival_at_5, carried["m"].survival_at_30, carried["m"].survival_at_90) == (1.0, 0.5, 0.0)
    known = {r.group: r for r in survival.survival_at(curve, (30, 90), beyond="null").collect()}
    assert known["m"].survival_at_90 is None and known["z"].survival_at_90 == 0.5
    assert curve.where("group = 'z' AND time = 0").count() == 1
    with pytest.raises(ValueError):
        survival.survival_at(curve, (30,), beyond="extend")


def test_median_is_exact_at_one_half(spark):
    # 32 machines whose curve reaches one half exactly after many unequal steps
    times = [1, 1, 1, 4, 5, 5, 6, 9, 9, 9, 9, 12, 15, 15, 18, 35] + [37 + i for i in range(16)]
    df = fleet(spark, [("m", float(t), 1) for t in times])
    assert survival.km_summary(df).first().median_survival_time == 35.0
    none = survival.km_summary(fleet(spark, [("m", 1.0, 0), ("m", 2.0, 0)])).first()
    assert none.median_survival_time is None and none.event_rate == 0


def test_lookups_for_machines(spark):
    df = fleet(spark, [("m", 10.0, 1), ("m", 40.0, 1), ("solo", 7.0, 1), (None, 3.0, 1)])
    curve = survival.km_curve(df)
    own = {r.machineID: r.survival_at_time for r in survival.add_survival_at_time(df, curve).collect()}
    assert own == {0: 0.5, 1: 0.0, 2: None, 3: None}
    at = {r.machineID: r.survival_at_30 for r in survival.add_survival_at_horizons(df, curve).collect()}
    assert at == {0: 0.5, 1: 0.5, 2: None, 3: None}


def test_confidence_band(spark):
    rows = [("m", float(t), 1) for t in range(1, 11)]
    for r in survival.km_confidence(fleet(spark, rows)).collect():
        assert r.lower <= r.survival <= r.upper
        if r.time == 3.0:
            s = 0.7
            v = sum(1 / (n * (n - 1)) for n in (10, 9, 8))
            assert r.lower == pytest.approx(s ** math.exp(-1.96 * math.sqrt(v) / math.log(s)))
            assert r.upper == pytest.approx(s ** math.exp(1.96 * math.sqrt(v) / math.log(s)))


def test_rul_estimates_and_defaults(spark):
    df = fleet(spark, [("m", 10.0, 1), ("m", 40.0, 1), ("x", 100.0, 0)])
    r = survival.rul_estimates(df).where("machineID = 0").first()
    assert (r.rul_median, r.survival_30d, r.survival_90d, r.current_survival_time) == (40.0, 0.667, 0.333, 10.0)
    empty = df.withColumn("event", F.lit(None).cast("int"))
    r = survival.rul_estimates(empty).first()
    assert (r.rul_median, r.survival_30d, r.survival_90d) == (100.0, 0.8, 0.6)


@pytest.mark.parametrize("fan_in", [0, 1 << 16])
def test_logrank_equals_loop(spark, monkeypatch, fan_in):
    monkeypatch.setattr(survival, "FAN_IN", fan_in)
    rows = sample(4)
    got = {(r.group_a, r.group_b): r for r in logrank_pairs(fleet(spark, rows)).collect()}
    groups = sorted({r[0] for r in rows})
    assert set(got) == {(a, b) for a in groups for b in groups if a < b}
    for (a, b), r in got.items():
        want = loop_logrank([x[1:] for x in rows if x[0] == a], [x[1:] for x in rows if x[0] == b])
        assert r.statistic == pytest.approx(want, rel=1e-9)
        assert r.p_value == pytest.approx(math.erfc(math.sqrt(want / 2)), rel=1e-9)
        assert r.significant == (r.p_value < 0.05)


def test_logrank_is_symmetric(spark):
    rows = sample(9, 60)
    swapped = [({"m1": "m2", "m2": "m1"}.get(g, g), t, e) for g, t, e in rows]
    pick = "group_a = 'm1' AND group_b = 'm2'"
    first, second = (logrank_pairs(fleet(spark, r)).where(pick).first().statistic for r in (rows, swapped))
    assert first == pytest.approx(second, rel=1e-9)


def test_chi2_tail(spark):
    df = spark.createDataFrame([(0.0,), (3.841458820694124,), (None,), (-1.0,)], "s double")
    p = [r.p for r in df.select(chi2_tail_1df("s").alias("p")).collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(0.05) and p[2] is None and p[3] is None


def efron(beta, x, t, e):
    """Log partial likelihood with Efron ties, by its definition."""
    eta = x @ beta
    w, total = np.exp(eta), 0.0
    for u in np.unique(t[e == 1]):
        risk, dead = w[t >= u].sum(), (t == u) & (e == 1)
        d = dead.sum()
        total += eta[dead].sum() - sum(np.log(risk - k / d * w[dead].sum()) for k in range(d))
    return total


def test_cox_maximises_the_partial_likelihood(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2)) * [3, 0.5] + [10, 0]
    t = np.ceil(rng.exponential(np.exp(-0.2 * (x[:, 0] - 10) + x[:, 1])) * 6)
    e = (rng.random(150) < 0.8).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d), 1.0) for a, b, (c, d) in zip(t, e, x)],
                               "time double, event int, a double, b double, constant double")
    fit = {r.feature: r for r in fit_cox(df).collect()}
    assert set(fit) == {"a", "b", "constant"} and fit["constant"].coef is fit["constant"].se is fit["constant"].p is None
    beta = np.array([fit["a"].coef, fit["b"].coef])
    best, h = efron(beta, x, t, e), 1e-4
    information = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            di, dj = np.eye(2)[i] * h, np.eye(2)[j] * h
            information[i, j] = -(efron(beta + di + dj, x, t, e) - efron(beta + di - dj, x, t, e)
                                  - efron(beta - di + dj, x, t, e) + efron(beta - di - dj, x, t, e)) / (4 * h * h)
        assert efron(beta + np.eye(2)[i] * 0.01, x, t, e) < best > efron(beta - np.eye(2)[i] * 0.01, x, t, e)
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    assert [fit["a"].se, fit["b"].se] == pytest.approx(list(errors), rel=1e-3)
    assert fit["a"].exp_coef == pytest.approx(math.exp(beta[0]))
    assert fit["a"].z == pytest.approx(beta[0] / fit["a"].se)


def test_cox_without_enough_data(spark):
    few = spark.createDataFrame([(1.0, 1, 2.0), (2.0, 1, 3.0)], "time double, event int, x double")
    assert fit_cox(few).count() == 0
    censored = spark.createDataFrame([(float(i), 0, float(i % 3)) for i in range(9)], "time double, event int, x double")
    assert fit_cox(censored).count() == 0


def test_cox_names_aliased_covariates(spark):
    """Covariates that others determine are aliased; the rest is fitted as if they were not there."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 2))
    t = np.ceil(rng.exponential(np.exp(0.5 * x[:, 0])) * 5)
    rows = [(float(u), int(i % 4 > 0), *map(float, v), float(3 * v[0] + 1), float(v[0] - 2 * v[1]), 7.0) for i, (u, v) in enumerate(zip(t, x))]
    df = spark.createDataFrame(rows, "time double, event int, a double, b double, copy double, mixed double, constant double")
    fit = {r.feature: r for r in fit_cox(df).collect()}
    assert list(fit) == ["a", "b", "copy", "mixed", "constant"]
    assert [f for f in fit if fit[f].coef is None].count("constant") == 1 and sum(r.coef is None for r in fit.values()) == 3
    kept = [f for f in fit if fit[f].coef is not None]
    again = {r.feature: r for r in fit_cox(df, kept).collect()}
    for f in kept:
        assert fit[f].coef == pytest.approx(again[f].coef, rel=1e-6) and fit[f].se == pytest.approx(again[f].se, rel=1e-6)


def test_independent_covariates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) @ np.array([[1, 0, 0, 1, 2], [0, 1, 0, 1, 0], [0, 0, 1, 0, 0]])
    assert independent(x.T @ x) in ([0, 1, 2], [1, 2, 3], [0, 2, 3], [2, 3, 4], [1, 2, 4])
    assert independent(np.zeros((2, 2))) == [] and independent(np.eye(2)) == [0, 1]
    assert independent(np.array([[1.0, 1.0], [1.0, 1.0 + 1e-15]])) == [0]


def test_cox_when_a_covariate_separates(spark):
    """The likelihood rises without end; the fit stops all the same."""
    df = spark.createDataFrame([(float(i + 1), 1, float(-i)) for i in range(12)], "time double, event int, x double")
    fitted = fit_cox(df).first()
    assert fitted.coef > 1


def test_cox_through_buckets_and_pieces_of_ties(spark, monkeypatch):
    """Many buckets, and failure times whose ties are dealt out in pieces, give the figures of one bucket."""
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 30)) if i % 3 else 12.0, int(i % 5 > 0), float(rng.normal()), float(rng.random())) for i in range(400)]
    df = spark.createDataFrame(rows, "time double, event int, a double, b double").repartition(5)
    read = lambda: [r.value for r in cox.partial_likelihood(df, {"a": 0.3, "b": -0.2}).collect()]
    whole = read()
    x, t, e = (np.array([r[2:] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert whole[0] == pytest.approx(efron(np.array([0.3, -0.2]), x, t, e))
    monkeypatch.setattr(cox, "BUCKET_TIMES", 3)
    monkeypatch.setattr(cox, "TIE_CHUNK", 7)
    monkeypatch.setattr(survival, "FAN_IN", 0)
    assert read() == pytest.approx(whole, rel=1e-9)


def test_scans_see_bounded_windows(spark):
    """Ten years of durations of one group: no level of the prefix tree has many more than 2^16 children in a window."""
    df = spark.range(300_000).select(F.lit("fleet").alias("group"), (F.col("id") * (3650 / 300_000) + F.rand(1) / 1e6).alias("time"))
    dense = spark.range(200_000).select(F.lit("fleet").alias("group"), (F.lit(400.0) + F.col("id") / 86_400_000_000).alias("time"))
    sizes = fan_in(survival.bucketed(df.union(dense)), ["group"], survival.PATH).collect()
    assert len(sizes) == 3 and all(r["rows"] <= 75_000 for r in sizes) and max(r["rows"] for r in sizes) >= 65_000


def test_as_of_equals_loop(spark):
    """Any time, in a hot group, before the first point, between points, on them, past the last; NULL group and time."""
    rng = random.Random(8)
    rows = sample(8, 300)
    df = fleet(spark, rows)
    curve = survival.km_curve(df)
    points = {}
    for r in curve.collect():
        points.setdefault(r.group, []).append((r.time, r.survival))
    asked = [(i, "m1" if i % 3 else rng.choice(["m2", "m3", "alone", None]), rng.choice([-1.0, 0.0, 3.0, 3.25, rng.uniform(-2, 60), None])) for i in range(400)]
    probes = spark.createDataFrame(asked, "machineID long, model string, at double").repartition(4)
    got = {r.machineID: r.survival_as_of for r in survival.add_survival_as_of(probes, curve, at="at").collect()}
    assert len(got) == len(asked)
    for i, g, t in asked:
        known = [p for p in points.get(g, []) if t is not None and p[0] <= t]
        assert got[i] == (max(known)[1] if known else None)
    assert survival.add_survival_as_of(probes.withColumn("survival_as_of", F.lit(5)), curve, at="at").columns == ["machineID", "model", "at", "survival_as_of"]


def test_logrank_of_many_groups(spark):
    """More groups than one block of partners holds; a sample of the pairs is recomputed."""
    rng = random.Random(2)
    rows = [(f"g{g}", float(rng.randint(1, 9)), int(rng.random() < 0.8)) for g in range(300) for _ in range(2)]
    got = {(r.group_a, r.group_b): r.statistic for r in logrank_pairs(fleet(spark, rows)).collect()}
    assert len(got) == 300 * 299 // 2
    for a, b in rng.sample(sorted(got), 200):
        want = loop_logrank([x[1:] for x in rows if x[0] == a], [x[1:] for x in rows if x[0] == b])
        assert got[a, b] == (pytest.approx(want, rel=1e-9) if want is not None else None)
