"""Cox proportional hazards with Efron's handling of ties, fitted by Newton-Raphson.

The risk sets do not change while the coefficients do: every distinct time gets its rank once, ranks are cut into buckets, and
the rows are stored with their bucket. One evaluation is an aggregation by bucket, whose totals give the sums over all
later buckets, and one by time, whose buckets are then summed up independently of each other.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millwatch.functions.survival_stats import chi2_tail_1df
from millwatch.operators.scan import SUM
from millwatch.operators.survival import POOLED, bucketed, scan
from millwatch.session import materialise

SUMMARY = "feature string, coef double, exp_coef double, se double, z double, p double, " \
          "coef_lower_95 double, coef_upper_95 double"
Z_95 = 1.959963984540054
# Distinct times of one bucket, unless that made more buckets than the driver should add up per evaluation.
BUCKET_TIMES, MAX_BUCKETS = 1 << 12, 1 << 13
# Terms of one failure time that are laid out at once; a time with more failures is dealt out in such pieces.
TIE_CHUNK = 1 << 14
# A covariate is aliased when others explain all but this share of its information.
ALIASED = 1e-9
HALVINGS = 20


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def independent(information: np.ndarray, tolerance: float = ALIASED) -> list[int]:
    """Covariates that are no linear combination of others, by Cholesky factorisation with pivots.

    The next pivot is the covariate with the largest share of information left; of equal ones the first.
    """
    left, scale = information.astype(float).copy(), np.diag(information).copy()
    chosen: list[int] = []
    while len(chosen) < len(scale):
        share = np.where(scale > 0, np.diag(left) / np.where(scale > 0, scale, 1.0), 0.0)
        share[chosen] = 0.0
        pivot = int(np.argmax(share > share.max() * (1 - 1e-6)))
        if share[pivot] <= tolerance:
            break
        chosen.append(pivot)
        column = left[:, pivot] / math.sqrt(left[pivot, pivot])
        left -= np.outer(column, column)
    return sorted(chosen)


def fit_cox(df: DataFrame, features: Sequence[str] | None = None, time: str = "time",
            event: str = "event", max_iterations: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """Coefficient table, one row per feature; empty with fewer than three complete rows or without failures.

    A constant covariate, or one that others determine, is aliased: it is named with NULL figures. Iterations end when the
    likelihood gains less than ``tolerance`` of itself, or when no shorter step raises it; a step is halved at most
    ``HALVINGS`` times. Only totals of buckets and derivatives reach the driver.
    """
    spark = df.sparkSession
    if features is None:
        features = numeric_features(df, (time, event, "machineID", "model"))
    rows = df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
                     *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    profile = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == 1).alias("failed"),
                       *[F.avg(c).alias(f"m_{c}") for c in features],
                       *[F.stddev_samp(c).alias(f"s_{c}") for c in features]).first()
    varying = [c for c in features if (profile[f"s_{c}"] or 0.0) > 0.0]
    if profile["n"] < 3 or not profile["failed"] or not varying:
        return spark.createDataFrame([], SUMMARY)
    scaled = rows.select("time", "event", *[
        ((F.col(c) - profile[f"m_{c}"]) / profile[f"s_{c}"]).alias(f"x{i}") for i, c in enumerate(varying)])
    risk = risk_table(scaled)

    likelihood, gradient, information = _derivatives(risk, np.zeros(len(varying)))
    used = independent(information)
    pick = lambda found: (found[0], found[1][used], found[2][np.ix_(used, used)])
    beta = np.zeros(len(varying))
    _, gradient, information = pick((likelihood, gradient, information))
    for _ in range(max_iterations if used else 0):
        step = np.zeros(len(varying))
        step[used] = np.linalg.solve(information, gradient)
        for _ in range(HALVINGS):
            trial = pick(_derivatives(risk, beta + step))
            if math.isfinite(trial[0]) and trial[0] >= likelihood - tolerance * abs(likelihood):
                break
            step = step / 2
        else:
            break
        gain, beta = trial[0] - likelihood, beta + step
        likelihood, gradient, information = trial
        if gain <= tolerance * abs(likelihood) or len(independent(information)) < len(used):
            break
    errors = dict(zip(used, np.sqrt(np.diag(np.linalg.inv(information))), strict=True)) if used else {}
    table = []
    for c in features:
        i = varying.index(c) if c in varying else None
        known = i in errors
        table.append((c, float(beta[i] / profile[f"s_{c}"]) if known else None, float(errors[i] / profile[f"s_{c}"]) if known else None))
    fitted = spark.createDataFrame(table, "feature string, coef double, se double")
    z = F.col("coef") / F.col("se")
    return fitted.select(
        "feature", "coef", F.exp("coef").alias("exp_coef"), "se", z.alias("z"),
        chi2_tail_1df(z * z).alias("p"),
        (F.col("coef") - Z_95 * F.col("se")).alias("coef_lower_95"),
        (F.col("coef") + Z_95 * F.col("se")).alias("coef_upper_95"))


def partial_likelihood(df: DataFrame, coefficients: Mapping[str, float], time: str = "time", event: str = "event") -> DataFrame:
    """Rows ``(quantity, first, second, value)`` at the given coefficients of the raw features.

    Quantities: log partial likelihood, gradient by feature, and observed information by pair of features.
    """
    names = list(coefficients)
    rows = df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    likelihood, gradient, information = _derivatives(risk_table(rows), np.array([float(coefficients[c]) for c in names]))
    out = [("likelihood", None, None, float(likelihood))]
    out += [("gradient", c, None, float(g)) for c, g in zip(names, gradient)]
    out += [("information", a, b, float(information[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.sparkSession.createDataFrame(out, "quantity string, first string, second string, value double")


def risk_table(rows: DataFrame) -> DataFrame:
    """``rows`` (time, event, x0, x1, ...) stored with the bucket of their time; later times have higher buckets."""
    rows = materialise(rows, "cox_rows")
    times = rows.select("time").distinct().select(F.lit(POOLED).alias("group"), "time", F.lit(1).cast("long").alias("one"))
    ranked = materialise(scan(bucketed(times, rows.count()), {"rank": ("one", SUM)}).select("time", "rank"), "cox_times")
    count = ranked.count()
    size = max(BUCKET_TIMES, -(-count // MAX_BUCKETS))
    return materialise(rows.join(ranked, "time").withColumn("bucket", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank"), "cox")


def _predictor(beta: np.ndarray) -> Column:
    # An array literal keeps the generated code identical, and so compiled once, for all iterations.
    weights = F.lit([float(b) for b in beta])
    return sum((F.col(f"x{i}") * F.get(weights, F.lit(i)) for i in range(1, len(beta))), F.col("x0") * F.get(weights, F.lit(0)))


def _derivatives(risk: DataFrame, beta: np.ndarray):
    """Log partial likelihood, its gradient and the observed information at ``beta``."""
    p = len(beta)
    x = [F.col(f"x{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    weighed = risk.withColumn("eta", _predictor(beta)).withColumn("w", F.exp("eta"))
    moments = [F.col("w"), *[F.col("w") * v for v in x], *[F.col("w") * x[i] * x[j] for i, j in pairs]]
    failed = F.col("event") == 1

    totals = {r["bucket"]: r["r"] for r in weighed.groupBy("bucket").agg(F.array(*[F.sum(m) for m in moments]).alias("r")).collect()}
    later, behind = {}, np.zeros(len(moments))
    for bucket in sorted(totals, reverse=True):
        later[bucket] = behind
        behind = behind + np.array(totals[bucket])

    per_time = weighed.groupBy("bucket", "time").agg(
        F.count_if(failed).alias("d"), F.array(*[F.coalesce(F.sum(F.when(failed, m)), F.lit(0.0)) for m in (F.col("eta"), *x)]).alias("seen"),
        F.array(*[F.sum(m) for m in moments]).alias("r"),
        F.array(*[F.coalesce(F.sum(F.when(failed, m)), F.lit(0.0)) for m in moments]).alias("f"))
    pieces = per_time.groupBy("bucket").applyInArrow(_risk_sets(later, p), PIECE)
    summed = pieces.repartition("bucket", "start").mapInArrow(_tie_terms(p), "sums array<double>")
    found = {r["pos"]: r["value"] for r in summed.select(F.posexplode("sums").alias("pos", "value")).groupBy("pos").agg(F.sum("value").alias("value")).collect()}
    if not found:
        return -math.inf, np.zeros(p), np.zeros((p, p))
    values = np.array([found[k] for k in range(len(moments))])
    information = np.zeros((p, p))
    for (i, j), value in zip(pairs, values[1 + p:], strict=True):
        information[i, j] = information[j, i] = value
    return float(values[0]), values[1:1 + p], information


PIECE = "bucket int, start long, stop long, d long, s array<double>, f array<double>, sums array<double>"


def _terms(share: np.ndarray, s: np.ndarray, f: np.ndarray, p: int) -> np.ndarray:
    """Sums over Efron's terms, one per row: what they take from the likelihood and gradient and give to the information."""
    left = s - share[:, None] * f
    mean = left[:, 1:1 + p] / left[:, :1]
    rows, columns = np.triu_indices(p)
    second = left[:, 1 + p:] / left[:, :1] - mean[:, rows] * mean[:, columns]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.concatenate([[-np.log(left[:, 0]).sum()], -mean.sum(axis=0), second.sum(axis=0)])


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _risk_sets(later: dict, p: int):
    """Per bucket: the sums of its small ties, and pieces of the large ones."""
    schema = pa.schema([("bucket", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("d", pa.int64()),
                        *[(c, pa.list_(pa.float64())) for c in ("s", "f", "sums")]])

    def sets(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        group = group.sort_by([("time", "descending")])
        d, f = group.column("d").to_numpy(), _matrix(group.column("f"))
        s = np.cumsum(_matrix(group.column("r")), axis=0) + later[bucket]
        dead = d > 0
        if not dead.any():
            return schema.empty_table()
        sums = np.zeros(s.shape[1])
        sums[:1 + p] = _matrix(group.column("seen"))[dead].sum(axis=0)
        small = np.flatnonzero(dead & (d <= TIE_CHUNK))
        for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(d[small]) // TIE_CHUNK)) + 1) if len(small) else []:
            at = np.repeat(part, d[part])
            tie = np.arange(len(at)) - np.repeat(np.cumsum(d[part]) - d[part], d[part])
            sums += _terms(tie / d[at], s[at], f[at], p)
        out = [(bucket, -1, -1, 0, None, None, sums.tolist())]
        for k in np.flatnonzero(d > TIE_CHUNK).tolist():
            out += [(bucket, i, min(i + TIE_CHUNK, int(d[k])), int(d[k]), s[k].tolist(), f[k].tolist(), None) for i in range(0, int(d[k]), TIE_CHUNK)]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), schema, strict=True)], schema=schema)

    return sets


def _tie_terms(p: int):
    def add(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sums = row["sums"]
                if sums is None:
                    tie = np.arange(row["start"], row["stop"])
                    sums = _terms(tie / row["d"], np.array([row["s"]]), np.array([row["f"]]), p).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["sums"])
    return add
