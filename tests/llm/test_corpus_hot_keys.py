"""Large keys split into blocks, and the severity fit against an independent likelihood."""

import random

import numpy as np
import pytest

from millwatch.llm import common, lines, minhash, toxicity


def test_every_pair_of_a_key_meets_once(spark):
    rows = spark.createDataFrame([(k % 3 if k < 40 else 9, k) for k in range(300)], "key long, id long")
    every, one = common.dealt(rows, block=16)
    x, y = every.alias("x"), one.alias("y")
    from pyspark.sql import functions as F
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block"))).select("x.id", F.col("y.id").alias("other"))
    pairs = [tuple(r) for r in met.collect()]
    assert len(pairs) == len(set(pairs)) == 260 * 260 + sum(n * n for n in (14, 13, 13))
    assert one.where("key = 9").groupBy("block").count().count() == 17


def test_results_do_not_depend_on_the_blocks(spark, docs, monkeypatch):
    r = random.Random(6)
    opening = " ".join(f"open{i}" for i in range(12))
    rows = [(i, opening + " " + " ".join(f"w{r.randrange(9)}" for _ in range(r.randint(1, 9))) + f"\n{opening} line{i % 20:02d}" * 2) for i in range(90)]
    frame = docs(rows)
    near = lambda: sorted(map(str, minhash.near_duplicates(frame).collect()))
    dedup = lambda: sorted(map(str, lines.deduplicate(frame).collect()))
    want = near(), dedup()
    monkeypatch.setattr(minhash, "KEY_BLOCK", 4)
    monkeypatch.setattr(lines, "KEY_BLOCK", 4)
    assert (near(), dedup()) == want


def likelihood(row, column, value, grade, weights, thresholds, ridge):
    """Mean log likelihood of a cumulative logit model with a ridge, by its definition."""
    n = len(grade)
    linear = np.zeros(n)
    for r, c, v in zip(row, column, value):
        linear[r] += v * weights[c]
    above = lambda k: 1.0 if k == 0 else 0.0 if k > len(thresholds) else 1 / (1 + np.exp(thresholds[k - 1] - linear[i]))
    total = 0.0
    for i in range(n):
        total += np.log(above(grade[i]) - above(grade[i] + 1))
    return total / n - ridge / 2 * (np.asarray(weights) ** 2).sum()


def test_severity_fit_maximises_the_likelihood():
    rng = np.random.default_rng(3)
    n, p = 250, 3
    x = rng.random((n, p)) * (rng.random((n, p)) < 0.7)
    latent = x @ [2.0, -1.5, 0.5] + rng.logistic(size=n)
    grade = np.digitize(latent, [0.2, 1.2, 2.2])
    row, column = np.nonzero(x)
    value = x[row, column]
    weights, thresholds = toxicity.solve(row, column, value, grade, p, steps=3000, rate=0.02)
    assert (np.diff(thresholds) > 0).all()
    best = likelihood(row, column, value, grade, weights, thresholds, 1e-4)
    for k in range(p):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += step
            assert likelihood(row, column, value, grade, moved, thresholds, 1e-4) < best
    for k in range(len(thresholds)):
        for step in (-0.03, 0.03):
            moved = thresholds.copy()
            moved[k] += step
            assert likelihood(row, column, value, grade, weights, moved, 1e-4) < best
    slopes = [(likelihood(row, column, value, grade, weights + d, thresholds, 1e-4) - likelihood(row, column, value, grade, weights - d, thresholds, 1e-4)) / 2e-5
              for d in np.eye(p) * 1e-5]
    assert slopes == pytest.approx([0, 0, 0], abs=2e-3)
