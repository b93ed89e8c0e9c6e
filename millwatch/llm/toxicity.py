"""Toxicity severity by cumulative-link ordinal regression.

The model is P(grade >= k) = logistic(w.x - t_k) for k = 1..3: one weight vector shared by all ordered
thresholds t_1 <= t_2 <= t_3. Features are sparse: the lower-cased letter words of a text and their leading
four and five letters, each as 1 + log(count).

Training rows: of every label the ``per_label`` rows that come first in the order of a hash of their id, so
at most 2 * ``per_label`` texts; all else covers every row. The features are those that occur in ``least`` training
texts and whose likelihood ratio between the labels (G-test of the 2x2 table of texts, sound for words that one label never
has) is as clear as ``SIGNIFICANT`` standard errors, the ``n_features`` clearest at most. Grades: 0 for clean texts; toxic texts are graded 1 to 3 by thirds of
how many of their words bear a feature that speaks for toxicity.

A text is toxic when P(grade >= 1) is a half or more; its severity is the expected grade, 0 to 3. NULL texts,
texts without letters and texts without a single feature have severity 0, as has everything if one label is missing. Labels without document or of NULL value are
ignored, of repeated labels the larger counts. Rows are never dropped; input columns other than id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, texts

GRADES = 3
PER_LABEL = 4000
N_FEATURES = 4096
LEAST = 5
SIGNIFICANT = 3.5
#: Letters stay (A-Z lower-cased, bytes above 127 too), all other ASCII becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Words a task remembers with their features; beyond, it starts anew.
MEMORY = 200_000


def features_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"-" for n in (4, 5) if len(word) > n)]


@dataclass
class Model:
    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, each: list[bytes | None]) -> np.ndarray:
        """[text, grade]: P(grade >= k) for k = 1..GRADES."""
        known, linear, any_ = {}, np.zeros(len(each)), np.zeros(len(each), dtype=bool)
        for k, t in enumerate(each):
            if len(known) > MEMORY:
                known.clear()
            counts: Counter[int] = Counter()
            for w in (t or b"").translate(FOLD).split():
                found = known.get(w)
                if found is None:
                    found = known[w] = tuple(self.features[f] for f in features_of(w) if f in self.features)
                if found:
                    counts.update(found)
            if counts:
                any_[k] = True
                linear[k] = self.weights[list(counts)] @ (1 + np.log(np.fromiter(counts.values(), dtype=float)))
        return np.where(any_[:, None], _logistic(linear[:, None] - self.thresholds), 0.0)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int, label: str) -> DataFrame:
    """(doc_id, label, text) of the training rows; the ids are 2 * per_label at most, hence broadcast."""
    of = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).alias("label"))
    first = lambda k: of.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    ids = stored(first(0).union(first(1)), "training-ids")
    return stored(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id"), "training")


def vocabulary(training: DataFrame, n_features: int, least: int) -> list[tuple[bytes, float]]:
    """(feature, log-odds) of the selected features; ``n_features`` rows reach the driver."""
    def count(batches):
        for batch in slices(batches, "text"):
            seen: Counter[tuple[bytes, int]] = Counter()
            for t, y in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                seen.update({(f, y) for w in set(t.translate(FOLD).split()) for f in features_of(w)})
            yield pa.RecordBatch.from_pylist([{"feature": f, "toxic": n * y, "clean": n * (1 - y)} for (f, y), n in seen.items()],
                                             schema=pa.schema([("feature", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    totals = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if len(totals) < 2:
        return []
    counts = training.select("text", "label").mapInArrow(count, "feature binary, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= least)
    rate = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    every = totals[0] + totals[1]
    having = F.col("toxic") + F.col("clean")

    def cell(seen, row, n):
        return F.when(seen > 0, seen * F.log(seen * F.lit(float(every)) / (row * F.lit(float(n))))).otherwise(0.0)

    ratio = (cell(F.col("toxic"), having, totals[1]) + cell(F.col("clean"), having, totals[0])
             + cell(totals[1] - F.col("toxic"), every - having, totals[1]) + cell(totals[0] - F.col("clean"), every - having, totals[0]))
    odds = counts.select("feature", (rate("toxic", totals[1]) - rate("clean", totals[0])).alias("odds"),
                         F.sqrt(2 * F.greatest(ratio, F.lit(0.0))).alias("z"))
    clear = odds.where(F.col("z") >= SIGNIFICANT)
    best = clear.orderBy(F.desc("z"), "feature").limit(n_features).collect()
    return [(bytes(r["feature"]), r["odds"]) for r in best]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL,
        n_features: int = N_FEATURES, least: int = LEAST) -> Model | None:
    """None if a label or every feature is missing."""
    training = sample(docs, labels, per_label, label)
    chosen = vocabulary(training, n_features, least)
    if not chosen:
        return None
    features = {f: k for k, (f, _) in enumerate(chosen)}
    speaks = np.array([o > 2 for _, o in chosen])

    def vectors(batches):
        for batch in slices(batches, "text"):
            ids, counts, evidence = [], [], []
            for t in texts(batch, "text"):
                n: Counter[int] = Counter()
                found = 0
                for w in t.translate(FOLD).split():
                    own = [features[f] for f in features_of(w) if f in features]
                    n.update(own)
                    found += any(speaks[f] for f in own)
                ids.append(list(n))
                counts.append(list(n.values()))
                evidence.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int32())), pa.array(evidence, pa.int64())],
                                             names=["doc_id", "label", "ids", "counts", "evidence"])

    rows = training.mapInArrow(vectors, "doc_id long, label long, ids array<int>, counts array<int>, evidence long").toPandas().sort_values(
        "doc_id", kind="stable")
    toxic = (rows["label"] == 1).to_numpy()
    evidence = rows["evidence"].to_numpy()
    third = np.quantile(evidence[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (evidence > third[0]) + (evidence > third[1]), 0)
    sizes = rows["ids"].map(len).to_numpy()
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["ids"]]) if sizes.sum() else np.zeros(0, np.int64)
    value = 1 + np.log(np.concatenate([np.asarray(x, dtype=float) for x in rows["counts"]])) if sizes.sum() else np.zeros(0)
    weights, thresholds = solve(row, column, value, grade, len(chosen))
    return Model(features, weights, thresholds)


def solve(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int,
          steps: int = 500, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the grades by full-batch gradient steps of adaptive size.

    The thresholds are t_1 plus positive gaps exp(g), so they stay ordered.
    """
    n = len(grade)
    theta = np.zeros(n_features + GRADES)
    theta[n_features:] = [1.0, *[0.0] * (GRADES - 1)]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[n_features + 1:])
        thresholds = theta[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        linear = np.bincount(row, weights=value * theta[column], minlength=n)
        above = np.column_stack((np.ones(n), _logistic(linear[:, None] - thresholds), np.zeros(n)))
        slope = above * (1 - above)
        at = np.arange(n)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        # d log p / d threshold_k, for the bound above and the bound below the grade
        by_threshold = np.zeros((n, GRADES + 2))
        by_threshold[at, grade] -= slope[at, grade] / p
        by_threshold[at, grade + 1] += slope[at, grade + 1] / p
        by_threshold = by_threshold[:, 1:-1]
        gradient = np.empty_like(theta)
        gradient[:n_features] = np.bincount(column, weights=value * -by_threshold.sum(axis=1)[row], minlength=n_features) / n - ridge * theta[:n_features]
        total = by_threshold.sum(axis=0) / n
        gradient[n_features] = total.sum()
        gradient[n_features + 1:] = [total[k + 1:].sum() * gaps[k] for k in range(GRADES - 1)]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n_features + 1:]))))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic): ``grade`` is the most likely one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in slices(batches, text):
            above = m.score(texts(batch, text)) if m else np.zeros((batch.num_rows, GRADES))
            each = np.column_stack((1 - above[:, 0], above[:, :-1] - above[:, 1:], above[:, -1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0]),
                 pa.array(above[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(score, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op9_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity_severity": op9_toxicity_severity}
ORACLES: dict[str, str] = {}
