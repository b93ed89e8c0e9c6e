"""Failure classifier, remaining-life regressor, risk classifier and failure-pattern clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from millwatch import config
from millwatch.config import TRAINING, Training
from millwatch.operators import forest
from millwatch.operators.metrics import classification_report, regression_metrics, roc_auc
from millwatch.operators.split import random_split, stratified_split
from millwatch.session import materialise

# A forest needs a limit here; it stands in the metrics. Deeper trees cost one more pass over the rows per level.
DEFAULT_DEPTH = 10

# Hyper-parameter grids. Depth 30 is Spark's limit and stands for "unlimited".
CLASSIFIER_GRID = {"numTrees": (100, 200), "maxDepth": (10, 20, 30), "minInstancesPerNode": (1, 2), "minSamplesSplit": (2, 5)}
REGRESSOR_GRID = {"numTrees": (100, 200), "maxDepth": (10, 20, 30), "minSamplesSplit": (2, 5)}


GRID_LABELS = {"trees": "numTrees", "depth": "maxDepth", "leaf": "minInstancesPerNode", "split": "minSamplesSplit"}


@dataclass(frozen=True)
class Trained:
    """A fitted model; the hold-out is scored and measured, and a searched model put together, only when they are asked for."""

    name: str
    _model: Callable[[], PipelineModel]
    importance: DataFrame
    _tested: DataFrame
    _measure: Callable[[DataFrame], DataFrame]
    features: Sequence[str] = ()
    #: Settings that a grid search chose, and the score of every combination.
    chosen: dict | None = None
    scores: DataFrame | None = None

    @cached_property
    def model(self) -> PipelineModel:
        return self._model()

    @cached_property
    def predictions(self) -> DataFrame:
        return materialise(self._tested, f"{self.name}_test")

    @cached_property
    def metrics(self) -> DataFrame:
        """Rows ``(model, metric, label, value)``, the depth limit of the forest among them.

        After a grid search also the other settings it chose, and a row ``cv_score`` per combination, labelled with its settings.
        """
        if not self.chosen:
            limits = {"max_depth": self.model.stages[-1].getMaxDepth()}
        else:
            limits = {"max_depth": self.chosen["maxDepth"], "n_estimators": self.chosen["numTrees"],
                      "min_samples_leaf": self.chosen["minInstancesPerNode"], "min_samples_split": self.chosen["minSamplesSplit"]}
        limit = self._tested.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in limits.items()])
        rows = self._measure(self.predictions).unionByName(_long(limit, self.name))
        if self.scores is None:
            return rows
        return rows.unionByName(self.scores.select(
            F.lit(self.name).alias("model"), F.lit("cv_score").alias("metric"), F.concat_ws(
                " ", *[F.concat(F.lit(f"{short}="), F.col(c).cast("string")) for short, c in GRID_LABELS.items()]).alias("label"),
            F.col("score").alias("value")))


def optimal_features(df: DataFrame) -> list[str]:
    return [c for c in (*config.SCORING_FEATURES, *config.EXTRA_FEATURES) if c in df.columns]


def feature_stages(features: Sequence[str], prefix: str = "_x_", output: str = "features") -> list:
    """Pipeline stages that read raw columns: missing values become 0, then one vector.

    They are part of the saved model, so scoring can never use another feature list.
    """
    filled = ", ".join(f"coalesce(cast(`{c}` AS double), 0D) AS `{prefix}{c}`" for c in features)
    return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{prefix}{c}" for c in features], outputCol=output)]


def _importance(fitted: PipelineModel | DataFrame, name: str, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Of a model, or of the nodes of a forest."""
    if isinstance(fitted, DataFrame):
        return forest.importances(fitted, features).select(F.lit(name).alias("model"), "feature", "importance")
    weights = fitted.stages[-1].featureImportances.toArray()
    rows = [(name, f, float(w)) for f, w in zip(features, weights)]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance double")


def _long(df: DataFrame, model: str, label_column: str | None = None) -> DataFrame:
    """Metric columns to rows ``(model, metric, label, value)``."""
    names = [c for c in df.columns if c != label_column]
    label = F.col(label_column) if label_column else F.lit(None).cast("string")
    return df.select(F.lit(model).alias("model"), label.alias("label"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("e")
    ).select("model", "e.metric", "label", "e.value")


def _search(train: DataFrame, features: Sequence[str], target: str, grid: dict, fit: Callable[..., PipelineModel], positive: bool,
            settings: Training, parallelism: int) -> tuple[Callable[[], PipelineModel], DataFrame, dict, DataFrame]:
    """The best combination of the grid (the first one of equal scores: fewer trees, then depth, leaf and split size), grown on all rows.

    Returns what puts the model together, the nodes, the combination and all scores.
    """
    classes = 0
    if positive:
        label = F.col(target).cast("double")
        known = train.agg(F.max(label).alias("most"), F.count_if((label < 0) | (label != F.floor(label))).alias("odd")).first()
        if known["odd"]:
            raise ValueError(f"{target!r} holds labels that are not whole numbers from 0 on")
        classes = int(known["most"] or 0) + 1
    grower = forest.Grower(features, target, classes, settings.seed)
    scores = forest.search(train, features, target, grid, grower, positive, settings.folds, settings.seed, parallelism)
    order = list(GRID_LABELS.values())
    rank = F.desc(F.round("score", 9)) if positive else F.asc(F.round("score", 9))
    chosen = scores.orderBy(rank, *order).select(*order).first().asDict()
    nodes = grower.nodes(train, *[chosen[k] for k in order])

    def model() -> PipelineModel:
        *stages, roots = fit(train, chosen["numTrees"], 0, chosen["minInstancesPerNode"]).stages
        return PipelineModel(stages=[*stages, forest.as_model(nodes, roots, chosen["maxDepth"])])

    return model, nodes, chosen, scores


def _walked(rows: DataFrame, nodes: DataFrame, features: Sequence[str], chosen: dict, value: str, name: str) -> DataFrame:
    """``rows`` with what the chosen forest says."""
    return forest.predictions(rows, nodes, features, {name: (chosen["numTrees"], chosen["maxDepth"], chosen["minSamplesSplit"])}, value)


def _walked_labels(rows: DataFrame, nodes: DataFrame, features: Sequence[str], chosen: dict) -> DataFrame:
    """``rows`` with the class that has the largest share, the lowest of equal ones, and the share of class 1."""
    classes = nodes.agg(F.max(F.size("stats"))).first()[0]
    for k in range(1, classes):
        rows = _walked(rows, nodes, features, chosen, f"class:{k}", f"_p{k}")
    others = [F.col(f"_p{k}") for k in range(1, classes)]
    shares = F.array(sum((-p for p in others), F.lit(1.0)), *others)
    return rows.withColumns({"prediction": F.array_position(shares, F.array_max(shares)) - 1, "score": F.coalesce(F.get(shares, F.lit(1)), F.lit(0.0))})


def _sizes(split: DataFrame, model: str) -> DataFrame:
    counted = split.agg(F.count_if(~F.col("is_test")).alias("n_samples_train"),
                        F.count_if(F.col("is_test")).alias("n_samples_test"))
    return _long(counted, model)


def train_classifier(df: DataFrame, features: Sequence[str] | None = None, target: str = "event",
                     test_fraction: float | None = None, grid: dict | None = None, settings: Training = TRAINING,
                     depth: int = DEFAULT_DEPTH, parallelism: int = 4) -> Trained:
    """Random forest for the failure flag, evaluated on a stratified hold-out.

    ``grid`` (for example ``CLASSIFIER_GRID``) switches cross-validated search on F1 of the failed class on.
    """
    features = list(features or optimal_features(df))
    rows = stratified_split(df.select("machineID", target, *[c for c in features if c not in ("machineID", target)]),
                            target, test_fraction or settings.test_fraction, seed=settings.seed)
    rows = materialise(rows, "classifier_rows")
    train = rows.where(~F.col("is_test"))

    def fit(part: DataFrame, trees: int, deepest: int, leaf: int = 1) -> PipelineModel:
        grower = RandomForestClassifier(labelCol=target, numTrees=trees, maxDepth=deepest, minInstancesPerNode=leaf, seed=settings.seed, cacheNodeIds=True)
        return Pipeline(stages=[*feature_stages(features), grower]).fit(part)

    chosen = scores = None
    if grid:
        model, fitted, chosen, scores = _search(train, features, target, grid, fit, True, settings, parallelism)
        tested = _walked_labels(rows.where("is_test"), fitted, features, chosen)
    else:
        fitted = fit(train, settings.trees, depth)
        model, tested = lambda: fitted, fitted.transform(rows.where("is_test")).withColumn("score", _positive_probability())
    tested = tested.select("machineID", F.col(target).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "score")

    def measure(scored: DataFrame) -> DataFrame:
        return (_long(classification_report(scored), "classifier", "scope")
                .unionByName(_long(roc_auc(scored), "classifier")).unionByName(_sizes(rows, "classifier")))

    return Trained("classifier", model, _importance(fitted, "classifier", features, df), tested, measure, features, chosen, scores)


def _positive_probability():
    """Probability of class 1; a model that never saw class 1 gives 0."""
    return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))


def train_regressor(df: DataFrame, features: Sequence[str] | None = None, target: str = "time",
                    test_fraction: float | None = None, grid: dict | None = None, settings: Training = TRAINING,
                    depth: int = DEFAULT_DEPTH, parallelism: int = 4) -> Trained:
    """Random forest for the remaining life, evaluated on a random hold-out."""
    features = list(features or optimal_features(df))
    needed = [c for c in features if c not in ("machineID", target)]
    rows = random_split(df.select("machineID", target, *needed).where(F.col(target).isNotNull()),
                        test_fraction or settings.test_fraction, seed=settings.seed)
    rows = materialise(rows, "regressor_rows")
    train = rows.where(~F.col("is_test"))

    def fit(part: DataFrame, trees: int, deepest: int, leaf: int = 1) -> PipelineModel:
        grower = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=deepest, minInstancesPerNode=leaf, seed=settings.seed, cacheNodeIds=True)
        return Pipeline(stages=[*feature_stages(features), grower]).fit(part)

    chosen = scores = None
    if grid:
        model, fitted, chosen, scores = _search(train, features, target, grid, fit, False, settings, parallelism)
        tested = _walked(rows.where("is_test"), fitted, features, chosen, "prediction", "prediction")
    else:
        fitted = fit(train, settings.trees, depth)
        model, tested = lambda: fitted, fitted.transform(rows.where("is_test"))
    tested = tested.select("machineID", F.col(target).alias("label"), "prediction")

    def measure(scored: DataFrame) -> DataFrame:
        return _long(regression_metrics(scored), "regressor").unionByName(_sizes(rows, "regressor"))

    return Trained("regressor", model, _importance(fitted, "regressor", features, df), tested, measure, features, chosen, scores)


def performance_summary(trained: Sequence[Trained]) -> DataFrame:
    """Metrics and feature importances of several models as ``(model, metric, label, value)``."""
    out = None
    for item in trained:
        weights = item.importance.select("model", F.lit("feature_importance").alias("metric"),
                                         F.col("feature").alias("label"), F.col("importance").alias("value"))
        both = item.metrics.unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return out


def top_features(importance: DataFrame, count: int = 5) -> DataFrame:
    """Most important features of each model."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("position", F.row_number().over(order)).where(F.col("position") <= count)


def score_fleet(df: DataFrame, classifier: PipelineModel | None = None,
                regressor: PipelineModel | None = None) -> DataFrame:
    """Add ``pred_proba`` and/or ``pred_rul`` (at least one day) from the saved models."""
    out, kept = df, list(df.columns)
    if classifier is not None:
        out = classifier.transform(out).withColumn("pred_proba", _positive_probability())
        kept.append("pred_proba")
        out = out.select(*kept)
    if regressor is not None:
        out = regressor.transform(out).withColumn("pred_rul", F.greatest(F.lit(1.0), F.col("prediction")))
        kept.append("pred_rul")
        out = out.select(*kept)
    return out


def train_risk_classifier(df: DataFrame, label: str = "risk_level", settings: Training = TRAINING,
                          depth: int = DEFAULT_DEPTH) -> PipelineModel:
    """Forest that learns the heuristic risk level from the four scoring features, on every row."""
    indexer = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(df)
    grower = RandomForestClassifier(labelCol="_label", numTrees=settings.risk_trees, maxDepth=depth, seed=settings.seed, cacheNodeIds=True)
    names = IndexToString(inputCol="prediction", outputCol="predicted_level", labels=indexer.labels)
    trainer = Pipeline(stages=[*feature_stages(config.SCORING_FEATURES), grower])
    fitted = trainer.fit(indexer.transform(df))
    return PipelineModel(stages=[*fitted.stages, names])


def predict_risk(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Fleet with predicted ``risk_level``, its ``confidence`` and the probability of every level."""
    labels = F.array(*[F.lit(name) for name in model.stages[-1].getLabels()])
    scored = model.transform(df.drop("risk_level")).withColumn("_p", vector_to_array("probability"))
    return scored.withColumns({
        "risk_level": F.col("predicted_level"), "confidence": F.array_max("_p"),
        "probabilities": F.map_from_arrays(labels, F.col("_p"))}).select(
        *[c for c in df.columns if c != "risk_level"], "risk_level", "confidence", "probabilities")


def standardise(df: DataFrame, columns: Sequence[str] = config.CLUSTER_FEATURES) -> DataFrame:
    """Add ``<column>_z`` = (x - mean) / population deviation; a constant column gives 0."""
    filled = df.na.fill(0, list(columns))
    stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return filled.withColumns({
        f"{c}_z": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def train_failure_patterns(df: DataFrame, settings: Training = TRAINING) -> PipelineModel:
    """K-means on three standardised readings; two or three clusters depending on fleet size. Iterations end when no centre moves."""
    clusters = max(2, min(settings.max_clusters, df.count() // 10))
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
    kmeans = KMeans(featuresCol="_scaled", predictionCol="failure_pattern", k=clusters, seed=settings.seed, maxIter=300, tol=1e-12)
    return Pipeline(stages=[*feature_stages(config.CLUSTER_FEATURES, "_c_", "_raw"), scaler, kmeans]).fit(df)


def pattern_certificate(df: DataFrame, model: PipelineModel) -> DataFrame:
    """(pattern, machines, nearest, off_centre): of every cluster its rows, those nearest to its centre, and how far their mean is from it.

    Distances are recomputed from the standardised readings by expressions; a stationary clustering has all rows nearest and no offset.
    """
    centres = [[float(v) for v in c] for c in model.stages[-1].clusterCenters()]
    z = vector_to_array("_scaled").cast("array<double>")
    rows = model.transform(df).select("failure_pattern", z.alias("z"))
    square = lambda c: sum(((F.get("z", F.lit(i)) - v) * (F.get("z", F.lit(i)) - v) for i, v in enumerate(c)), F.lit(0.0))
    distances = F.array(*[square(c) for c in centres])
    own = F.get(distances, F.col("failure_pattern")) <= F.array_min(distances) + 1e-12
    means = [F.avg(F.get("z", F.lit(i))) for i in range(len(centres[0]))]
    at = lambda i: F.get(F.get(F.lit(centres), F.col("failure_pattern")), F.lit(i))
    grouped = rows.groupBy("failure_pattern").agg(F.count(F.lit(1)).alias("machines"), F.count_if(own).alias("nearest"),
                                                  *[m.alias(f"m{i}") for i, m in enumerate(means)])
    off = F.greatest(*[F.abs(F.col(f"m{i}") - at(i)) for i in range(len(means))])
    return grouped.select(F.col("failure_pattern").alias("pattern"), "machines", "nearest", off.alias("off_centre"))


def assign_failure_patterns(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).select(*df.columns, "failure_pattern")
