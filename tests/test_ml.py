"""Splits, metrics, training, persistence and scoring."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from millwatch.config import Training
from millwatch.operators import features, forest, metrics, ml, reports, split
from millwatch.plans import catalogue, jobs
from millwatch.sources import sinks

QUICK = Training(trees=8, folds=2)


@pytest.fixture(scope="module")
def fleet(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        vibration = float(rng.uniform(35, 50))
        rows.append((i, f"model{i % 4 + 1}", int(rng.integers(0, 20)), float(max(0.5, 120 - 2.2 * vibration + rng.normal())),
                     int(vibration > 41), 170.0, 450.0, float(rng.normal(100, 3)), vibration, int(rng.integers(0, 50)), 20))
    df = spark.createDataFrame(rows, "machineID long, model string, age int, time double, event int, volt double, "
                                     "rotate double, pressure double, vibration double, error_count long, maint_count long")
    return features.health_features(df).cache()


def test_stratified_split_is_exact_and_stable(spark, fleet):
    sides = split.stratified_split(fleet)
    for r in sides.groupBy("event").agg(F.count_if("is_test").alias("test"), F.count("*").alias("n")).collect():
        assert r.test == round(r.n * 0.2)
    again = split.stratified_split(fleet.repartition(7, "age"))
    key = lambda df: sorted((r.machineID, r.is_test) for r in df.collect())
    assert key(sides) == key(again)


def test_random_split(spark):
    df = split.random_split(spark.range(20_000).withColumnRenamed("id", "machineID"))
    share = df.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert share == pytest.approx(0.2, abs=0.01)
    other = split.random_split(spark.range(20_000).withColumnRenamed("id", "machineID"), seed=1)
    assert df.join(other.withColumnRenamed("is_test", "b"), "machineID").where("is_test <> b").count() > 1000


@pytest.mark.parametrize("low, high", [(0, 1), (-1000, 1000), (0, 1e-9)])
def test_auc_counts_all_pairs(spark, low, high):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.4), low + (high - low) * round(float(rng.random()), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    wins = [(p > n) + 0.5 * (p == n) for y, p in rows if y for z, n in rows if not z]
    assert metrics.roc_auc(df).first().auc_roc == pytest.approx(np.mean(wins))
    assert metrics.roc_auc(df.where("label = 1")).first().auc_roc is None


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 3 + [(2, 0)], "label int, prediction int")
    rows = {r.scope: r for r in metrics.classification_report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].support) == (pytest.approx(6 / 7), 0.75, 8)
    assert (rows["2"].precision, rows["2"].recall, rows["2"].f1, rows["2"].support) == (0, 0, 0, 1)
    assert rows["accuracy"].f1 == pytest.approx(9 / 13) and rows["macro avg"].recall == pytest.approx((0.75 + 0.75 + 0) / 3)
    assert rows["weighted avg"].precision == pytest.approx((6 / 7 * 8 + 0.5 * 4) / 13)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 1.0)], "label double, prediction double")
    r = metrics.regression_metrics(df).first()
    assert (r.mae, r.rmse, r.r2) == (pytest.approx(5 / 3), pytest.approx((17 / 3) ** 0.5), pytest.approx(1 - 17 / 8))
    assert metrics.regression_metrics(df.limit(1)).first().r2 is None


def test_features_are_chosen_from_what_exists(fleet):
    assert ml.optimal_features(fleet) == ["global_health_score", "vibration", "error_count", "degradation_rate",
                                          "pressure", "volt", "rotate", "age", "maint_count", "risk_factor"]
    assert ml.optimal_features(fleet.select("vibration", "age")) == ["vibration", "age"]


def test_train_save_load_score(spark, fleet, tmp_path):
    clf = ml.train_classifier(fleet, settings=QUICK)
    reg = ml.train_regressor(fleet, settings=QUICK)
    summary = {(r.model, r.metric, r.label): r.value for r in ml.performance_summary([clf, reg]).collect()}
    assert summary[("classifier", "auc_roc", None)] > 0.95
    assert summary[("regressor", "r2", None)] > 0.8
    assert summary[("classifier", "n_samples_train", None)] + summary[("classifier", "n_samples_test", None)] == 300
    assert sum(v for (m, k, _), v in summary.items() if m == "regressor" and k == "feature_importance") == pytest.approx(1)

    folder = str(tmp_path / "models")
    sinks.save_models({"classifier": clf.model, "regressor": reg.model}, folder)
    loaded = sinks.load_models(spark, ("classifier", "regressor", "absent"), folder)
    assert set(loaded) == {"classifier", "regressor"}
    gappy = fleet.withColumn("vibration", F.when(F.col("machineID") > 5, F.col("vibration")))
    scored = ml.score_fleet(gappy, loaded["classifier"], loaded["regressor"])
    assert scored.count() == 300 and scored.columns == [*fleet.columns, "pred_proba", "pred_rul"]
    low = scored.agg(F.min("pred_rul"), F.min("pred_proba"), F.max("pred_proba")).first()
    assert low[0] >= 1 and 0 <= low[1] <= low[2] <= 1
    same = ml.score_fleet(fleet, clf.model).join(ml.score_fleet(fleet, loaded["classifier"]).select(
        "machineID", F.col("pred_proba").alias("other")), "machineID")
    assert same.where("pred_proba <> other").count() == 0


def walk(nodes, x, depth, split):
    """The end node of a row in one tree {number: node row}, by a loop."""
    k = 0
    while nodes[k].left >= 0 and nodes[k].depth < depth and nodes[k].n >= split:
        k = nodes[k].left if x[nodes[k].feature] <= nodes[k].threshold else nodes[k].right
    return nodes[k]


LIMITS = {"whole": (8, 30, 2), "flat": (8, 2, 2), "few": (3, 30, 2), "wide": (8, 30, 40), "both": (5, 3, 25)}


def test_pruned_predictions_equal_a_loop(spark, fleet):
    gappy = fleet.withColumn("vibration", F.when(F.col("machineID") % 7 > 0, F.col("vibration")))
    names = ["vibration", "pressure", "age", "error_count"]
    for trained, value in ((ml.train_classifier(gappy, names, settings=QUICK), "class:1"), (ml.train_regressor(gappy, names, settings=QUICK), "prediction")):
        nodes = forest.node_table(spark, trained.model.stages[-1])
        trees = {}
        for r in nodes.collect():
            trees.setdefault(r.tree, {})[r.node] = r
        assert len(trees) == 8 and all(t[0].parent is None and t[0].depth == 0 for t in trees.values())
        assert all(t[k].depth == t[t[k].parent].depth + 1 for t in trees.values() for k in t if k)
        got = forest.predictions(gappy, nodes, names, LIMITS, value).collect()
        assert len(got) == 300
        for r in got:
            x = [float(r[c] or 0) for c in names]
            for name, (count, depth, split) in LIMITS.items():
                ends = [walk(trees[t], x, depth, split) for t in range(count)]
                want = np.mean([e.stats[1] / sum(e.stats) if value == "class:1" else e.prediction for e in ends])
                assert r[name] == pytest.approx(want, abs=1e-12)


def test_walks_meet_blocks_of_rows_and_trees(spark, fleet, monkeypatch, plan_of):
    """Small blocks give the same means, rows that repeat stay, and no tree is carried along by a row or sent to all tasks."""
    names = ["vibration", "pressure", "age", "error_count"]
    trained = ml.train_regressor(fleet, names, settings=QUICK)
    nodes = forest.node_table(spark, trained.model.stages[-1])
    rows = fleet.unionByName(fleet.where("machineID < 20"))
    whole = forest.predictions(rows, nodes, names, LIMITS, "prediction")
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(forest, "BLOCK_NODES", 100)
    dealt = forest.predictions(rows, nodes, names, LIMITS, "prediction")
    plan = plan_of(dealt, "simple")
    assert "FlatMapCoGroupsInArrow" in plan and "_tree" not in plan and "BroadcastHashJoin" not in plan.split("FlatMapCoGroupsInArrow", 1)[1]
    key = lambda df: sorted((r.machineID, *[round(r[c], 9) for c in LIMITS]) for r in df.collect())
    assert key(whole) == key(dealt) and dealt.count() == 320


def test_forests_do_not_ship_their_trees(fleet, monkeypatch):
    """Rows keep their node, so that a level does not send all trees grown so far to the tasks."""
    made = []
    for name in ("RandomForestClassifier", "RandomForestRegressor"):
        grower = getattr(ml, name)
        monkeypatch.setattr(ml, name, lambda _grower=grower, **kw: made.append(_grower(**kw)) or made[-1])
    ml.train_classifier(fleet, settings=QUICK)
    ml.train_regressor(fleet, settings=QUICK)
    ml.train_risk_classifier(fleet, settings=Training(risk_trees=2))
    assert len(made) == 3 and all(m.getCacheNodeIds() for m in made)


def test_a_cut_tree_is_a_tree_grown_to_that_depth(spark, fleet):
    """With all features at every node, a deep forest cut at a depth equals the forest grown to that depth."""
    names = ["vibration", "pressure", "age", "error_count"]
    rows = fleet.select("time", *names)

    def grown(depth):
        grower = RandomForestRegressor(labelCol="time", numTrees=6, maxDepth=depth, seed=5, featureSubsetStrategy="all")
        return Pipeline(stages=[*ml.feature_stages(names), grower]).fit(rows)

    cut = forest.predictions(rows, forest.node_table(spark, grown(9).stages[-1]), names, {"cut": (6, 3, 2)}, "prediction")
    both = grown(3).transform(cut).select("cut", "prediction").collect()
    assert all(r.cut == pytest.approx(r.prediction, rel=1e-9) for r in both) and len({round(r.cut, 6) for r in both}) > 5


def test_model_with_a_minimum_split(spark, fleet, tmp_path):
    """The pruned model predicts what the walk with that limit predicts, also after it was saved."""
    trained = ml.train_classifier(fleet, settings=QUICK)
    model = trained.model.stages[-1]
    small = forest.with_min_split(spark, model, 60)
    before, after = forest.node_table(spark, model), forest.node_table(spark, small)
    assert after.count() < before.count() and after.where("left >= 0 AND n < 60").count() == 0
    walked = forest.predictions(fleet, before, list(trained.features), {"walked": (8, 30, 60)}, "class:1")
    pipeline = PipelineModel(stages=[*trained.model.stages[:-1], small])
    sinks.save_models({"small": pipeline}, str(tmp_path))
    scored = ml.score_fleet(walked, sinks.load_models(spark, ["small"], str(tmp_path))["small"])
    assert scored.where(F.abs(F.col("walked") - F.col("pred_proba")) > 1e-12).count() == 0


def test_grown_nodes_hold_the_best_splits(spark, fleet):
    """Of every node of a tree with all features: sums of its rows, the largest gain of any split, and leaves where no split is allowed."""
    names = ["vibration", "age", "error_count"]
    rows = fleet.select("machineID", "time", "event", *names)
    told = rows.withColumn("key", F.xxhash64("machineID")).collect()
    edges = forest.edges_of(rows, names)
    assert len(edges[0]) == 31 and edges[1].tolist() == [v + 0.5 for v in range(19)]
    odd = spark.createDataFrame([(float("-inf"),), (float("nan"),), (None,), (4.0,)], "vibration double")
    assert forest.edges_of(odd, ["vibration"])[0].tolist() == [float("-inf"), 2.0]
    x = np.array([[float(r[c]) for c in names] for r in told])
    w = forest._drawn(np.array([r.key for r in told], np.int64).view(np.uint64), forest._root(5, 0))
    assert 0.5 < np.mean(w > 0) < 0.75 and 0.8 < w.mean() < 1.2
    for target, classes, depth, leaf, split in (("time", 0, 6, 3, 8), ("event", 2, 30, 1, 2)):
        y = np.array([float(r[target]) for r in told])
        spread = (lambda a, y=y: 1 - sum((a[y == k].sum() / a.sum()) ** 2 for k in (0, 1))) if classes else (
            lambda a, y=y: np.average((y - np.average(y, weights=a)) ** 2, weights=a))
        tree = {r.node: r for r in forest.Grower(names, target, classes, 5).nodes(rows, 1, depth, leaf, split).collect()}
        members = {0: w.astype(float)}
        for k in range(len(tree)):
            own, node = members[k], tree[k]
            assert node.n == own.sum() and node.impurity == pytest.approx(spread(own), abs=1e-9)
            assert node.stats[1] == pytest.approx((own * y).sum()) and (classes or node.prediction == pytest.approx(np.average(y, weights=own)))
            gains = [0.0]
            for f, e in enumerate(edges):
                for t in e:
                    a, b = own * (x[:, f] <= t), own * (x[:, f] > t)
                    if min(a.sum(), b.sum()) >= leaf:
                        gains.append(spread(own) - (a.sum() * spread(a) + b.sum() * spread(b)) / own.sum())
            may = node.depth < depth and node.n >= split and max(gains) > 1e-9
            assert (node.left >= 0) == may and (not may or node.gain == pytest.approx(max(gains), abs=1e-9))
            if may:
                goes = x[:, node.feature] <= node.threshold
                members[node.left], members[node.right] = own * goes, own * ~goes
                assert node.threshold in edges[node.feature] and tree[node.left].parent == tree[node.right].parent == k
        assert len(members) == len(tree) > 10


@pytest.mark.parametrize("target, classes, value", [("event", 2, "class:1"), ("time", 0, "prediction")])
def test_grown_forests_as_tables_and_models(spark, fleet, monkeypatch, target, classes, value):
    """Told-out rows, a walk down the nodes and the model put together say the same, however rows and trees are dealt."""
    names = ["vibration", "pressure", "age", "error_count"]
    gappy = fleet.withColumn("vibration", F.when(F.col("machineID") % 7 > 0, F.col("vibration"))).withColumn("_id", F.col("machineID"))
    rows = gappy.select("machineID", target, *names, "_id", (F.col("machineID") % 3 == 0).alias("_held"))
    grower, train = forest.Grower(names, target, classes, 42), gappy.where("machineID % 3 > 0")
    told = grower.told(rows, 8, 30, 1, LIMITS)
    nodes = grower.nodes(train, 8, 30)
    walked = forest.predictions(rows.where("_held"), nodes, names, LIMITS, value)
    key = lambda df: sorted(tuple(round(r[c], 9) for c in LIMITS) for r in df.collect())
    assert key(told) == key(walked) and told.count() == 100
    monkeypatch.setattr(forest, "GROW_BLOCKS", 3)
    assert key(grower.told(rows.repartition(5, "age"), 8, 30, 1, LIMITS)) == key(told)

    trained = (ml.train_classifier if classes else ml.train_regressor)(
        train, names, settings=QUICK, grid={"numTrees": (8,), "maxDepth": (9,), "minSamplesSplit": (20,)})
    stage = trained.model.stages[-1]
    assert (stage.getNumTrees, stage.getMaxDepth()) == (8, 9)
    scored = trained.model.transform(trained._tested.select("machineID").join(train, "machineID"))
    other = trained.predictions.select("machineID", F.col("prediction").alias("told"))
    assert scored.join(other, "machineID").where(F.abs(F.col("prediction") - F.col("told")) > 1e-9).count() == 0
    weights = dict(zip(names, stage.featureImportances.toArray()))
    assert {r.feature: r.importance for r in trained.importance.collect()} == pytest.approx(weights)
    assert forest.node_table(spark, stage).where("left >= 0 AND n < 20").count() == 0


@pytest.mark.parametrize("name", ["classifier", "regressor"])
def test_searches_fit_no_forest_through_the_driver(fleet, monkeypatch, name):
    """A forest of Spark takes jobs per level, whose nodes and bins pass through the driver: grids took longer than their limits."""
    def broken(*_, **__):
        raise AssertionError("fitted level by level")

    monkeypatch.setattr(ml, f"RandomForest{name.title()}", broken)
    grid = {"numTrees": (3, 6), "maxDepth": (2, 30), "minSamplesSplit": (2, 9)}
    trained = getattr(ml, f"train_{name}")(fleet, settings=QUICK, grid=grid)
    told = [(r.metric, r.value) for r in trained.metrics.collect()]
    assert sum(m == "cv_score" for m, _ in told) == 8 and dict(told)["n_estimators"] in (3, 6)


def test_grid_certificate_fits_no_forest_through_the_driver(spark, fleet, monkeypatch):
    """Both grids are scored and compared with the chosen combinations, without a model of Spark."""
    def broken(*_, **__):
        raise AssertionError("fitted level by level")

    for name in ("RandomForestClassifier", "RandomForestRegressor"):
        monkeypatch.setattr(ml, name, broken)
    small = {"numTrees": (2, 4), "maxDepth": (2, 30), "minSamplesSplit": (2, 9)}
    monkeypatch.setattr(ml, "CLASSIFIER_GRID", {**small, "minInstancesPerNode": (1, 3)})
    monkeypatch.setattr(ml, "REGRESSOR_GRID", small)
    monkeypatch.setattr(catalogue, "_stored_health", lambda *_: fleet)
    rows = {tuple(r) for r in catalogue.QUERIES["grid_certificate"](spark, "").collect()}
    assert rows == {("classifier", 16, 0), ("regressor", 8, 0)}


def test_grid_search(spark, fleet):
    """Scores equal those of the folds' forests by a loop; the best combination is fitted."""
    grid = {"numTrees": (3, 6), "maxDepth": (2, 5), "minInstancesPerNode": (1, 4), "minSamplesSplit": (2, 30)}
    clf = ml.train_classifier(fleet, settings=QUICK, grid=grid)
    scores = {(r.numTrees, r.maxDepth, r.minInstancesPerNode, r.minSamplesSplit): r.score for r in clf.scores.collect()}
    assert len(scores) == 16 and all(0 <= v <= 1 for v in scores.values())
    best = max(round(v, 9) for v in scores.values())
    first = min(k for k, v in scores.items() if round(v, 9) == best)
    assert first == tuple(clf.chosen[k] for k in ml.GRID_LABELS.values())
    assert clf.model.stages[-1].getNumTrees == first[0]
    told = {(r.metric, r.label): r.value for r in clf.metrics.collect()}
    assert told[("min_samples_split", None)] == first[3] and sum(k[0] == "cv_score" for k in told) == 16

    reg = ml.train_regressor(fleet, ["vibration", "age"], settings=QUICK, grid={"numTrees": (4,), "maxDepth": (3,), "minSamplesSplit": (2, 9)})
    rows = split.random_split(fleet, seed=QUICK.seed).where("NOT is_test").withColumn("fold", F.floor(split.row_hash(seed=QUICK.seed + 1) * 2 / 2 ** 32))
    errors = []
    for fold in (0, 1):
        grower = RandomForestRegressor(labelCol="time", numTrees=4, maxDepth=3, seed=QUICK.seed)
        model = Pipeline(stages=[*ml.feature_stages(["vibration", "age"]), grower]).fit(rows.where(F.col("fold") != fold))
        errors.append(model.transform(rows.where(F.col("fold") == fold)).agg(F.avg(F.abs(F.col("time") - F.col("prediction")))).first()[0])
    want = {r.minSamplesSplit: r.score for r in reg.scores.collect()}
    assert want[2] == pytest.approx(np.mean(errors), rel=0.15) and len(want) == 2


def test_fits_of_a_grid_do_not_share_local_properties(fleet, monkeypatch):
    """Threads with one set of properties clear each other's execution ids (NumberFormatException in one of some runs)."""
    copies, wrap = [], forest.inheritable_thread_target
    monkeypatch.setattr(forest, "inheritable_thread_target", lambda session: copies.append(session) or wrap(session))
    ml.train_regressor(fleet, ["vibration"], settings=QUICK, grid={"numTrees": (2,), "maxDepth": (2,)})
    assert len(copies) == QUICK.folds


@pytest.mark.parametrize("name, size", [("classifier", 24), ("regressor", 12)])
def test_grid_queries_search_all(spark, monkeypatch, name, size):
    searched, search = [], forest.search

    def small(rows, features, target, grid, *rest):
        searched.append(grid)
        return search(rows, features, target, {k: v[:1] for k, v in grid.items()}, *rest)

    monkeypatch.setattr(forest, "search", small)
    rows = catalogue.QUERIES[f"{name}_grid"](spark, "/root/testdata/sf0.001").collect()
    assert np.prod([len(v) for v in searched[0].values()]) == size and {r["model"] for r in rows} == {name}


def test_patterns_are_stationary(fleet):
    r = ml.pattern_certificate(fleet, ml.train_failure_patterns(fleet)).agg(F.sum("machines"), F.sum("nearest"), F.max("off_centre")).first()
    assert (r[0], r[1]) == (300, 300) and r[2] < 1e-9


def test_risk_classifier_and_patterns(fleet):
    model = ml.train_risk_classifier(fleet, settings=Training(risk_trees=10))
    predicted = ml.predict_risk(fleet, model)
    right = predicted.join(fleet.select("machineID", F.col("risk_level").alias("truth")), "machineID").where("risk_level = truth")
    assert right.count() > 270
    r = predicted.first()
    assert sum(r.probabilities.values()) == pytest.approx(1) and r.confidence == pytest.approx(max(r.probabilities.values()))
    assert r.probabilities[r.risk_level] == r.confidence
    patterns = ml.assign_failure_patterns(fleet, ml.train_failure_patterns(fleet))
    assert patterns.select("failure_pattern").distinct().count() == 3
    assert ml.train_failure_patterns(fleet.limit(15)).stages[-1].summary.k == 2
    z = ml.standardise(fleet).agg(F.avg("vibration_z"), F.stddev_pop("vibration_z")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_training_and_alert_jobs(spark, fleet, tmp_path):
    source, models, out = (str(tmp_path / n) for n in ("fleet.parquet", "models", "out"))
    fleet.select("machineID", "model", "age", "time", "event", "volt", "rotate", "pressure", "vibration",
                 "error_count", "maint_count").write.parquet(source)
    trained = jobs.train_job(spark, source, models)
    assert set(trained) == {"classifier", "regressor"}
    report = sinks.read_metrics(spark, f"{models}/training_report")
    assert report.where("metric = 'auc_roc'").count() == 1
    assert sinks.read_metrics(spark, f"{models}/nothing") is None
    rows = jobs.alert_job(spark, source, out, "2024-06-01 00:00:00", models)
    assert rows.count() > 0 and spark.read.parquet(f"{out}/alert_history").count() == rows.count()
    assert "RAPPORT MAINTENANCE" in spark.read.text(f"{out}/maintenance_report").collect()[1].value
    pack = [r.value for r in spark.read.text(f"{out}/decision_pack").collect()]
    assert "ProbFail: N/A" not in pack[4]
    weights = trained["classifier"].importance.unionByName(trained["regressor"].importance)
    text = reports.technical_report(trained["classifier"].metrics.unionByName(trained["regressor"].metrics),
                                    ml.top_features(weights), spark.createDataFrame([(3, 11)], "total_missing long, columns long"),
                                    "2024-06-01 00:00:00").collect()
    lines = {r.line for r in text}
    assert "  Valeurs manquantes: 3" in lines and "\nCLASSIFIER:" in lines and any(x.startswith("  Auc Roc: ") for x in lines)
    prompt = reports.technical_prompt(report, spark.createDataFrame([(300, 50.0, 70.0)], "total_machines long, failure_rate double, avg_health double"))
    assert "Machines totales: 300" in prompt.first().prompt


def test_one_failing_model_does_not_stop_the_other(spark, fleet, tmp_path, monkeypatch):
    source = str(tmp_path / "fleet.parquet")
    fleet.select("machineID", "model", "age", "time", "event", "volt", "rotate", "pressure", "vibration",
                 "error_count", "maint_count").write.parquet(source)

    def broken(*_, **__):
        raise RuntimeError("no")

    monkeypatch.setattr(ml, "train_classifier", broken)
    assert set(jobs.train_job(spark, source, str(tmp_path / "models"))) == {"regressor"}
