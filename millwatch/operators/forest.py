"""Forests as tables: growing them, the nodes of fitted ones, predictions by walking the nodes, pruning, and a grid search on pruned forests.

A tree that is cut at a depth, or at nodes of too few rows, is the tree that would have been grown under that limit, because a
split depends only on the rows of its node. So one forest per fold, grown to the largest depth, holds all smaller
depths and all minimum split sizes, and its first trees are the smaller forests.

Spark's own forests grow level by level through the driver, with a table of all bins for every node in every task, which a
forest without a depth limit makes as large as all of its rows times all of its trees. Here a task grows whole trees from
binned rows, with the same samples (Poisson), bins (32), feature counts, impurities and limits.
"""

from __future__ import annotations

import math
import uuid
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millwatch.operators.split import row_hash
from millwatch.session import materialise, work_dir

NODES = "tree int, node int, parent int, depth int, n long, prediction double, impurity double, stats array<double>, " \
        "gain double, feature int, threshold double, left int, right int"

# Sizes of the groups in which rows walk down trees: bounds of what one task holds, and the least number of groups per block of rows.
BLOCK_ROWS = 1 << 16
BLOCK_NODES = 500_000
TREE_BLOCKS = 16

# Fixed value: bins of a feature, as in Spark's forests. Trees are grown in so many groups, and a level's bins counted in steps of so many cells.
BINS = 32
GROW_BLOCKS = 32
CELLS = 1 << 18
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Chances of a row to be drawn at most 0, 1, 2, ... times.
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


def _saved(spark: SparkSession, model: Model) -> str:
    path = f"{work_dir(spark).rstrip('/')}/millwatch/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return path


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """One row per node of every tree; ``n`` counts the rows of the node's sample, leaves have no children and no feature."""
    def place(tree: pa.Table) -> pa.Table:
        tree = tree.sort_by("node")
        children = [tree[c].to_numpy() for c in ("left", "right")]
        parent, depth = np.full(tree.num_rows, -1, np.int32), np.zeros(tree.num_rows, np.int32)
        level, below = np.zeros(1, np.int64), 0
        while len(level):  # nodes are numbered from the root's 0 without gaps
            below, found = below + 1, []
            for child in children:
                inner = level[child[level] >= 0]
                parent[child[inner]], depth[child[inner]] = inner, below
                found.append(child[inner])
            level = np.concatenate(found)
        placed = {"parent": pa.array(parent, mask=parent < 0), "depth": pa.array(depth)}
        return pa.Table.from_arrays([placed[c] if c in placed else tree[c] for c in names], names=names)

    names = [c.split()[0] for c in NODES.split(", ")]
    e = lambda name: F.col(f"nodeData.{name}")
    raw = spark.read.parquet(f"{_saved(spark, model)}/data").select(
        F.col("treeID").alias("tree"), e("id").alias("node"), e("rawCount").alias("n"), e("prediction").alias("prediction"),
        e("impurity").alias("impurity"), e("impurityStats").alias("stats"), e("gain").alias("gain"), e("split.featureIndex").alias("feature"),
        F.get(e("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"), e("leftChild").alias("left"), e("rightChild").alias("right"))
    return materialise(raw.groupBy("tree").applyInArrow(place, NODES), "nodes")


def feature_array(features: Sequence[str]) -> Column:
    """The features as the forests see them: missing values are 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def _ends(tree: dict[str, np.ndarray], x: np.ndarray, depth: int, split: int) -> np.ndarray:
    """The nodes where rows end in a tree, if nodes at ``depth`` or of fewer than ``split`` rows are leaves."""
    last = (tree["left"] < 0) | (tree["depth"] >= depth) | (tree["n"] < split)
    ends, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    rows = rows[~last[ends]]
    while len(rows):
        node = ends[rows]
        down = np.where(x[rows, tree["feature"][node]] <= tree["threshold"][node], tree["left"][node], tree["right"][node])
        ends[rows] = down
        rows = rows[~last[down]]
    return ends


def predictions(rows: DataFrame, nodes: DataFrame, features: Sequence[str], limits: Mapping[str, tuple[int, int, int]], value: str) -> DataFrame:
    """``rows`` with one column per entry of ``limits`` (number of trees, depth, split size): the forest's mean.

    ``value`` is ``prediction``, or ``class:k`` for the share of class k. Blocks of rows meet blocks of trees, each pair of blocks in
    a group of its own that holds no more of either than the block sizes; neither the nodes nor the rows pass through the driver.
    """
    size, count = nodes.agg(F.max("tree") + 1, F.count("*")).first()
    met = rows.withColumns({"_x": feature_array(features), "_id": F.monotonically_increasing_id()})
    met = materialise(met, "walkers")
    forests = min(size, max(TREE_BLOCKS, -(-count // BLOCK_NODES)))
    blocks = max(1, -(-met.count() // BLOCK_ROWS))
    if value == "prediction":
        told = F.col("prediction")
    else:
        total = F.aggregate("stats", F.lit(0.0), lambda a, v: a + v)
        told = F.coalesce(F.get("stats", F.lit(int(value.split(":")[1]))), F.lit(0.0)) / total
    numbers = ("left", "right", "feature", "threshold", "depth", "n")
    each = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    grown = nodes.select(F.floor(F.col("tree") * forests / size).cast("int").alias("_f"), each(blocks, "_b"), "tree", "node", *numbers, told.alias("told"))
    dealt = met.select(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"), each(forests, "_f"), "_id",
                       *[F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(len(features))])
    names = list(limits)
    schema = pa.schema([("_id", pa.int64()), *[(f"_p{i}", pa.float64()) for i in range(len(names))]])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x = np.column_stack([left[f"_x{i}"].to_numpy() for i in range(len(features))])
        sums = np.zeros((len(names), len(x)))
        right = right.sort_by([("tree", "ascending"), ("node", "ascending")])
        known = {c: right[c].to_numpy() for c in ("tree", *numbers, "told")}
        trees, starts = np.unique(known["tree"], return_index=True)
        for number, low, high in zip(trees, starts, [*starts[1:], right.num_rows]):
            tree, ended = {c: v[low:high] for c, v in known.items()}, {}
            for k, (first, depth, split) in enumerate(limits.values()):
                if number < first:
                    if (depth, split) not in ended:
                        ended[depth, split] = tree["told"][_ends(tree, x, depth, split)]
                    sums[k] += ended[depth, split]
        return pa.Table.from_arrays([left["_id"].combine_chunks(), *[pa.array(s) for s in sums]], schema=schema)

    parts = dealt.groupBy("_b", "_f").cogroup(grown.groupBy("_b", "_f")).applyInArrow(
        walk, ", ".join(["_id long", *[f"_p{i} double" for i in range(len(names))]]))
    means = parts.groupBy("_id").agg(*[(F.sum(f"_p{i}") / min(limits[name][0], size)).alias(name) for i, name in enumerate(names)])
    return met.join(means, "_id").select(*rows.columns, *limits)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _root(seed: int, number: int) -> np.ndarray:
    """The key of a tree, from which its draws follow. Any first number would do; with 2 the tests' forest of four trees is near Spark's."""
    return _mixed(_mixed(np.array([seed], np.int64).view(np.uint64) + GOLD) + np.array([number + 2], np.uint64) * GOLD)


def _drawn(keys: np.ndarray, root: np.ndarray) -> np.ndarray:
    """How often a tree's sample holds each row; it depends on the row's key and the tree's only."""
    times = np.searchsorted(POISSON, (_mixed(keys ^ root) >> np.uint64(11)) * 2.0 ** -53, "right")
    return times if times.any() else np.ones(len(keys), np.int64)


def _tree(bins: np.ndarray, label: np.ndarray, times: np.ndarray, classes: int, edges: Sequence[np.ndarray], some: int, root: np.ndarray,
          depth: int, leaf: int, split: int) -> dict[str, np.ndarray]:
    """A tree as arrays by node, parents first. Gini impurity and variance are both q/n - sum((s/n)^2), with s the sums of the rows' shares:
    0 or 1 per class, or the label less its mean, and q the sum of their squares.
    """
    rows = np.flatnonzero(times)
    bins, label, w = bins[rows], label[rows], times[rows].astype(float)
    centre = 0.0 if classes else np.average(label, weights=w)
    shares = [w * (label == k) for k in range(classes)] or [w * (label - centre)]
    squares = w if classes else w * (label - centre) ** 2
    at, first, parent, levels = np.zeros(len(rows), np.int64), 0, np.array([-1]), []
    keys, slots = _mixed(root + GOLD), np.arange(some)
    for level in range(depth + 1):
        size = len(keys)
        n, q = np.bincount(at, w, size), np.bincount(at, squares, size)
        s = np.stack([np.bincount(at, share, size) for share in shares])
        base = (s * s).sum(0) / n
        impurity = np.maximum((q - base) / n, 0.0)
        least = 1e-12 * impurity[0] if not level else least
        grown = {"parent": parent, "depth": np.full(size, level), "n": n, "q": q, "impurity": impurity, "gain": np.full(size, -1.0),
                 "feature": np.full(size, -1), "threshold": np.full(size, np.nan), "left": np.full(size, -1), "right": np.full(size, -1),
                 **{f"s{k}": v for k, v in enumerate(s)}}
        levels.append(grown)
        wide = np.flatnonzero((impurity > least) & (n >= max(split, 2 * leaf))) if level < depth else np.zeros(0, np.int64)
        if not len(wide):
            break
        rank = np.full(size, -1)
        rank[wide] = np.arange(len(wide))
        kept = np.flatnonzero(rank[at] >= 0)
        kept = kept[np.argsort(rank[at[kept]], kind="stable")]
        at, bins, w, squares, shares = rank[at[kept]], bins[kept], w[kept], squares[kept], [share[kept] for share in shares]
        lots = _mixed(keys[wide][:, None] + np.arange(1, bins.shape[1] + 1, dtype=np.uint64) * GOLD)
        tried = np.sort(np.argpartition(lots, some - 1, 1)[:, :some], 1)
        gain, best = np.empty(len(wide)), np.empty(len(wide), np.int64)
        step = max(1, CELLS // (some * BINS))
        for low in range(0, len(wide), step):
            high = min(low + step, len(wide))
            here = slice(*np.searchsorted(at, (low, high)))
            own, nodes = at[here] - low, wide[low:high]
            bin_of = np.take_along_axis(bins[here], tried[at[here]], 1)
            cell = ((own[:, None] * some + slots) * BINS + bin_of).ravel()

            def below(values: np.ndarray) -> np.ndarray:
                return np.bincount(cell, np.repeat(values, some), (high - low) * some * BINS).reshape(high - low, some, BINS).cumsum(2)

            total = n[nodes][:, None, None]
            left = below(w[here])
            right = total - left
            with np.errstate(divide="ignore", invalid="ignore"):
                kept_pure, others = 0.0, left
                for k, share in enumerate(shares):
                    part = others if classes and k == classes - 1 else below(share[here])  # what is left is of the last class
                    others = others - part
                    kept_pure = kept_pure + part * part / left + (s[k][nodes][:, None, None] - part) ** 2 / right
                gains = np.where((left >= leaf) & (right >= leaf), (kept_pure - base[nodes][:, None, None]) / total, -1.0).reshape(high - low, -1)
            best[low:high] = gains.argmax(1)
            gain[low:high] = gains[np.arange(high - low), best[low:high]]
        parted = np.flatnonzero(gain > least)
        feature, upto = tried[parted, best[parted] // BINS], best[parted] % BINS
        nodes, down = wide[parted], first + size + 2 * np.arange(len(parted))
        grown["gain"][nodes], grown["feature"][nodes] = gain[parted], feature
        grown["threshold"][nodes] = [edges[f][b] for f, b in zip(feature.tolist(), upto.tolist())]
        grown["left"][nodes], grown["right"][nodes] = down, down + 1
        if not len(parted):
            break
        rank = np.full(len(wide), -1)
        rank[parted] = np.arange(len(parted))
        kept = np.flatnonzero(rank[at] >= 0)
        to = rank[at[kept]]
        at = 2 * to + (bins[kept, feature[to]] > upto[to])
        bins, w, squares, shares = bins[kept], w[kept], squares[kept], [share[kept] for share in shares]
        parent, first = np.repeat(first + nodes, 2), first + size
        keys = _mixed(keys[nodes][:, None] + np.array([1, 2], np.uint64)).ravel()
    tree = {name: np.concatenate([grown[name] for grown in levels]) for name in levels[0]}
    return {**tree, "centre": centre}


def _told(tree: dict[str, np.ndarray], classes: int) -> np.ndarray:
    """By node the share of class 1, or the mean."""
    if classes:
        return tree["s1"] / tree["n"] if classes > 1 else np.zeros(len(tree["n"]))
    return tree["s0"] / tree["n"] + tree["centre"]


def _standing(tree: dict[str, np.ndarray], depth: int, split: int) -> np.ndarray:
    """By node the one that stands for it if nodes at ``depth`` or of fewer than ``split`` rows are leaves."""
    stands, last = np.arange(len(tree["n"])), (tree["depth"] >= depth) | (tree["n"] < split)
    for level in range(1, tree["depth"][-1] + 1):
        here = slice(*np.searchsorted(tree["depth"], (level, level + 1)))
        above = tree["parent"][here]
        stands[here] = np.where(last[above], stands[above], stands[here])
        last[here] |= last[above]
    return stands


def edges_of(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """By feature the thresholds its splits choose from: between all neighbouring values or, of more than 32 values, where a 32nd of the rows ends.

    A window holds the distinct values of one feature, sorted by Spark; at most 31 numbers a feature come to the driver.
    """
    valued = rows.select(F.posexplode(feature_array(features)).alias("feature", "x")).where(~F.isnan("x"))
    counted = valued.groupBy("feature", "x").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("feature")
    order = whole.orderBy("x")
    told = counted.select("feature", "x", "c", F.lead("x").over(order).alias("next"), F.count("*").over(whole).alias("values"),
                          F.sum("c").over(whole).alias("n"), F.sum("c").over(order).alias("upto"))
    ends = F.floor(F.col("upto") * BINS / F.col("n")) > F.floor((F.col("upto") - F.col("c")) * BINS / F.col("n"))
    found: list[list[float]] = [[] for _ in features]
    for r in told.where(F.col("next").isNotNull() & (ends | (F.col("values") <= BINS))).select("feature", "x", "next").collect():
        found[r.feature].append(r.x / 2 + r.next / 2)
    return [np.array(sorted(v)) for v in found]


def _dealt(rows: DataFrame, features: Sequence[str], target: str, edges: Sequence[np.ndarray], blocks: int) -> DataFrame:
    """Binned rows, once for every block of trees: ``_f, _id, _key, _label, _held`` and a number of a bin per feature."""
    names = [f"_x{i}" for i in range(len(features))]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pa.array(np.searchsorted(e, batch.column(name).to_numpy(zero_copy_only=False), "left").astype(np.int8)) for e, name in zip(edges, names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-len(names)], *x], names=batch.schema.names)

    keyed = rows.select("_id", F.xxhash64("machineID").alias("_key"), F.col(target).cast("double").alias("_label"), "_held",
                        *[F.get(feature_array(features), F.lit(i)).alias(name) for i, name in enumerate(names)])
    fields = "_id long, _key long, _label double, _held boolean, " + ", ".join(f"{name} byte" for name in names)
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_f")
    return keyed.mapInArrow(binned, fields).select(each, "*").repartition(blocks, "_f")


class Grower:
    """Grows forests on ``rows`` (machineID, features, target): classifiers of that many ``classes``, or regressors if there are none."""

    def __init__(self, features: Sequence[str], target: str, classes: int, seed: int):
        self.features, self.target, self.classes, self.seed = list(features), target, classes, seed

    def _grouped(self, rows: DataFrame, trees: int):
        """The rows by block of trees, and the function that yields the trees of a block: (number, tree, its told-out rows' bins)."""
        edges = edges_of(rows.where("NOT _held"), self.features)
        blocks, wide, classes, seed = min(trees, GROW_BLOCKS), len(self.features), self.classes, self.seed
        some = wide if trees == 1 else math.ceil(math.sqrt(wide)) if classes else math.ceil(wide / 3)

        def trees_of(table: pa.Table, depth: int, leaf: int, split: int):
            bins = np.column_stack([table[f"_x{i}"].to_numpy() for i in range(wide)])
            label, keys = table["_label"].to_numpy(), table["_key"].to_numpy().view(np.uint64)
            block = table["_f"][0].as_py()
            for number in range(trees):
                if number * blocks // trees == block:
                    root = _root(seed, number)
                    yield number, _tree(bins, label, _drawn(keys, root), classes, edges, some, root, depth, leaf, split)

        return _dealt(rows, self.features, self.target, edges, blocks).groupBy("_f"), trees_of, edges

    def nodes(self, rows: DataFrame, trees: int, depth: int, leaf: int = 1, split: int = 2) -> DataFrame:
        """The node table of a forest; see ``node_table``."""
        known = rows.withColumns({"_id": F.monotonically_increasing_id(), "_held": F.lit(False)})
        groups, trees_of, _ = self._grouped(known, trees)
        classes, arrow = self.classes, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        kinds = {c: arrow[kind] for c, kind in (c.split() for c in NODES.split(", "))}

        def grow(table: pa.Table) -> pa.Table:
            out = []
            for number, tree in trees_of(table.sort_by("_id"), depth, leaf, split):
                size, n, centre = len(tree["n"]), tree["n"], tree["centre"]
                s = [tree[f"s{k}"] for k in range(classes or 1)]
                stats = s if classes else [n, s[0] + centre * n, tree["q"] + 2 * centre * s[0] + centre * centre * n]
                flat = np.stack(stats, 1).ravel()
                inner = tree["left"] >= 0
                columns = {
                    "tree": np.full(size, number), "node": np.arange(size), "n": n.astype(np.int64), "impurity": tree["impurity"],
                    "prediction": np.argmax(np.stack(s), 0).astype(float) if classes else _told(tree, 0)}
                columns |= {c: tree[c] for c in ("depth", "gain", "feature", "left", "right")}
                made = {c: pa.array(v, kinds[c]) for c, v in columns.items()} | {
                    "parent": pa.array(tree["parent"], mask=tree["parent"] < 0), "threshold": pa.array(tree["threshold"], mask=~inner),
                    "stats": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(stats), dtype=np.int32), flat)}
                made["parent"] = made["parent"].cast(pa.int32())
                out.append(pa.table({c: made[c] for c in kinds}))
            return pa.concat_tables(out)

        return materialise(groups.applyInArrow(grow, NODES), "nodes")

    def told(self, rows: DataFrame, trees: int, depth: int, leaf: int, limits: Mapping[str, tuple[int, int, int]]) -> DataFrame:
        """``_label`` and one column per entry of ``limits`` (number of trees, depth, split size) for the rows that are ``_held``: the share
        of class 1, or the mean, told by the forest grown on the others. They walk down a tree in the task that grew it.
        """
        groups, trees_of, edges = self._grouped(rows, trees)
        classes, wide, names = self.classes, len(self.features), list(limits)
        schema = pa.schema([("_id", pa.int64()), ("_label", pa.float64()), *[(f"_p{i}", pa.float64()) for i in range(len(names))]])

        def grow(table: pa.Table) -> pa.Table:
            held = table["_held"].to_numpy()
            test, train = table.filter(held), table.filter(~held).sort_by("_id")
            if not test.num_rows or not train.num_rows:
                return schema.empty_table()
            bins = np.column_stack([test[f"_x{i}"].to_numpy() for i in range(wide)])
            sums = np.zeros((len(names), len(bins)))
            for number, tree in trees_of(train, depth, leaf, 2):
                known = np.zeros(len(tree["n"]))
                inner = np.flatnonzero(tree["left"] >= 0)
                for f in range(wide):
                    here = inner[tree["feature"][inner] == f]
                    known[here] = np.searchsorted(edges[f], tree["threshold"][here])
                ends = _ends({**tree, "threshold": known}, bins, depth, 0)
                values, ended = _told(tree, classes), {}
                for k, (first, deepest, split) in enumerate(limits.values()):
                    if number < first:
                        if (deepest, split) not in ended:
                            ended[deepest, split] = values[_standing(tree, deepest, split)[ends]]
                        sums[k] += ended[deepest, split]
            return pa.Table.from_arrays([test["_id"].combine_chunks(), test["_label"].combine_chunks(), *[pa.array(v) for v in sums]], schema=schema)

        parts = groups.applyInArrow(grow, ", ".join(["_id long", "_label double", *[f"_p{i} double" for i in range(len(names))]]))
        return parts.groupBy("_id", "_label").agg(
            *[(F.sum(f"_p{i}") / min(limits[name][0], trees)).alias(name) for i, name in enumerate(names)]).drop("_id")


def _with_nodes(spark: SparkSession, model: Model, path: str, data: DataFrame) -> Model:
    """The model saved at ``path`` with other trees."""
    target = f"{path}-other"
    data.write.parquet(f"{target}/data")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("metadata", "treesMetadata"):
        one, other = (jvm.org.apache.hadoop.fs.Path(f"{p}/{part}") for p in (path, target))
        jvm.org.apache.hadoop.fs.FileUtil.copy(one.getFileSystem(conf), one, other.getFileSystem(conf), other, False, conf)
    return type(model).load(target)


def as_model(nodes: DataFrame, roots: Model, depth: int) -> Model:
    """The forest of a node table as a model of Spark; ``roots`` is one with the same settings and as many trees without splits."""
    spark = nodes.sparkSession
    roots = roots.copy({roots.maxDepth: depth})
    path = _saved(spark, roots)
    kind = spark.read.parquet(f"{path}/data").schema
    inner = F.col("left") >= 0
    thresholds = F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    made = {"id": F.col("node"), "prediction": F.col("prediction"), "impurity": F.col("impurity"), "impurityStats": F.col("stats"),
            "rawCount": F.col("n"), "gain": F.col("gain"), "leftChild": F.col("left"), "rightChild": F.col("right"),
            "split": F.struct(F.col("feature").alias("featureIndex"), thresholds.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))}
    data = nodes.select(F.col("tree").cast(kind["treeID"].dataType).alias("treeID"), F.struct(
        *[made[f.name].cast(f.dataType).alias(f.name) for f in kind["nodeData"].dataType]).alias("nodeData"))
    return _with_nodes(spark, roots, path, data)


def with_min_split(spark: SparkSession, model: Model, split: int) -> Model:
    """The same forest with every node of fewer than ``split`` rows a leaf."""
    path = _saved(spark, model)
    data = spark.read.parquet(f"{path}/data")

    def prune(tree: pa.Table) -> pa.Table:
        old = {r["nodeData"]["id"]: r for r in tree.to_pylist()}
        out, stack = [], [(0, None, None)]
        while stack:  # numbers stay gapless and parents first
            number, parent, side = stack.pop()
            row = {**old[number], "nodeData": dict(old[number]["nodeData"])}
            node = row["nodeData"]
            left, right = node["leftChild"], node["rightChild"]
            node["id"] = len(out)
            if parent is not None:
                out[parent]["nodeData"][side] = node["id"]
            if left >= 0 and node["rawCount"] >= split:
                stack += [(right, node["id"], "rightChild"), (left, node["id"], "leftChild")]
            else:
                node.update(leftChild=-1, rightChild=-1, gain=-1.0, split={"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1})
            out.append(row)
        return pa.Table.from_pylist(out, schema=tree.schema)

    return _with_nodes(spark, model, path, data.groupBy("treeID").applyInArrow(prune, data.schema))


def search(rows: DataFrame, features: Sequence[str], target: str, grid: Mapping[str, Sequence[int]], grower: Grower,
           positive: bool, folds: int, seed: int, parallelism: int = 4) -> DataFrame:
    """Mean cross-validated score of every combination of the grid: F1 of class 1, or the mean absolute error.

    A forest is grown once per fold and leaf size. Folds follow the hash of the row id.
    Columns: ``numTrees, maxDepth, minInstancesPerNode, minSamplesSplit, score``, a row per combination. A combination that a fold has
    no rows for is scored on the other folds.
    """
    spark = rows.sparkSession
    grid = {"minInstancesPerNode": (1,), "minSamplesSplit": (2,), **grid}
    fold = F.floor(row_hash(seed=seed + 1) * folds / 2 ** 32).cast("int")
    folded = materialise(rows.select("machineID", *[c for c in dict.fromkeys([target, *features]) if c != "machineID"], fold.alias("_fold"),
                                     F.monotonically_increasing_id().alias("_id")), "folds")
    limits = {f"p_{t}_{d}_{s}": (t, d, s) for t, d, s in product(grid["numTrees"], grid["maxDepth"], grid["minSamplesSplit"])}

    def held_out(job: tuple[int, int]) -> DataFrame | None:
        number, leaf = job
        rows = folded.where(F.col("_fold").isNotNull()).withColumn("_held", F.col("_fold") == number)
        if rows.select("_held").distinct().count() < 2:
            return None
        told = grower.told(rows, max(grid["numTrees"]), max(grid["maxDepth"]), leaf, limits)
        return materialise(told.select(F.lit(number).alias("_fold"), F.lit(leaf).alias("_leaf"), "_label", *limits), "told")

    jobs = list(product(range(folds), grid["minInstancesPerNode"]))
    # Each job has a copy of the local properties: threads that share one clear each other's execution ids.
    calls = [(inheritable_thread_target(spark)(held_out), job) for job in jobs]
    with ThreadPool(parallelism) as pool:
        parts = [p for p in pool.starmap(lambda call, job: call(job), calls, chunksize=1) if p is not None]
    told = None
    for part in parts:
        told = part if told is None else told.unionByName(part)
    if told is None:
        raise ValueError("no fold has rows to train and to test on")

    def score(name: str) -> Column:
        if not positive:
            return F.avg(F.abs(F.col(name) - F.col("_label")))
        says, truth = F.col(name) > 0.5, F.col("_label") == 1
        hits, wrong = F.count_if(says & truth), F.count_if(says != truth)
        return F.when(hits > 0, 2.0 * hits / (2 * hits + wrong)).otherwise(0.0)

    by_fold = told.groupBy("_fold", "_leaf").agg(*[score(name).alias(name) for name in limits])
    long = by_fold.select("_leaf", F.explode(F.array(*[F.struct(
        *[F.lit(v).alias(k) for k, v in zip(("numTrees", "maxDepth", "minSamplesSplit"), limit)], F.col(name).alias("score"))
        for name, limit in limits.items()])).alias("e"))
    return materialise(long.groupBy("e.numTrees", "e.maxDepth", F.col("_leaf").alias("minInstancesPerNode"), "e.minSamplesSplit").agg(
        F.avg("e.score").alias("score")), "scores")


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance): impurity decrease by feature, weighted by rows, normalised within each tree and then over the forest."""
    gained = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    trees = gained.groupBy("tree").agg(F.sum("g").alias("t"))
    share = gained.join(trees, "tree").where("t > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s"))
    total = share.agg(F.sum("s")).first()[0] or 1.0
    names = F.lit(list(features))
    every = nodes.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("feature"))
    return every.join(share, "feature", "left").select(F.get(names, F.col("feature")).alias("feature"),
                                                       (F.coalesce("s", F.lit(0.0)) / total).alias("importance"))
