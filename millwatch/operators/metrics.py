"""Model metrics from a table of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millwatch.functions.numeric import leading_bits
from millwatch.operators.scan import SUM, running
from millwatch.session import materialise


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows ``(scope, precision, recall, f1, support)``: each class, accuracy, macro and weighted average.

    Undefined ratios count as 0. The accuracy row holds its value in all three metric columns.
    """
    counts = confusion(df, label, prediction)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))).alias("s")).select("s.*")
    per_class = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = per_class.withColumns({
        "precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    scored = scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    metrics = ("precision", "recall", "f1")
    totals = scored.agg(
        F.sum("support").alias("support"), F.sum("hits").alias("hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[F.sum(F.col(m) * F.col("support")).alias(f"sum_{m}") for m in metrics])
    support = F.col("support")
    accuracy = ratio(F.col("hits"), support)
    averages = totals.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("scope"), *[accuracy.alias(m) for m in metrics], support),
        F.struct(F.lit("macro avg").alias("scope"), *[F.col(f"macro_{m}").alias(m) for m in metrics], support),
        F.struct(F.lit("weighted avg").alias("scope"),
                 *[ratio(F.col(f"sum_{m}"), support).alias(m) for m in metrics], support))).alias("r")).select("r.*")
    return scored.select(F.col("class").alias("scope"), *metrics, "support").unionByName(averages)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL when only one class is present."""
    by_score = materialise(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(
        F.lit("all").alias("group"), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) != 1).alias("negative")), "scores")
    by_score = by_score.withColumns({"_high": leading_bits(F.col("score"), 10), "_low": leading_bits(F.col("score"), 28)})
    ranked = running(by_score, ["group"], [["_high"], ["_low"], ["score"]], {"upto": ("negative", SUM)})
    below = F.col("upto") - F.col("negative") + F.col("negative") / 2
    totals = ranked.agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"),
                        F.sum(F.col("positive") * below).alias("wins"))
    pairs = F.col("p").cast("double") * F.col("n").cast("double")
    return totals.select(F.when(pairs > 0, F.col("wins") / pairs).alias("auc_roc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``mae``, ``rmse`` and ``r2`` over rows with both values, in one pass."""
    y, error = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    sums = rows.agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("spread"))
    return sums.select("mae", F.sqrt("mse").alias("rmse"),
                       F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).alias("r2"))
