"""Classifier evaluation from labelled probabilities.

Inputs hold the true class index, the predicted index and an array of class probabilities.
Score curves use running sums per distinct score, so ties share a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from .ordering import attach, prefix_sums
from .score import predicted_index

EPS = 2.220446049250313e-16  # double precision


def _all_rows() -> Window:
    return Window.partitionBy(F.lit(0))


def confusion(df: DataFrame, y: str, p: str, n_classes: int) -> DataFrame:
    """All (true, predicted) pairs with count and percent of the true class (0 when empty)."""
    counts = df.groupBy(as_col(y).cast("int").alias("y_true"), as_col(p).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("y_true"),
        (F.col("id") % n_classes).cast("int").alias("y_pred"),
    )
    full = grid.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return full.withColumn(
        "row_pct", F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), total), F.lit(0.0))
    )


def per_class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts (0 when empty)."""
    cells = F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("t")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q"),
                 F.lit(0).cast("bigint").alias("t")),
    ))
    sums = matrix.select(cells.alias("c")).select("c.*").groupBy("class").agg(
        F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("t").alias("hits")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = lambda n, d: zero(F.try_divide(F.col(n).cast("double"), F.col(d)))
    f1 = zero(F.try_divide(F.lit(2.0) * F.col("hits"), F.col("support") + F.col("predicted")))
    return sums.select(
        "class", rate("hits", "predicted").alias("precision"), rate("hits", "support").alias("recall"),
        f1.alias("f1"), "support", "predicted", "hits",
    )


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, and macro F1 over the classes seen."""
    per = per_class_metrics(matrix).where((F.col("support") > 0) | (F.col("predicted") > 0))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return per.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"),
    )


def _one_vs_rest(df: DataFrame, y: str, probs: str) -> DataFrame:
    """One row per (row, class): class, score and whether it is the true class."""
    return df.select(
        as_col(y).cast("int").alias("_y"), F.posexplode(as_col(probs)).alias("class", "score")
    ).select("class", "score", (F.col("_y") == F.col("class")).cast("int").alias("pos"))


def score_curve(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score from high to low: new and running positives, negatives and totals."""
    return prefix_sums(
        df, keys, "score", {"pos": F.col("pos"), "neg": F.lit(1) - F.col("pos")}, descending=True
    )


def average_precision(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Average precision per class; a class without positives has 0."""
    curve = score_curve(_one_vs_rest(df, y, probs), ["class"])
    step = F.try_divide(F.col("pos").cast("double"), F.col("total_pos")) * F.col("cum_pos") / (
        F.col("cum_pos") + F.col("cum_neg")
    )
    return curve.groupBy("class").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("ap"))


def mean_ap(df: DataFrame, y: str, probs: str) -> DataFrame:
    return average_precision(df, y, probs).agg(F.avg("ap").alias("map_macro"))


def micro_curves(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Pooled ROC and precision-recall points: score, fpr, tpr, precision."""
    curve = score_curve(_one_vs_rest(df, y, probs), [])
    return curve.select(
        "score",
        (F.col("cum_neg") / F.col("total_neg")).alias("fpr"),
        (F.col("cum_pos") / F.col("total_pos")).alias("tpr"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
    )


def micro_auc(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Area under the pooled ROC curve, by trapezoids, and pooled average precision."""
    curve = score_curve(_one_vs_rest(df, y, probs), [])
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return curve.agg(
        (F.sum(area) / (F.max("total_pos").cast("double") * F.max("total_neg"))).alias("micro_auc"),
        (F.sum(step) / F.max("total_pos")).alias("micro_ap"),
    )


def micro_roc_pr(df: DataFrame, y: str, probs: str) -> tuple[DataFrame, DataFrame]:
    """Curve points and areas."""
    return micro_curves(df, y, probs), micro_auc(df, y, probs)


def log_loss(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Mean negative log of the true-class probability, rows normalised and clipped."""
    p = as_col(probs)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    mine = F.get(p, as_col(y).cast("int")) / total
    clipped = F.greatest(F.least(mine, F.lit(1.0 - EPS)), F.lit(EPS))
    return df.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def _confidence(df: DataFrame, y: str, probs: str) -> DataFrame:
    p = as_col(probs)
    return df.select(
        F.array_max(p).alias("confidence"),
        (predicted_index(p) == as_col(y).cast("int")).cast("int").alias("correct"),
    )


def ece(df: DataFrame, y: str, probs: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins open on the left."""
    rows = _confidence(df, y, probs)
    at = F.ceil(F.col("confidence") * F.lit(float(bins)))
    per = rows.withColumn("_b", at).groupBy("_b").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("correct").alias("_acc"), F.avg("confidence").alias("_conf"),
    )
    total = F.sum("_n")
    gap = F.when(F.col("_b") > 0, F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))).otherwise(0.0)
    return per.agg((F.sum(gap) / total).alias("ece"))


def coverage_accuracy(
    df: DataFrame, y: str, probs: str, points: int = 400, top: float = 0.999
) -> DataFrame:
    """Coverage and accuracy of the rows at or above each confidence threshold.

    Rows are counted once, at the highest threshold they reach; the curve is a running sum over
    the thresholds.  Accuracy needs at least ``max(10, 1 % of rows)`` rows.
    """
    step = top / (points - 1)
    rows = _confidence(df, y, probs)
    guess = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(F.col("confidence") / step)))
    # Division may land one off; compare with the thresholds themselves.
    at = F.when(F.col("confidence") < guess * F.lit(step), guess - 1).when(
        (guess < points - 1) & (F.col("confidence") >= (guess + 1) * F.lit(step)), guess + 1
    ).otherwise(guess)
    counts = rows.groupBy(at.cast("int").alias("i")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("correct").alias("_c")
    )
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    upward = _all_rows().orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.join(counts, "i", "left").select(
        "i",
        F.sum(F.coalesce("_n", F.lit(0))).over(upward).alias("_n"),
        F.sum(F.coalesce("_c", F.lit(0))).over(upward).alias("_c"),
    )
    enough = F.col("_n") >= F.greatest(F.lit(10), F.floor(F.col("_all") * 0.01))
    return attach(curve, total, []).select(
        (F.col("i") * F.lit(step)).alias("threshold"),
        (F.col("_n") / F.col("_all")).alias("coverage"),
        F.when(enough & (F.col("_n") > 0), F.col("_c") / F.col("_n")).alias("accuracy"),
    )


def recommended_threshold(
    curve: DataFrame, target: float = 0.90, min_coverage: float = 0.05
) -> DataFrame:
    """Highest threshold reaching the target accuracy with enough coverage, else the first with
    the best accuracy."""
    good = (F.col("accuracy") >= target) & (F.col("coverage") >= min_coverage)
    pick = F.struct("threshold", "coverage", "accuracy")
    best = curve.agg(
        F.max(F.when(good, pick)).alias("good"),
        F.min(F.when(F.col("accuracy").isNotNull(),
                     F.struct((-F.col("accuracy")).alias("_a"), F.col("threshold").alias("_t"),
                              pick.alias("p")))).alias("fallback"),
    )
    return best.select(F.coalesce("good", "fallback.p").alias("r")).select("r.*")


def overconfidence(df: DataFrame, y: str, probs: str, at: float = 0.9) -> DataFrame:
    """Rows at or above a confidence and their error rate."""
    rows = _confidence(df, y, probs).where(F.col("confidence") >= at)
    return rows.agg(
        F.count(F.lit(1)).alias("n_confident"), (F.lit(1.0) - F.avg("correct")).alias("error_rate")
    )


def confident_outside(df: DataFrame, confidence: str, outside: str, at: float = 0.9) -> DataFrame:
    """Confident rows that lie outside the domain."""
    flag: Column = (as_col(confidence) >= at) & as_col(outside)
    return df.agg(F.count_if(flag).alias("n_confident_outside"))
