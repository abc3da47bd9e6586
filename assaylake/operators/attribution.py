"""Summaries of a long attribution table (class, sample_id, true_class, feature, value, shap)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from .ordering import attach, exact_median, exact_quantiles
from .summaries import top_k


def mean_abs_shap(df: DataFrame, classes: Sequence) -> DataFrame:
    """Mean absolute attribution, one row per feature and one column per class, with the mean
    over all outputs."""
    size = F.abs(F.col("shap"))
    return df.groupBy("feature").agg(
        *[F.avg(F.when(F.col("class") == c, size)).alias(f"class_{c}") for c in classes],
        F.avg(size).alias("overall"),
    )


def true_class_median(df: DataFrame) -> DataFrame:
    """Median absolute attribution of samples truly in the output class; 0 for an empty class."""
    keys = ["class", "feature"]
    grid = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    own = df.where(F.col("class") == F.col("true_class")).withColumn("_a", F.abs("shap"))
    med = exact_median(own, keys, "_a", "importance")
    return attach(grid, med, keys).withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def shap_ranking(df: DataFrame, rule: str = "true_class_median") -> DataFrame:
    """Features by importance: median on the true class, median of all, or mean of all outputs."""
    rows = df.withColumn("_a", F.abs("shap"))
    if rule == "true_class_median":
        scores = exact_median(
            rows.where(F.col("class") == F.col("true_class")), ["feature"], "_a", "importance")
    elif rule == "median_all":
        scores = exact_median(rows, ["feature"], "_a", "importance")
    elif rule == "mean_all":
        scores = rows.groupBy("feature").agg(F.avg("_a").alias("importance"))
    else:
        raise ValueError(f"unknown rule: {rule}")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")  # features only
    return scores.withColumn("rank", F.row_number().over(order))


def shap_direction(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Mean attribution at high values minus at low values (quartiles of the class), scaled by
    the largest absolute difference."""
    own = df.where(F.col("class") == F.col("true_class"))
    if features is not None:
        own = own.where(F.col("feature").isin(list(features)))
    keys = ["class", "feature"]
    cuts = exact_quantiles(own, keys, "value", [0.25, 0.75]).drop("n")
    wide = attach(own, cuts, keys)
    high = F.avg(F.when(as_col("value") >= F.get("q", 1), F.col("shap")))
    low = F.avg(F.when(as_col("value") <= F.get("q", 0), F.col("shap")))
    raw = wide.groupBy(*keys).agg(
        (F.coalesce(high, F.lit(0.0)) - F.coalesce(low, F.lit(0.0))).alias("direction")
    )
    top = F.max(F.abs("direction")).over(Window.partitionBy(F.lit(0)))
    return raw.withColumn(
        "direction_scaled", F.when(top > 0, F.col("direction") / top).otherwise(F.col("direction"))
    )


def top_features_per_class(importance: DataFrame, k: int = 8) -> DataFrame:
    return top_k(importance, "importance", k, ["class"])
