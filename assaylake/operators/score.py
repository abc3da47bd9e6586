"""Model input, scoring and prediction columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .. import constants as K
from ..functions.numeric import as_col, to_number
from .boosting import BoostParams, SoftmaxBooster
from .kernel import KernelMachine, KernelParams, MarginModel


def model_vector(
    df: DataFrame, order: Sequence[str], mask_prefix: str | None = "missing_mask__",
    codes: int = 255, out: str = "features",
) -> DataFrame:
    """Codes in the configured column order divided by the code count, then their mask flags."""
    work = df.withColumns({f"_v{i}": as_col(c) / F.lit(float(codes)) for i, c in enumerate(order)})
    inputs = [f"_v{i}" for i in range(len(order))]
    if mask_prefix is not None:
        work = work.withColumns(
            {f"_m{i}": as_col(mask_prefix + c).cast("double") for i, c in enumerate(order)}
        )
        inputs += [f"_m{i}" for i in range(len(order))]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(work).drop(*inputs)


def score(
    df: DataFrame, models: Sequence, features: str = "features", out: str = "probs",
    out_std: str = "probs_std",
) -> DataFrame:
    """Class probabilities averaged over one or several fitted classifiers, and their population
    deviation between classifiers."""
    work = df
    for i, model in enumerate(models):
        if isinstance(model, MarginModel):
            work = work.withColumn(f"_p{i}", model.predicted(work, features)["probability"])
            continue
        fitted = model.copy().setFeaturesCol(features).setProbabilityCol("_prob")
        work = fitted.setPredictionCol("_pred").setRawPredictionCol("_raw").transform(work)
        work = work.withColumn(f"_p{i}", vector_to_array("_prob")).drop("_prob", "_pred", "_raw")
    n = F.lit(float(len(models)))
    parts = [F.col(f"_p{i}") for i in range(len(models))]
    classes = F.sequence(F.lit(0), F.size("_p0") - 1)
    mean = lambda c: reduce(add, [F.get(p, c) for p in parts]) / n
    work = work.withColumn(out, F.transform(classes, mean))
    square = lambda x: x * x
    var = lambda c: reduce(add, [square(F.get(p, c) - F.get(F.col(out), c)) for p in parts]) / n
    work = work.withColumn(out_std, F.transform(classes, lambda c: F.sqrt(var(c))))
    return work.drop(*[f"_p{i}" for i in range(len(models))])


def score_batches(
    df: DataFrame, features: str, make_predict: Callable, width: int, batch_size: int = 256,
    out: str = "probs",
) -> DataFrame:
    """Probabilities of an injected predictor that maps an (n, width) array to (n, classes).

    ``make_predict`` is called once per worker and returns the predictor.
    """
    predict = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(out, predict(vector_to_array(features)))


def class_slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")


def arc_probability(probs: str | Column, class_names: Sequence[str], arc: Sequence[str]) -> Column:
    """Sum of the probabilities of the arc classes."""
    total = F.lit(0.0)
    for i, name in enumerate(class_names):
        if name in arc:
            total = total + F.get(as_col(probs), i)
    return total


def predicted_index(probs: str | Column) -> Column:
    """0-based position of the largest probability, the first one on ties."""
    p = as_col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def add_prediction_columns(
    df: DataFrame, probs: str, class_names: Sequence[str], probs_std: str | None = None,
    arc: Sequence[str] = K.ARC_LABELS, high_p: float = 0.5, high_std: float = 0.05,
    baseline: str | None = None, wide: bool = True,
) -> DataFrame:
    """Predicted class, confidence tier, arc share and one column per class probability.

    ``baseline`` names an outside probability; its 0/1 flag stays NULL where that is missing.
    """
    p = as_col(probs)
    index = predicted_index(p)
    top = F.array_max(p)
    spread = F.get(as_col(probs_std), index) if probs_std else F.lit(0.0)
    tier = (
        F.when((top >= high_p) & (spread <= high_std), F.lit("high"))
        .when(top >= 0.5, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    name = F.get(F.array(*[F.lit(c) for c in class_names]), index)
    share = arc_probability(p, class_names, arc)
    known = to_number(baseline) if baseline else share
    out = {
        "pred_class_idx": index,
        "pred_class_name": name,
        "pred_prob_max": top,
        "pred_prob_std": spread,
        "is_arc_related_9class": name.isin(list(arc)),
        "confidence_tier": tier,
        "is_high_confidence": tier == "high",
        "Arc_probability3": share,
        "liu_arc_binary": known >= 0.5,
    }
    if wide:
        for i, c in enumerate(class_names):
            out[f"prob_{class_slug(c)}"] = F.get(p, i)
            out[f"prob_std_{class_slug(c)}"] = (
                F.get(as_col(probs_std), i) if probs_std else F.lit(0.0)
            )
    return df.withColumns(out)


def prediction_frame(
    df: DataFrame, probs: str, class_names: Sequence[str], id_col: str,
    arc: Sequence[str] = K.ARC_LABELS,
) -> DataFrame:
    """Short form: id, class, confidence, arc_probability and its flag at 0.5."""
    share = arc_probability(probs, class_names, arc)
    return df.select(
        as_col(id_col),
        F.get(F.array(*[F.lit(c) for c in class_names]), predicted_index(probs)).alias("class"),
        F.array_max(as_col(probs)).alias("confidence"),
        share.alias("arc_probability"),
        (share >= 0.5).alias("high_arc"),
    )


def high_arc(df: DataFrame, arc: Sequence[str] = K.ARC_LABELS, out: str = "high_arc") -> DataFrame:
    """Predicted arc class or arc share of at least 0.5."""
    by_share = F.coalesce(to_number("Arc_probability3") >= 0.5, F.lit(False))
    return df.withColumn(out, as_col("pred_class_name").isin(list(arc)) | by_share)


def high_arc_map(
    df: DataFrame, high_p: float = 0.7, high_std: float = 0.05, out: str = "high_arc_map"
) -> DataFrame:
    """Arc class predicted with a high and stable probability."""
    return df.withColumn(
        out,
        F.coalesce(
            as_col("is_arc_related_9class")
            & (as_col("pred_prob_max") >= high_p)
            & (as_col("pred_prob_std") <= high_std),
            F.lit(False),
        ),
    )


def baseline(name: str, seed: int = 42, n_features: int = 72, n_classes: int = 9, **settings):
    """An unfitted comparison classifier.

    ``random_forest``, ``svm`` (RBF kernel over landmarks, one against the rest), ``linear_svm``,
    ``softmax_boosting`` (one booster for all classes), ``boosted_trees`` (Spark's, one against the
    rest) or ``mlp`` (two hidden layers, 128 and 64).
    ``settings`` override parameters.
    """
    columns = {"featuresCol": "features", "labelCol": "label"}
    if name == "random_forest":
        base = dict(numTrees=300, maxDepth=10, minInstancesPerNode=15, subsamplingRate=0.65,
                    featureSubsetStrategy="sqrt", seed=seed)
        return RandomForestClassifier(**columns, **{**base, **settings})
    if name == "svm":
        return KernelMachine(KernelParams(**{"seed": seed, **settings}))
    if name == "linear_svm":
        base = dict(regParam=0.1, maxIter=100)
        return OneVsRest(classifier=LinearSVC(**{**base, **settings}), **columns, parallelism=4)
    if name == "softmax_boosting":
        return SoftmaxBooster(BoostParams(**{"seed": seed, **settings}))
    if name == "boosted_trees":
        base = dict(maxIter=100, maxDepth=4, stepSize=0.05, subsamplingRate=0.65,
                    minInstancesPerNode=10, featureSubsetStrategy="0.7", seed=seed)
        return OneVsRest(classifier=GBTClassifier(**{**base, **settings}), **columns, parallelism=4)
    if name == "mlp":
        base = dict(layers=[n_features, 128, 64, n_classes], maxIter=200, blockSize=128, seed=seed)
        return MultilayerPerceptronClassifier(**columns, **{**base, **settings})
    raise ValueError(f"unknown baseline: {name}")


