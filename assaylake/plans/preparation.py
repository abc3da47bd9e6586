"""Imputation, closure, oversampling and encoding of a training split; cross-validation.

Every fit sees training rows only, and boundaries are fitted before oversampling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from ..operators.balance import fold_targets, smote
from ..operators.composition import anhydrous
from ..operators.dedup import attach_mask
from ..operators.encode import collect_boundaries, fit_boundaries, missing_mask, quantile_encode
from ..operators.evaluate import class_metrics, confusion, log_loss, mean_ap
from ..operators.filters import drop_sparse
from ..operators.impute import ForestImputer, ForestParams, fit_imputer, impute
from ..operators.sampling import factorize, label_index, stratified_folds
from ..operators.schema import validate_labels
from ..operators.score import baseline, model_vector, predicted_index, score
from ..operators.summaries import summarize_runs
from ..session import cut_lineage


@dataclass(frozen=True)
class Prepared:
    train: DataFrame  # encoded, with masks and is_synthetic
    test: DataFrame  # encoded, with masks
    imputer: ForestImputer
    boundaries: Mapping[str, Sequence[float]]
    continuous: DataFrame  # closed training rows before oversampling and encoding


def prepare(
    train: DataFrame, test: DataFrame, cols: Sequence[str], majors: Sequence[str], label: str,
    targets: Mapping[str, int], params: ForestParams = ForestParams(), id_col: str = "sample_id",
    seed: int = 42, codes: int = 255, sparse: float = 0.8,
) -> Prepared:
    """Drop sparse rows, keep masks, impute, close majors, oversample, fit boundaries, encode."""
    train, test = drop_sparse(train, cols, sparse), drop_sparse(test, cols, sparse)
    masks = [missing_mask(t, cols, keep=[id_col]) for t in (train, test)]
    imputer = fit_imputer(train, cols, params)
    closed_train = cut_lineage(anhydrous(impute(train, imputer), majors, "domain"))
    closed_test = anhydrous(impute(test, imputer), majors, "domain")
    bounds = collect_boundaries(fit_boundaries(closed_train, cols, codes))
    balanced = smote(closed_train, cols, label, targets, seed=seed, id_col=id_col)
    encode = lambda t: quantile_encode(t, bounds, "error", codes)
    return Prepared(
        attach_mask(encode(balanced), masks[0], id_col, "is_synthetic"),
        attach_mask(encode(closed_test), masks[1], id_col),
        imputer, bounds, closed_train,
    )


def cross_validate(
    df: DataFrame, cols: Sequence[str], majors: Sequence[str], label: str,
    targets: Mapping[str, int], models: Mapping[str, Mapping], seeds: Sequence[int] = (42,),
    k: int = 5, params: ForestParams = ForestParams(), id_col: str = "sample_id",
    split_seed: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """One metrics row per fold, model and seed, and their summary.

    ``validation_loss`` is the mean negative log probability of the true class in the held-out
    fold.  ``models`` maps a baseline name to its settings.  Folds are a loop over Spark jobs; what
    comes back to the driver per fit is one row of metrics.
    """
    validate_labels(df, label, k)
    folded = cut_lineage(stratified_folds(df, label, k, split_seed, id_col))
    total = folded.count()
    index = label_index(folded, label, id_col)
    n_classes = index.count()
    runs = []
    for fold in range(k):
        inner = folded.where(F.col("fold") != fold).drop("fold")
        outer = folded.where(F.col("fold") == fold).drop("fold")
        share = fold_targets(targets, inner.count(), total)
        ready = prepare(inner, outer, cols, majors, label, share, params, id_col)
        train = model_vector(factorize(ready.train, label, id_col, index, "_y"), cols)
        test = model_vector(factorize(ready.test, label, id_col, index, "_y"), cols)
        train = cut_lineage(train.select("features", F.col("_y").cast("double").alias("label")))
        test = cut_lineage(test.select(as_col(id_col), "features", F.col("_y").alias("label")))
        for name, settings in models.items():
            for seed in seeds:
                fitted = baseline(name, seed, 2 * len(cols), n_classes, **settings).fit(train)
                rows = score(test, [fitted]).withColumn("pred", predicted_index("probs")).persist()
                metrics = class_metrics(confusion(rows, "label", "pred", n_classes)).first()
                precision = mean_ap(rows, "label", "probs").first()[0]
                loss = log_loss(rows, "label", "probs").first()[0]
                rows.unpersist()
                runs.append((fold + 1, seed, name, *[float(m) for m in metrics], float(precision), float(loss)))
    spark = df.sparkSession
    table = spark.createDataFrame(
        runs, "fold int, seed int, experiment string, accuracy double, precision double, "
        "recall double, weighted_f1 double, macro_f1 double, mAP double, validation_loss double")
    names = ["accuracy", "precision", "recall", "weighted_f1", "macro_f1", "mAP", "validation_loss"]
    return table, summarize_runs(table, metrics=names)
