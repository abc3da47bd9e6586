"""Minority oversampling between neighbours of the same class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from ..functions.numeric import HASH_SPAN, as_col, draw_hash, sample_hash, wide_draw
from .dedup import union_all
from .impute import Scaler, fit_scaler
from .neighbours import PivotIndex, nearest_vectors
from .ordering import hash_rank
from .schema import validate_features


def sampling_strategy(
    counts: Mapping[str, int], targets: Mapping[str, int] | int
) -> dict[str, int]:
    """Targets of the labels still below theirs; an absent target label is an error.

    A single number is a target for every label.
    """
    if isinstance(targets, int):
        targets = {label: targets for label in counts}
    absent = [label for label in targets if label not in counts]
    if absent:
        raise ValueError(f"target labels not in the data: {absent}")
    return {label: t for label, t in targets.items() if counts[label] < t}


def parse_targets(text: str) -> dict[str, int]:
    """``LABEL=COUNT`` lines."""
    out = {}
    for line in filter(None, (raw.strip() for raw in text.splitlines())):
        label, sep, count = line.rpartition("=")
        if not sep:
            raise ValueError(f"expected LABEL=COUNT, got {line!r}")
        out[label.strip()] = int(count.strip())
    return out


def fold_targets(targets: Mapping[str, int], fold_rows: int, all_rows: int) -> dict[str, int]:
    """Targets scaled to the share of rows in a fold."""
    return {label: round(t * (fold_rows / all_rows)) for label, t in targets.items()}


def smote(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    targets: Mapping[str, int] | int | None = None,
    k: int = 5,
    seed: int = 42,
    id_col: str = "sample_id",
    standardize: bool = True,
) -> DataFrame:
    """Lift labels to their target with points between a row and one of its k neighbours.

    Adds ``is_synthetic``.  Synthetic rows carry features, label and a negative id; all other
    columns are NULL (text ids are ``synthetic-1`` and so on).  With ``standardize`` distances and interpolation use standardised
    features and results are clipped at 0.  Base row, neighbour and position are hash draws, so
    the result does not depend on partitioning.
    """
    targets = dict(K.OVERSAMPLE_TARGETS) if targets is None else targets
    validate_features(df, cols)
    counts = {
        r[0]: r[1]
        for r in df.groupBy(as_col(label)).agg(F.count(F.lit(1))).collect()
    }
    strategy = sampling_strategy(counts, targets)
    originals = df.withColumn("is_synthetic", F.lit(False))
    if not strategy:
        return originals
    smallest = min(counts[name] for name in strategy)
    if smallest <= 1:
        raise ValueError("a label with a single row cannot be oversampled")
    scaler = fit_scaler(df, cols) if standardize else Scaler(
        {c: 0.0 for c in cols}, {c: 1.0 for c in cols}
    )
    near = min(k, smallest - 1)
    made, first_id = [], 1
    for number, (name, target) in enumerate(sorted(strategy.items())):
        deficit = target - counts[name]
        made.append(
            _synthetic(
                df.where(as_col(label) == name), cols, label, name, deficit, counts[name], near,
                seed + 1000003 * number, id_col, scaler, standardize, first_id,
            )
        )
        first_id += deficit
    return originals.unionByName(union_all(*made), allowMissingColumns=True)


def _synthetic(
    members: DataFrame, cols: Sequence[str], label: str, name: str, deficit: int, rows: int,
    k: int, seed: int, id_col: str, scaler: Scaler, clip: bool, first_id: int,
) -> DataFrame:
    point = F.array(
        *[(as_col(c).cast("double") - F.lit(scaler.mean[c])) / F.lit(scaler.std[c]) for c in cols]
    )
    points = members.select(as_col(id_col), point.alias("point"))
    ranked = hash_rank(points, [], sample_hash(id_col, seed), id_col).select("_rank", "point")
    draws = members.sparkSession.range(deficit).select(
        F.col("id").alias("_j"),
        (wide_draw("id", 0, seed) % F.lit(rows) + 1).alias("_rank"),
        (draw_hash("id", F.lit(1), seed) % F.lit(k)).cast("int").alias("_pick"),
        (draw_hash("id", F.lit(2), seed) / F.lit(float(HASH_SPAN))).alias("_u"),
    )
    based = draws.join(ranked, "_rank")
    index = PivotIndex(points, "point", seed % 1000)
    found = nearest_vectors(index, based, "point", k, skip_self=True).select(
        F.col("vec").alias("_vec"),
        F.flatten(F.transform("found", lambda f: F.array_repeat(f["vec"], f["times"]))).alias("_nn"),
    )
    mixed = based.join(found, F.col("point") == F.col("_vec")).select(
        "_j",
        F.zip_with(
            "point", F.get("_nn", F.col("_pick")), lambda x, y: x + F.col("_u") * (y - x)
        ).alias("new"),
    )
    restored = [
        F.get("new", i) * F.lit(scaler.std[c]) + F.lit(scaler.mean[c]) for i, c in enumerate(cols)
    ]
    if clip:
        restored = [F.greatest(v, F.lit(0.0)) for v in restored]
    made_id = -(F.col("_j") + F.lit(first_id))
    if members.schema[id_col].dataType == StringType():
        made_id = F.concat(F.lit("synthetic"), made_id.cast("string"))
    return mixed.select(
        made_id.alias(id_col),
        *[v.alias(c) for c, v in zip(cols, restored)],
        F.lit(name).alias(label),
        F.lit(True).alias("is_synthetic"),
    )


def attach_metadata(
    resampled: DataFrame, original: DataFrame, id_col: str, columns: Sequence[str]
) -> DataFrame:
    """Metadata of the original rows joined back by id; synthetic rows stay NULL."""
    kept = [c for c in resampled.columns if c not in columns]
    return resampled.select(*[as_col(c) for c in kept]).join(
        original.select(as_col(id_col), *[as_col(c) for c in columns]), id_col, "left"
    )
