"""Quantile boundaries, quantile codes, missing masks and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, count_true, missing
from .filters import unpivot
from .ordering import exact_quantiles, pick_ranks


def fit_boundaries(
    df: DataFrame, cols: Sequence[str], codes: int = 255, approximate: int | None = None
) -> DataFrame:
    """Order-statistic boundaries per feature: ``feature, boundaries``.

    Boundary ``r`` of ``codes - 1`` is the sorted value at ``min(rint(n*r/codes), n-1)``.
    ``approximate`` trades exactness for a single pass with that many centroids.
    """
    long = unpivot(df, [], cols)
    if approximate is not None:
        probs = [r / codes for r in range(1, codes)]
        return long.groupBy("feature").agg(
            F.percentile_approx("value", probs, approximate).alias("boundaries")
        )
    position = lambda r: F.least(
        F.rint(F.col("n") * r / F.lit(float(codes))).cast("bigint"), F.col("n") - 1
    )
    positions = F.transform(F.sequence(F.lit(1), F.lit(codes - 1)), position)
    picked = pick_ranks(long, ["feature"], "value", positions)
    return picked.select(
        "feature", F.transform(positions, lambda p: F.element_at("picked", p)).alias("boundaries")
    )


def fit_boundaries_linear(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Interpolated boundaries at ``k/bins`` per feature: ``feature, boundaries``."""
    probs = [k / bins for k in range(1, bins)]
    return exact_quantiles(unpivot(df, [], cols), ["feature"], "value", probs, "boundaries").drop("n")


def collect_boundaries(params: DataFrame) -> dict[str, list[float]]:
    """Fitted parameters on the driver; their size is features times boundaries, not rows."""
    return {r.feature: list(r.boundaries) for r in params.select("feature", "boundaries").collect()}


def _position(value: Column, bounds: Sequence[float]) -> Column:
    """How many sorted boundaries are below a value, by bisection."""
    if not bounds:
        return F.lit(0)
    ordered = F.array(*[F.lit(float(b)) for b in sorted(bounds)])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(ordered, at + step - 1) < value, at + step).otherwise(at))


def quantile_encode(
    df: DataFrame,
    params: Mapping[str, Sequence[float]],
    on_null: str = "error",
    codes: int = 255,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace features by ``1 + number of boundaries below``, kept inside ``1..codes``.

    NULL cells: ``error`` raises, ``zero`` gives 0, ``null`` stays NULL.  ``names`` maps a
    feature of the parameters to the column holding it.
    """
    if on_null == "error":
        empty = F.raise_error(F.lit("missing value in quantile encoding")).cast("smallint")
    elif on_null == "zero":
        empty = F.lit(0).cast("smallint")
    elif on_null == "null":
        empty = F.lit(None).cast("smallint")
    else:
        raise ValueError(f"unknown null rule: {on_null}")
    coded = {}
    for feature, bounds in params.items():
        column = (names or {}).get(feature, feature)
        if column not in df.columns:
            continue
        value = as_col(column)
        if bounds:
            code = F.greatest(F.lit(1), F.least(F.lit(codes), _position(value, bounds) + F.lit(1)))
        else:
            code = F.lit(codes)
        present = value.isNotNull() & ~F.isnan(value)
        coded[column] = F.when(present, code.cast("smallint")).otherwise(empty)
    return df.withColumns(coded)


def boundary_share(
    df: DataFrame, cols: Sequence[str], by: str = "all", codes: int = 255, id_col: str | None = None
) -> DataFrame:
    """Percent of cells at the first or last code: over all cells, per feature, or per row (count)."""
    edge = lambda c: as_col(c).isin(1, codes)
    if by == "row":
        return df.select(
            as_col(id_col), count_true([edge(c) for c in cols]).alias("boundary_feature_count")
        )
    flags = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(edge(c)).alias("_b_" + c) for c in cols]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), as_col("_b_" + c).alias("_b")) for c in cols])
    )
    per_feature = flags.select("_n", rows.alias("_f")).select("_n", "_f.*")
    if by == "feature":
        return per_feature.select(
            "feature", (F.lit(100.0) * F.col("_b") / F.col("_n")).alias("boundary_pct")
        )
    return per_feature.agg((F.lit(100.0) * F.sum("_b") / F.sum("_n")).alias("boundary_pct"))


def missing_profile(df: DataFrame, cols: Sequence[str], policy: str = "null_only") -> DataFrame:
    """Missing cells and percent per column; one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(missing(c, policy)).alias("_m_" + c) for c in cols],
    )
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("feature"), as_col("_m_" + c).alias("n_missing")) for c in cols]
        )
    )
    return counts.select("_n", rows.alias("_f")).select(
        "_f.feature", "_f.n_missing",
        (F.lit(100.0) * F.col("_f.n_missing") / F.col("_n")).alias("missing_pct"),
    )


def missing_total(profile: DataFrame) -> DataFrame:
    """Missing cells over all columns."""
    return profile.agg(F.sum("n_missing").alias("n_missing"))


def missing_mask(
    df: DataFrame, cols: Sequence[str], policy: str = "null_only", keep: Sequence[str] = ()
) -> DataFrame:
    """0/1 flags ``missing_mask__<column>`` next to the kept id columns."""
    return df.select(
        *[as_col(c) for c in keep],
        *[missing(c, policy).cast("tinyint").alias(f"missing_mask__{c}") for c in cols],
    )
