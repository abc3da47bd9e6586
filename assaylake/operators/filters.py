"""Row filters and the filter funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import all_true, any_true, as_col, count_true, missing, resolve_age
from ..functions.numeric import to_number
from ..functions.text import is_archean
from .composition import closed_in_bounds, closed_parts
from .ordering import attach, exact_quantiles


def min_present(df: DataFrame, cols: Sequence[str], at_least: int = 20) -> DataFrame:
    """Rows with at least so many of the columns present."""
    return df.where(count_true([as_col(c).isNotNull() for c in cols]) >= at_least)


def max_missing(
    df: DataFrame, cols: Sequence[str], below: int = 18,
    policy: str = "null_or_nonpositive", count: str = "missing_feature_count_36",
) -> DataFrame:
    """Rows with fewer missing cells than the limit; the count is kept as a column."""
    return df.withColumn(count, count_true([missing(c, policy) for c in cols])).where(
        F.col(count) < below
    )


def drop_sparse(df: DataFrame, cols: Sequence[str], share: float = 0.8) -> DataFrame:
    """Rows missing more than a share of the columns go; the limit is cut to a whole number."""
    return min_present(df, cols, int(len(cols) * (1 - share)))


def drop_all_missing(
    df: DataFrame, cols: Sequence[str], at_most: int | None = None,
    count: str = "missing_feature_count_36",
) -> DataFrame:
    """Rows with any cell present, or with at most so many missing; the count is kept."""
    limit = len(cols) if at_most is None else at_most + 1
    return max_missing(df, cols, limit, "null_only", count)


def require(df: DataFrame, cols: Sequence[str], positive: bool = False) -> DataFrame:
    """Rows with all listed columns present, or present and above 0."""
    return df.where(all_true([as_col(c) > 0 if positive else as_col(c).isNotNull() for c in cols]))


def composition_range(
    df: DataFrame,
    majors: Sequence[str] = K.LONG_MAJORS,
    bounds: Mapping[str, tuple[float, float]] | None = None,
    loi: str | None = "LOI(WT%)",
    loi_below: float = 5.0,
    keep_null_loi: bool = True,
) -> DataFrame:
    """Rows whose composition closed to 100 is in range; volatiles below a limit or unknown."""
    bounds = bounds or {
        "SIO2(WT%)": (45.0, 53.0), "MGO(WT%)": (4.5, 12.0), "AL2O3(WT%)": (12.0, 19.0),
    }
    ok = closed_in_bounds(majors, bounds)
    if loi is not None:
        low = as_col(loi) < loi_below
        ok = ok & (low | as_col(loi).isNull() if keep_null_loi else low)
    return df.where(ok)


def application_filter(
    df: DataFrame,
    features: Sequence[str] = K.SHORT_FEATURES,
    majors: Sequence[str] = K.MAJORS,
    required: Sequence[str] = K.REQUIRED_MAJORS,
    sio2: str = "SIO2", mgo: str = "MGO",
    sio2_min: float = 44.0, sio2_max: float = 54.0, mgo_max: float = 18.0,
    missing_below: int = 18,
    count: str = "missing_feature_count_36",
) -> DataFrame:
    """Gate for application rows: enough features, key majors positive, closed silica and
    magnesia in range.  Majors of the kept rows are replaced by their closed values."""
    closed = closed_parts(majors, "positive")
    gated = max_missing(df, features, missing_below, "null_or_nonpositive", count)
    bounds = {sio2: (sio2_min, sio2_max), mgo: (float("-inf"), mgo_max)}
    keep = all_true([as_col(c) > 0 for c in required]) & closed_in_bounds(majors, bounds, "positive")
    return gated.where(keep).withColumns(closed)


def allowed(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.where(as_col(col).isin(list(values)))


@dataclass(frozen=True)
class CaseArea:
    """How a geological unit is located inside a larger table."""

    label: str
    title: str
    nominal_age_ga: float
    region: str | None = None
    age_min: float | None = None
    age_max: float | None = None
    keyword: str | None = None


def locate_case(
    df: DataFrame, area: CaseArea, region: str = "Craton", reference: str = "REFERENCE",
    ages: Sequence[str] = ("C_AGE", "AGE"),
) -> DataFrame:
    """Rows of one unit: same region, age inside the range, keyword in the reference text."""
    if area.region is not None:
        df = df.where(as_col(region) == area.region)
    if area.age_min is not None or area.age_max is not None:
        age = resolve_age(ages, df.columns)
        if area.age_min is not None:
            df = df.where(age >= area.age_min)
        if area.age_max is not None:
            df = df.where(age <= area.age_max)
    if area.keyword is not None:
        df = df.where(F.lower(as_col(reference)).contains(area.keyword.lower()))
    return df


@dataclass(frozen=True)
class FunnelParams:
    """Switches and limits of the filter funnel."""

    features: Sequence[str] = field(default_factory=lambda: list(K.LONG_FEATURES))
    majors: Sequence[str] = field(default_factory=lambda: list(K.LONG_MAJORS))
    required: Sequence[str] = field(default_factory=lambda: list(K.REQUIRED_LONG_MAJORS))
    label: str = "TECTONIC SETTING"
    age: str | None = "AGE"
    age_prefix: str | None = None
    exclude_archean: bool = True
    require_majors: bool = True
    sio2: str = "SIO2(WT%)"
    sio2_range: tuple[float, float] | None = (45.0, 53.0)
    pair_ranges: Mapping[str, tuple[float, float]] | None = field(
        default_factory=lambda: {"MGO(WT%)": (4.5, 12.0), "AL2O3(WT%)": (12.0, 19.0)}
    )
    loi: str | None = "LOI(WT%)"
    loi_below: float = 5.0
    keep_null_loi: bool = True
    min_present: int | None = 20
    completeness_first: bool = False


def funnel_steps(params: FunnelParams) -> list[tuple[str, Column]]:
    """Named row conditions in the order they apply."""
    complete = []
    if params.min_present is not None:
        present = count_true([as_col(c).isNotNull() for c in params.features])
        complete.append(("after_min_non_nan", present >= params.min_present))
    required = []
    if params.require_majors:
        required.append(
            ("after_require_major_oxides",
             all_true([as_col(c).isNotNull() for c in params.required]))
        )
    steps: list[tuple[str, Column]] = []
    if params.exclude_archean and params.age is not None:
        steps.append(("after_exclude_archean", ~is_archean(params.age, params.age_prefix)))
    steps += complete + required if params.completeness_first else required
    if params.sio2_range is not None or params.pair_ranges is not None:
        steps.append(("after_anhydrous_normalization_ready", closed_in_bounds(params.majors, {})))
    if params.sio2_range is not None:
        steps.append(("after_sio2", closed_in_bounds(params.majors, {params.sio2: params.sio2_range})))
    if params.pair_ranges is not None:
        steps.append(("after_mgo_al2o3", closed_in_bounds(params.majors, params.pair_ranges)))
    if params.loi is not None:
        low = as_col(params.loi) < params.loi_below
        steps.append(
            ("after_loi", low | as_col(params.loi).isNull() if params.keep_null_loi else low)
        )
    if not params.completeness_first:
        steps += complete
    return steps


def filter_funnel(df: DataFrame, params: FunnelParams) -> tuple[DataFrame, DataFrame]:
    """Surviving rows, and rows left after every step by label.

    The statistics take one pass and one aggregation: a row's number of passed steps says at
    which step it drops out.
    """
    steps = funnel_steps(params)
    names = ["raw_input"] + [name for name, _ in steps]
    flags = F.array(*[F.coalesce(condition, F.lit(False)) for _, condition in steps])
    # Position of the first failed step, 0 when all hold.
    failed = F.array_position(flags, F.lit(False))
    survivors = df.where(failed == 0)
    counts = df.groupBy(
        F.coalesce(as_col(params.label), F.lit("UNKNOWN")).alias("label"), failed.alias("_f")
    ).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("step_no"), F.lit(n).alias("step"),
                    F.when((F.col("_f") == 0) | (F.col("_f") > i), F.col("_n"))
                    .otherwise(F.lit(0)).alias("n"),
                )
                for i, n in enumerate(names)
            ]
        )
    )
    stats = counts.select("label", rows.alias("s")).groupBy("s.step_no", "s.step", "label").agg(
        F.sum("s.n").alias("n")
    )
    return survivors, stats


def funnel_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("step_no", "step").agg(F.sum("n").alias("total_rows"))


def iqr_filter(df: DataFrame, cols: Sequence[str], k: float = 6.0) -> DataFrame:
    """Drop rows with any value outside ``q1 - k*iqr .. q3 + k*iqr`` of its column.

    NULL is never an outlier, a column with zero range is skipped, absent columns are ignored.
    """
    cols = [c for c in cols if c in df.columns]
    fences = _fences(df, cols, k)
    wide = attach(df, fences, [])
    out = [
        F.coalesce((as_col(c) < as_col("_lo_" + c)) | (as_col(c) > as_col("_hi_" + c)), F.lit(False))
        for c in cols
    ]
    return wide.where(~any_true(out)).select(*[as_col(c) for c in df.columns])


def _fences(df: DataFrame, cols: Sequence[str], k: float) -> DataFrame:
    long = unpivot(df, [], cols)
    quartiles = exact_quantiles(long, ["feature"], "value", [0.25, 0.75])
    q1, q3 = F.get("q", 0), F.get("q", 1)
    spread = F.nullif(q3 - q1, F.lit(0.0))
    per_feature = quartiles.select(
        "feature", (q1 - F.lit(k) * spread).alias("lo"), (q3 + F.lit(k) * spread).alias("hi")
    )
    return per_feature.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("lo"))).alias("_lo_" + c) for c in cols],
        *[F.max(F.when(F.col("feature") == c, F.col("hi"))).alias("_hi_" + c) for c in cols],
    )


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], value: str = "value") -> DataFrame:
    """One row per (row, column): ids, ``feature`` and the value as a number."""
    return df.select(
        *[as_col(c) for c in ids],
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), as_col(c).cast("double").alias(value))
                    for c in cols
                ]
            )
        ).alias("_f"),
    ).select(*[as_col(c) for c in ids], "_f.feature", f"_f.{value}")


def exclude_record(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows known to be bad; an unknown predicate keeps the row."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def valid_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with finite x above 0 and finite y not below 0."""
    xs, ys = to_number(x), to_number(y)
    finite = (xs < float("inf")) & (ys < float("inf"))
    return df.where((xs > 0) & (ys >= 0) & finite)


def class_quantile_band(
    df: DataFrame, label: str, feature: str, lo: float, hi: float,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Rows inside the quantile band of their own class; other classes pass when ``only`` is set."""
    picked = df if only is None else df.where(as_col(label).isin(list(only)))
    bands = exact_quantiles(picked, [label], feature, [lo, hi], "_band")
    wide = attach(df, bands.drop("n"), [label])
    inside = as_col(feature).between(F.get("_band", 0), F.get("_band", 1))
    if only is not None:
        inside = inside | F.col("_band").isNull()
    return wide.where(inside).drop("_band")
