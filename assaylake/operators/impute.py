"""Scaling and forest imputation.

A fit gives a small parameter object (means, deviations, forests); applying it is a narrow
projection.  Fits must see training rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from math import exp, prod
from operator import add

import numpy as np
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, missing
from ..session import cut_lineage, drop_folder, scratch_folder
from .filters import unpivot
from .ordering import attach, exact_median

FLOAT_MAX = 3.4028234663852886e38  # largest single-precision number
MOST_CELLS = 2**19  # cells of a column's predictors that are still fitted as a grid; 64 bins of three predictors are 2**18
ROWS_PER_CELL = 16  # rows a cell must stand for on average; below, Spark's fit reads the rows themselves
TREES_A_PASS = 16  # trees whose draws are summed in one pass over the rows


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a deviation of 0 counts as 1."""

    mean: Mapping[str, float]
    std: Mapping[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.mean)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """One aggregation; NULL cells are ignored."""
    row = df.agg(
        *[F.avg(as_col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(as_col(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return Scaler(
        {c: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(cols)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(cols)},
    )


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns(
        {c: (as_col(c) - F.lit(scaler.mean[c])) / F.lit(scaler.std[c]) for c in scaler.columns}
    )


def unscale(df: DataFrame, scaler: Scaler, clip: bool = False) -> DataFrame:
    """Back to the original units; optionally nothing below 0."""
    out = {c: as_col(c) * F.lit(scaler.std[c]) + F.lit(scaler.mean[c]) for c in scaler.columns}
    if clip:
        out = {c: F.greatest(v, F.lit(0.0)) for c, v in out.items()}
    return df.withColumns(out)


@dataclass(frozen=True)
class ForestParams:
    trees: int = 300
    max_depth: int = 30
    feature_share: str = "0.8"
    max_bins: int = 64
    seed: int = 42
    indicators: bool = False  # also use missing flags of the predictors
    chained: bool = True  # predictors see values filled earlier in column order
    parallel_fits: int = 4
    cut_every: int = 6


@dataclass(frozen=True)
class Grid:
    """Cells of a column's predictors: one digit per predictor, counted from its bin and its missing flag.

    ``cuts`` are inner ends of bins, [lower, upper), by position of the predictor.  A filled cell of a
    chained column has both a bin and its flag; otherwise a flagged cell always lies where 0 does.
    """

    cuts: Mapping[int, Sequence[float]]
    indicators: bool
    chained: bool

    def _bins(self, i: int) -> int:
        return len(self.cuts[i]) + 1

    def _digits(self, i: int) -> int:
        return self._bins(i) * (2 if self.chained else 1) + (not self.chained) if self.indicators else self._bins(i)

    @property
    def size(self) -> int:
        return prod(self._digits(i) for i in self.cuts)

    def bin(self, df: DataFrame, i: int) -> DataFrame:
        """``_b{i}``: the bin of ``_x{i}``, NaN in the last one."""
        if not self.cuts[i]:
            return df.withColumn(f"_b{i}", F.lit(0))
        ends = [-float("inf"), *self.cuts[i], float("inf")]
        binned = Bucketizer(splits=ends, inputCol=f"_x{i}", outputCol=f"_b{i}", handleInvalid="keep").transform(df)
        return binned.withColumn(f"_b{i}", F.least(F.col(f"_b{i}").cast("int"), F.lit(self._bins(i) - 1)))

    def cell(self) -> Column:
        """Number of a row's cell, from its bins and flags."""
        number = F.lit(0).cast("bigint")
        for i in self.cuts:
            digit, flag = F.col(f"_b{i}"), F.col(f"_m{i}") > 0
            if self.indicators and self.chained:
                digit = digit + F.when(flag, F.lit(self._bins(i))).otherwise(F.lit(0))
            elif self.indicators:
                digit = F.when(flag, F.lit(self._bins(i))).otherwise(digit)
            number = number * F.lit(self._digits(i)) + digit
        return number

    def vectors(self, df: DataFrame, cell: str) -> DataFrame:
        """``_v``: bins and then flags of a numbered cell."""
        rest, bins, flags = as_col(cell), {}, {}
        for i in reversed(list(self.cuts)):
            digit, last = rest % F.lit(self._digits(i)), F.lit(self._bins(i))
            at_zero = F.lit(int(np.searchsorted(self.cuts[i], 0.0, "right")))
            bins[f"_x{i}"] = (digit % last if self.chained or not self.indicators else F.when(digit == last, at_zero).otherwise(digit)).cast("double")
            flags[f"_m{i}"] = (digit >= last).cast("double")
            rest = F.floor(rest / F.lit(self._digits(i)))
        parts = [*reversed(bins), *(reversed(flags) if self.indicators else [])]
        out = VectorAssembler(inputCols=parts, outputCol="_v").transform(df.withColumns({**bins, **flags}))
        return out.drop(*bins, *flags)


@dataclass(frozen=True)
class GridForest:
    """The mean of a forest's trees in every cell of a grid: ``_cell``, ``_p``."""

    grid: Grid
    trees: Sequence[RandomForestRegressionModel]
    values: DataFrame


@dataclass(frozen=True)
class ForestImputer:
    columns: Sequence[str]
    models: Mapping[str, RandomForestRegressionModel | GridForest]
    params: ForestParams
    scaler: Scaler | None = field(default=None)


def _finite(c: Column) -> Column:
    """Predictor value: missing as 0, infinite as the largest single-precision number."""
    big = F.lit(FLOAT_MAX)
    capped = F.when(c == float("inf"), big).when(c == float("-inf"), big).otherwise(c)
    return F.coalesce(capped, F.lit(0.0))


def _predictors(target: str, cols: Sequence[str], indicators: bool) -> list[str]:
    others = [i for i, c in enumerate(cols) if c != target]
    names = [f"_x{i}" for i in others]
    if indicators:
        names += [f"_m{i}" for i in others]
    return names


def fit_forest_imputer(
    df: DataFrame, cols: Sequence[str], params: ForestParams = ForestParams(),
    scaler: Scaler | None = None,
) -> ForestImputer:
    """One forest regressor per column on the other columns, over rows where it is observed.

    Columns without any observation get no model.  The prepared table is written once to the shared
    scratch folder, so that a lost executor costs no more than its tasks, and deleted after the fits.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "forests")
    try:
        df.select(*[as_col(c).alias(f"_y{i}") for i, c in enumerate(cols)]).write.parquet(f"{folder}/cells")
        prepared = spark.read.parquet(f"{folder}/cells").select(
            "*",
            *[_finite(F.col(f"_y{i}")).alias(f"_x{i}") for i in range(len(cols))],
            *[F.col(f"_y{i}").isNull().cast("double").alias(f"_m{i}") for i in range(len(cols))],
        )
        return _fit_forests(prepared, cols, params, scaler, folder)
    finally:
        drop_folder(spark, folder)


def _cuts(prepared: DataFrame, n: int, bins: int) -> tuple[list[int], list[list[float]]]:
    """Observed cells and inner ends of bins per column: between all values where they are at most
    ``bins``, at approximate quantiles otherwise."""
    value = lambda i: F.nanvl(F.col(f"_x{i}"), F.lit(None).cast("double"))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = prepared.agg(
        *[F.count(f"_y{i}").alias(f"n{i}") for i in range(n)],
        *[F.approx_count_distinct(value(i)).alias(f"d{i}") for i in range(n)],
        *[F.percentile_approx(value(i), shares, F.lit(2000)).alias(f"q{i}") for i in range(n)],
    ).first()
    few = [i for i in range(n) if row[f"d{i}"] <= 2 * bins]
    sets = prepared.agg(F.count(F.lit(1)), *[F.collect_set(value(i)).alias(f"s{i}") for i in few]).first()
    cuts = []
    for i in range(n):
        values = np.unique(sets[f"s{i}"]) if i in few else []
        if i in few and len(values) <= bins:
            found = values[:-1] + np.diff(values) / 2
        else:
            found = np.unique(row[f"q{i}"] or [])
        cuts.append([float(v) for v in np.unique(found)])
    return [row[f"n{i}"] for i in range(n)], cuts


def _poisson(u: Column) -> Column:
    """Poisson number of mean 1 for a uniform number in [0, 1)."""
    share = total = exp(-1.0)
    number = F.when(u < total, F.lit(0.0))
    for k in range(1, 18):  # the rest has a share below 1e-16
        share /= k
        total += share
        number = number.when(u < total, F.lit(float(k)))
    return number.otherwise(F.lit(18.0))


def _fit_grid(
    prepared: DataFrame, i: int, grid: Grid, params: ForestParams, folder: str
) -> GridForest:
    """The forest of one column over the cells of its predictors.

    A split lies between bins, so a tree needs no more of its rows than their number and sum in every
    cell: rows are drawn tree by tree, summed by cell in one pass, and Spark's fit of a tree reads the
    weighted means of at most ``MOST_CELLS`` cells instead of all rows at every level.
    """
    spark = prepared.sparkSession
    rows = prepared.where(F.col(f"_y{i}").isNotNull())
    for j in grid.cuts:
        rows = grid.bin(rows, j)
    rows = rows.select(grid.cell().alias("_cell"), F.col(f"_y{i}").cast("double").alias("_t"))
    trees = []
    for first in range(0, params.trees, TREES_A_PASS):
        batch = range(first, min(first + TREES_A_PASS, params.trees))
        drawn = rows.withColumns({f"_u{t}": F.rand(params.seed + 1_000_003 * (i * params.trees + t + 1)) for t in batch})
        drawn = drawn.withColumns({f"_w{t}": _poisson(F.col(f"_u{t}")) for t in batch})
        sums = drawn.groupBy("_cell").agg(
            *[F.sum(f"_w{t}").alias(f"_w{t}") for t in batch],
            *[F.sum(F.col(f"_w{t}") * F.col("_t")).alias(f"_s{t}") for t in batch],
        )
        path = f"{folder}/sums-{i}-{first}"
        sums.write.parquet(path)
        known = grid.vectors(spark.read.parquet(path), "_cell")
        for t in batch:
            cells = known.where(F.col(f"_w{t}") > 0).select(
                "_v", (F.col(f"_s{t}") / F.col(f"_w{t}")).alias("_t"), F.col(f"_w{t}").alias("_w"))
            trees.append(RandomForestRegressor(
                featuresCol="_v", labelCol="_t", weightCol="_w", numTrees=1, bootstrap=False,
                maxDepth=params.max_depth, featureSubsetStrategy=params.feature_share,
                maxBins=params.max_bins, seed=params.seed + t, maxMemoryInMB=512,
            ).fit(cells))
    values = grid.vectors(spark.range(grid.size).withColumnRenamed("id", "_cell"), "_cell")
    for t, tree in enumerate(trees):
        values = tree.setPredictionCol(f"_p{t}").transform(values)
    mean = reduce(add, [F.col(f"_p{t}") for t in range(len(trees))]) / F.lit(float(len(trees)))
    return GridForest(grid, trees, cut_lineage(values.select("_cell", mean.alias("_p"))))


def _fit_forests(
    prepared: DataFrame, cols: Sequence[str], params: ForestParams, scaler: Scaler | None, folder: str
) -> ForestImputer:
    observed, cuts = _cuts(prepared, len(cols), params.max_bins)

    def fit(i: int) -> RandomForestRegressionModel | GridForest:
        grid = Grid({j: cuts[j] for j in range(len(cols)) if j != i}, params.indicators, params.chained)
        if len(cols) > 1 and grid.size <= min(MOST_CELLS, observed[i] // ROWS_PER_CELL):
            return _fit_grid(prepared, i, grid, params, folder)
        inputs = _predictors(cols[i], cols, params.indicators)
        rows = VectorAssembler(inputCols=inputs, outputCol="_v").transform(
            prepared.where(F.col(f"_y{i}").isNotNull())
        ).select("_v", F.col(f"_y{i}").alias("_t"))
        return RandomForestRegressor(
            featuresCol="_v", labelCol="_t", numTrees=params.trees, maxDepth=params.max_depth,
            featureSubsetStrategy=params.feature_share, maxBins=params.max_bins,
            seed=params.seed, maxMemoryInMB=512,
        ).fit(rows)

    wanted = [i for i in range(len(cols)) if observed[i]]
    with ThreadPoolExecutor(params.parallel_fits) as pool:
        models = dict(zip([cols[i] for i in wanted], pool.map(fit, wanted)))
    return ForestImputer(list(cols), models, params, scaler)


def apply_forest_imputer(df: DataFrame, imputer: ForestImputer) -> DataFrame:
    """Fill missing cells column by column.

    Chained: a later column sees the filled earlier ones.  Otherwise predictors are always the
    original zero-filled values.  A forest over a grid is looked up: its cells, ``MOST_CELLS`` at most,
    are broadcast, and only rows whose cell is missing meet them.  Lineage is cut every few columns.
    """
    cols = list(imputer.columns)
    work = df.withColumns(
        {
            **{f"_x{i}": _finite(as_col(c)) for i, c in enumerate(cols)},
            **{f"_m{i}": as_col(c).isNull().cast("double") for i, c in enumerate(cols)},
        }
    )
    done = 0
    for i, c in enumerate(cols):
        model = imputer.models.get(c)
        if model is None:
            continue
        if isinstance(model, GridForest):
            for j in model.grid.cuts:
                work = model.grid.bin(work, j)
            work = work.withColumn("_cell", F.when(as_col(c).isNull(), model.grid.cell()))
            work = work.join(F.broadcast(model.values), "_cell", "left").drop("_cell", *[f"_b{j}" for j in model.grid.cuts])
        else:
            inputs = _predictors(c, cols, imputer.params.indicators)
            work = VectorAssembler(inputCols=inputs, outputCol="_v").transform(work)
            work = model.copy().setFeaturesCol("_v").setPredictionCol("_p").transform(work).drop("_v")
        filled = F.when(as_col(c).isNull(), F.col("_p")).otherwise(as_col(c))
        changed = {c: filled}
        if imputer.params.chained:
            changed[f"_x{i}"] = F.when(as_col(c).isNull(), F.col("_p")).otherwise(F.col(f"_x{i}"))
        work = work.withColumns(changed).drop("_p")
        done += 1
        if done % imputer.params.cut_every == 0 and i + 1 < len(cols):
            work = cut_lineage(work)
    work = work.drop(*[f"_x{i}" for i in range(len(cols))], *[f"_m{i}" for i in range(len(cols))])
    # A column that was empty in training is filled with 0, as its predictors were.
    left = {c: F.coalesce(as_col(c), F.lit(0.0)) for c in cols if c not in imputer.models}
    return work.withColumns(left) if left else work


def fit_imputer(
    train: DataFrame, cols: Sequence[str], params: ForestParams = ForestParams(),
    standardize: bool = True,
) -> ForestImputer:
    """Scaler and forests from training rows."""
    scaler = fit_scaler(train, cols) if standardize else None
    return fit_forest_imputer(scale(train, scaler) if scaler else train, cols, params, scaler)


def impute(df: DataFrame, imputer: ForestImputer) -> DataFrame:
    """Fill missing cells in original units; scaled imputers clip results at 0."""
    if imputer.scaler is None:
        return apply_forest_imputer(df, imputer)
    filled = apply_forest_imputer(scale(df, imputer.scaler), imputer)
    return unscale(filled, imputer.scaler, clip=True)


def median_impute(
    ref: DataFrame, app: DataFrame, cols: Sequence[str], policy: str = "null_or_nonpositive"
) -> DataFrame:
    """Missing cells of the application table set to the reference median of their column."""
    medians = exact_median(unpivot(ref, [], cols), ["feature"], "value", "median")
    row = medians.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias("_md_" + c) for c in cols]
    )
    wide = attach(app, row, [])
    return wide.withColumns(
        {c: F.when(missing(c, policy), as_col("_md_" + c)).otherwise(as_col(c)) for c in cols}
    ).select(*[as_col(c) for c in app.columns])
