"""Forests over cells of bins: the trees of Spark's fit over rows, read from bounded tables."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from assaylake.operators import impute

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def holes(spark):
    """Three dependent columns; some cells of b and c are missing."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(-20, 20, 6000) / 4, rng.integers(0, 12, 6000) * 0.7
    c = np.clip(np.round(a * b + np.where(a > 1, 9, 0) + rng.normal(size=6000)), -15, 15)
    b, c = np.where(rng.random(6000) < 0.1, np.nan, b), np.where(rng.random(6000) < 0.2, np.nan, c)
    df = spark.createDataFrame([(i, *[float(x) for x in v]) for i, v in enumerate(zip(a, b, c))], "id int, a double, b double, c double")
    return df.withColumns({k: F.nanvl(k, F.lit(None).cast("double")) for k in "bc"})


@pytest.mark.parametrize("indicators, chained", [(False, False), (True, False), (False, True), (True, True)])
def test_grid_equals_tree_over_rows(spark, holes, monkeypatch, indicators, chained):
    """With every row drawn once, a tree over weighted cells fills what Spark's tree over rows does."""
    monkeypatch.setattr(impute, "_poisson", lambda u: F.lit(1.0) + u * 0)
    monkeypatch.setattr(impute, "ROWS_PER_CELL", 0.001)
    params = impute.ForestParams(trees=1, max_depth=4, feature_share="all", max_bins=256, indicators=indicators, chained=chained)
    imputer = impute.fit_forest_imputer(holes, COLS, params)
    assert all(isinstance(m, impute.GridForest) for m in imputer.models.values())
    got = {r.id: r for r in impute.apply_forest_imputer(holes, imputer).collect()}
    assert len(got) == 6000
    work = holes.select("id", *COLS, *[F.col(c).isNull().cast("double").alias("m" + c) for c in COLS], *[F.coalesce(c, F.lit(0.0)).alias("x" + c) for c in COLS])
    filled = work
    for t in "bc":
        inputs = [p + c for p in ("xm" if indicators else "x") for c in COLS if c != t]
        vec = VectorAssembler(inputCols=inputs, outputCol="v")
        tree = DecisionTreeRegressor(featuresCol="v", labelCol=t, maxDepth=4, maxBins=256).fit(vec.transform(work).where(F.col(t).isNotNull()))
        filled = tree.setPredictionCol("p" + t).transform(vec.transform(filled)).drop("v")
        if chained:
            filled = filled.withColumn("x" + t, F.when(F.col(t).isNull(), F.col("p" + t)).otherwise(F.col("x" + t)))
    for r in filled.collect():
        for t in "bc":
            assert got[r.id][t] == pytest.approx(r["p" + t] if r[t] is None else r[t], abs=1e-9)


def test_fit_reads_cells_not_rows(holes, monkeypatch):
    """A table of many rows per cell is summed before the fit, and the forest is as good as Spark's over rows."""
    read = []
    plain = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df: read.append(df.count()) or plain(self, df))
    many = holes.crossJoin(holes.sparkSession.range(8))
    params = impute.ForestParams(trees=8, max_depth=6, chained=False)
    fill = lambda p: np.array([[r.b, r.c] for r in impute.impute(holes, impute.fit_imputer(many, COLS, p)).orderBy("id").collect()])
    grid = fill(params)
    assert max(read) <= 40 * 32 < 8 * 4000
    monkeypatch.setattr(impute, "MOST_CELLS", 0)
    rows = fill(params)
    assert max(read) > 8 * 4000
    hole = np.array([[r.b is None, r.c is None] for r in holes.orderBy("id").collect()])
    assert np.array_equal(grid[~hole], rows[~hole])
    for k in (0, 1):
        assert np.corrcoef(grid[hole[:, k], k], rows[hole[:, k], k])[0, 1] > 0.95


def test_draws_are_poisson(spark):
    """Numbers from 0 up with mean and variance 1; cuts lie between values, or at quantiles of many."""
    n = spark.range(200_000).withColumn("u", F.rand(5)).select(impute._poisson(F.col("u")).alias("n"))
    row = n.agg(F.avg("n").alias("m"), F.variance("n").alias("v"), F.avg((F.col("n") == 0).cast("int")).alias("z")).first()
    assert row.m == pytest.approx(1, abs=0.02) and row.v == pytest.approx(1, abs=0.03) and row.z == pytest.approx(np.exp(-1), abs=0.01)
    df = spark.range(10_000).select((F.col("id") % 3).cast("double").alias("_x0"), F.col("id").cast("double").alias("_x1"), F.lit(4.0).alias("_x2"),
                                    *[F.lit(1.0).alias(f"_y{i}") for i in range(3)])
    observed, cuts = impute._cuts(df, 3, 8)
    assert observed == [10_000] * 3 and cuts[0] == [0.5, 1.5] and cuts[2] == []
    assert len(cuts[1]) == 7 and np.allclose(cuts[1], np.arange(1, 8) * 1250, atol=20)
