"""Seeded draws: balance along the ids, independence of seeds, ids of any type."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions.numeric import HASH_SPAN, draw_hash, sample_hash, wide_draw
from assaylake.operators import sampling, uncertainty

PATTERNS = {
    "dense": "id", "strided": "id * 1000", "four_columns": "(id DIV 7) * 10000000000 + (id % 2000) * 100000 + (id % 100) * 10 + id % 7",
    "negative": "-id - 1", "text": "concat('S-', id)",
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_draws_are_spread_and_seeds_independent(spark, pattern):
    df = spark.range(20000).select(F.expr(PATTERNS[pattern]).alias("sample_id"), F.col("id").alias("place"), F.lit("a").alias("label"))
    picks = {}
    for seed in (1, 42, 32, 43):
        split = sampling.stratified_split(df, "label", 0.2, seed=seed)
        picks[seed] = {r.place for r in split.where("split = 'test'").collect()}
        assert len(picks[seed]) == 4000
        per = [sum(p // 100 == k for p in picks[seed]) for k in range(200)]
        variance = sum((x - 20) ** 2 for x in per) / 200
        assert 11 < variance < 22, (seed, variance)  # binomial: 16
    for a, b in ((1, 42), (32, 43)):
        assert 660 < len(picks[a] & picks[b]) < 940  # expected: 800


def test_samples_folds_and_wide_draws(spark):
    df = spark.range(1000).select(F.concat(F.lit("S-"), "id").alias("sample_id"), (F.col("id") % 3).alias("label"))
    one, two = ({r.sample_id for r in sampling.sample_n(df, 100, s, "sample_id").collect()} for s in (1, 2))
    assert len(one) == len(two) == 100 and len(one & two) < 30
    folds = sampling.stratified_folds(df, "label", 5, 1).groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds} <= {66, 67}
    assert sample_hash("sample_id", 1) is not None
    top = spark.range(5000).select(wide_draw("id", 0, 7).alias("w")).agg(F.min("w"), F.max("w"), F.avg("w")).first()
    assert 0 <= top[0] < HASH_SPAN ** 2 * 0.01 and top[1] > HASH_SPAN ** 2 * 0.99 and abs(top[2] / HASH_SPAN ** 2 - 0.5) < 0.02


def test_draws_of_different_rows_never_repeat(spark):
    """Also of ids that agree in small remainders, and far beyond 2**31 rows."""
    rng = np.random.default_rng(12)
    ids = np.unique(np.concatenate([rng.integers(0, 1 << 60, 200_000), np.arange(2000), np.arange(2000) + 1000003 * 999983,
                                    np.arange(2000) + HASH_SPAN, np.arange(2000) + HASH_SPAN * 7]))
    rows = spark.createDataFrame([(int(i),) for i in ids], "id long").select(
        *[draw_hash("id", F.lit(j), 20240611).alias(f"d{j}") for j in range(1, 5)])
    draws = np.array([tuple(r) for r in rows.collect()], np.int64)
    assert len(np.unique(draws, axis=0)) == len(ids)
    unit = draws / HASH_SPAN
    assert np.abs(unit.mean(0) - 0.5).max() < 0.005 and np.abs(np.corrcoef(unit.T) - np.eye(4)).max() < 0.01
    shifted = np.abs(np.corrcoef(unit[:-1, 0], unit[1:, 0])[0, 1])
    assert shifted < 0.01
    small = [int(i) for i in ids[:500]]
    x = np.arange(500.0)
    sums = uncertainty._poisson_sums(np.array(small), x, np.ones(500), 3, 5)
    frame = spark.createDataFrame([(i, float(v)) for i, v in zip(small, x)], "id long, x double")
    for rep in (1, 2, 3):
        c = uncertainty.poisson_one(draw_hash("id", F.lit(rep), 5))
        got = frame.select(c.alias("c"), "x").agg(F.sum(F.col("c") * F.col("x")), F.sum("c")).first()
        assert tuple(got) == tuple(sums[:, rep - 1])
