"""Bootstrap sums against the expression they stand for; exact binomial quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions.numeric import draw_hash
from assaylake.operators import uncertainty as U


@pytest.mark.parametrize("n,p", [(1, 0.3), (7, 0.5), (50, 0.02), (400, 0.97), (300, 0.0), (300, 1.0)])
def test_binomial_quantiles(n, p):
    mass = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    for level in (0.025, 0.5, 0.975):
        assert U.binomial_quantiles(n, p, [level]) == [int(np.argmax(mass >= level - 1e-12))]
    low, high = U.binomial_quantiles(10**9, 0.25, [0.025, 0.975])
    half = 1.959964 * math.sqrt(10**9 * 0.25 * 0.75)
    assert abs(low - (2.5e8 - half)) < 3 and abs(high - (2.5e8 + half)) < 3


def test_poisson_sums_equal_the_expression(spark, monkeypatch):
    monkeypatch.setattr(U, "_GROUPS_HELD", 2)
    rows = spark.range(500).select(
        (F.col("id") * 10**13 - 7 * 10**14).alias("sample_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"),
        F.sin("id").alias("x"), (F.col("id") % 9 + 0.5).alias("w")).repartition(5)
    got = {(r.g, r._rep): r._mean for r in U._poisson_means(
        rows.select("g", F.col("sample_id").alias("_id"), F.col("x").alias("_x"), F.col("w").alias("_w")), ["g"], 20, 11).collect()}
    c = U.poisson_one(draw_hash("sample_id", "rep", 11))
    want = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(20)))).groupBy("g", "rep").agg(
        (F.sum(c * F.col("w") * F.col("x")) / F.sum(c * F.col("w"))).alias("m")).collect()
    assert len(want) == len(got) == 80
    assert all(math.isclose(got[r.g, r.rep], r.m, rel_tol=1e-9) for r in want)


def test_method_does_not_depend_on_size(spark):
    rows = spark.range(300).select(F.concat(F.lit("S-"), "id").alias("sample_id"), F.cos("id").alias("x"))
    one = U.weighted_bootstrap(rows, [], "x", reps=200).first()
    assert one.n == 300 and abs(one.bootstrap_sem - one.bootstrap_sem) == 0 and 0.02 < one.bootstrap_sem < 0.06
    with pytest.raises(ValueError):
        U.weighted_bootstrap(rows, [], "x", method="auto")


@pytest.mark.parametrize("spans", [1 << 23, 160])
def test_packed_draws_equal_single_ones(spark, monkeypatch, spans):
    """Draws are packed in tasks, no longer a row each, and land on the same rows."""
    from assaylake.functions.numeric import sample_hash
    from assaylake.operators.ordering import attach, hash_rank

    monkeypatch.setattr(U, "_SPAN_DRAWN", spans)
    monkeypatch.setattr(U, "_DRAWN", 70)
    key = F.when(F.col("id") % 4 == 1, -0.0).when(F.col("id") % 4 == 2, 0.0).when(F.col("id") % 4 == 3, F.lit(float("nan")))
    rows = spark.range(300).select((F.col("id") * 10**13 - 7 * 10**14).alias("_id"), key.alias("g"), F.sin("id").alias("_x"), (F.col("id") % 9 + 0.5).alias("_w"))
    rows = attach(rows, rows.groupBy("g").agg(F.count(F.lit(1)).alias("_n")), ["g"]).repartition(5)
    made = U._multinomial_means(rows, ["g"], 20, 11)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    ranked = hash_rank(rows, ["g"], sample_hash("_id", 11), "_id", "_pos")
    draws = ranked.select("g", "_n", "_id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("_rep")).select(
        "g", "_rep", (draw_hash("_id", "_rep", 11) % F.col("_n") + 1).alias("_pos"))
    want = attach(draws, ranked.select("g", "_pos", "_x", "_w"), ["g", "_pos"], "inner").groupBy("g", "_rep").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("m")).collect()
    name = lambda g: str(g).replace("-", "")  # noqa: E731  the two zeros are one group
    got = {(name(r.g), r._rep): r._mean for r in made.collect()}
    assert len(got) == len(want) == 60
    assert all(math.isclose(got[name(r.g), r._rep], r.m, rel_tol=1e-9) for r in want)


def test_draws_are_registered_with_all_replicates(spark, monkeypatch):
    """Both methods have the 2,000 replicates of the default, in the query and in its twin."""
    from assaylake.registry import frames
    from assaylake.registry import uncertainty as R

    asked, real = [], U.weighted_bootstrap
    monkeypatch.setattr(R.U, "weighted_bootstrap", lambda df, by, x, w, reps, *a, **k: asked.append(reps) or real(df, by, x, w, 2, *a, **k))
    for name in ("m1_weighted_bootstrap", "m1_weighted_bootstrap_poisson"):
        frames.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "range(1, 2001)" in frames.ORACLE[name]
    assert asked == [2000, 2000]


def test_draws_over_several_pieces(monkeypatch):
    """Sums over pieces of a group's positions add up to the sums over all of them."""
    monkeypatch.setattr(U, "_DRAWN", 70)
    ids, w = np.arange(-50, 51) * 10**12, np.arange(101) % 5 + 0.5
    x = w * np.cos(np.arange(101))
    whole = U._multinomial_sums(ids, x, w, 0, 101, 90, 7)
    pieces = sum(U._multinomial_sums(ids, x[at:at + 40], w[at:at + 40], at, 101, 90, 7) for at in (0, 40, 80))
    assert whole.shape == (2, 90) and np.allclose(whole, pieces, rtol=1e-12)
