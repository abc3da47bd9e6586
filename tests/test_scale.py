"""Exactness under ties, skew and different partitionings; brute-force comparisons."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions.numeric import sample_hash
from assaylake.operators import balance, domain, impute, neighbours, ordering, sampling, uncertainty


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, and one key holds most rows."""
    rng = np.random.default_rng(0)
    x = np.round(rng.lognormal(0, 3, 6000) * rng.choice([-1, 1], 6000), 4)
    x[:2000] = 1.25
    x[2000:2010] = 0.0
    key = np.where(np.arange(6000) % 7 == 0, "b", "a")
    rows = [(i, str(k), float(v)) for i, (k, v) in enumerate(zip(key, x))]
    return spark.createDataFrame(rows, "id bigint, k string, v double"), key, x


def test_quantiles_equal_numpy(skewed):
    df, key, x = skewed
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 0.999, 1.0]
    for parts in (1, 8):
        got = {r.k: r for r in ordering.exact_quantiles(df.repartition(parts), ["k"], "v", probs).collect()}
        for k in "ab":
            assert got[k].q == pytest.approx(np.quantile(x[key == k], probs).tolist())
            assert got[k].n == (key == k).sum()


def test_running_sums_equal_sorted(skewed):
    df, key, x = skewed
    rows = ordering.prefix_sums(df, ["k"], "v", {"c": F.lit(1)}).collect()
    for k in "ab":
        values, counts = np.unique(x[key == k], return_counts=True)
        mine = sorted((r.v, r.c, r.cum_c, r.total_c) for r in rows if r.k == k)
        assert [m[0] for m in mine] == values.tolist()
        assert [m[2] for m in mine] == np.cumsum(counts).tolist()
        assert {m[3] for m in mine} == {(key == k).sum()}


def test_bucket_never_decreases(spark):
    x = sorted([0.0, 5e-324, 1e-300, 0.5, 1 - 2**-53, 1.0, 1 + 2**-52, 2 - 2**-52, 2.0, 3.7, 1e300, float("inf")])
    x = [-v for v in reversed(x)] + x
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    got = [r.b for r in df.select("i", ordering.order_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_hash_rank_equals_window(skewed):
    df, _, _ = skewed
    h = sample_hash("id", 7)
    mine = {(r.id): r._rank for r in ordering.hash_rank(df.repartition(5), ["k"], h, "id").collect()}
    from pyspark.sql import Window
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(h, "id"))).collect()
    assert mine == {r.id: r.r for r in plain}


def test_split_is_complete_and_partition_free(skewed):
    df, key, _ = skewed
    a = {r.id: r.split for r in sampling.stratified_split(df.repartition(1), "k", 0.2, 0.1, 32, "id").collect()}
    b = {r.id: r.split for r in sampling.stratified_split(df.repartition(8), "k", 0.2, 0.1, 32, "id").collect()}
    assert a == b and len(a) == 6000
    assert sum(s != "train" for s in a.values()) == math.ceil(6000 * (0.2 + 0.1))
    folds = sampling.stratified_folds(df, "k", 5, 32, "id").groupBy("k", "fold").count().collect()
    sizes = {k: [r["count"] for r in folds if r.k == k] for k in "ab"}
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in sizes.values())


def test_caps_and_undersampling(skewed):
    df, key, _ = skewed
    kept = sampling.cap_per_label(df, "k", 900, 1, "id").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in kept} == {"a": 900, "b": int((key == "b").sum())}
    assert sampling.undersample(df, "k", "a", 50, 1, "id").where("k = 'a'").count() == 50
    with pytest.raises(Exception, match="fewer than"):
        sampling.undersample(df, "k", "b", 5000, 1, "id").collect()
    assert sampling.stratified_sample_by_bin(df, "v", "id", 500, 24, 1, "id").count() <= 500


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 32)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(600, 4)), rng.normal(size=(120, 4))
    x[200:400], y[:20] = x[7], x[7]  # copies
    make = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<double>")
    ref, app = neighbours.knn_distance(make(x), make(y), "id", "v", 10, 11)
    own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(own, np.inf)
    other = np.sqrt(((y[:, None] - x[None]) ** 2).sum(-1))
    got = np.array([r[1] for r in ref.orderBy("id").collect()])
    assert np.allclose(got, np.sort(own, 1)[:, :10].mean(1))
    got = np.array([r[1] for r in app.orderBy("id").collect()])
    assert np.allclose(got, np.sort(other, 1)[:, :11].mean(1))


@pytest.mark.parametrize("kind", ["wide", "lattice"])
def test_neighbours_travel_once_per_block(spark, monkeypatch, kind):
    """A query is sent to cells of bounded number, each of half a block on average, not to one for every root of the rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 200)
    monkeypatch.setattr(neighbours, "TILE", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 24)) if kind == "wide" else np.column_stack([rng.integers(0, n, 2000) for n in (50, 400, 9)]).astype(float)
    x[:40] = x[41]
    make = lambda m, at: spark.createDataFrame([(at + i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<double>")
    index = neighbours.PivotIndex(make(x, 0), "v")
    n = len(np.unique(x, axis=0))
    assert len(index.pivots) <= -(-2 * n // 500) < np.sqrt(n) / 2
    numbered = neighbours._distinct(make(x, 0), "v").withColumn("number", F.col("copies"))
    sent = numbered.mapInPandas(neighbours._packs(index, 11, False), neighbours._PACK_SCHEMA).groupBy().sum("rows").first()[0]
    assert sent == n
    ref, app = neighbours.knn_distance(make(x, 0), make(x[500:900] + 0.25, 0), "id", "v", 10, 11)
    own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(own, np.inf)
    other = np.sqrt((((x[500:900] + 0.25)[:, None] - x[None]) ** 2).sum(-1))
    for got, want in ((ref, np.sort(own, 1)[:, :10]), (app, np.sort(other, 1)[:, :11])):
        assert np.allclose([r[1] for r in got.orderBy("id").collect()], want.mean(1))


def test_oversampling_stays_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "few" if i < 30 else "many", float(a), float(b), f"m{i}") for i, (a, b) in enumerate(rng.uniform(1, 9, (230, 2)))]
    df = spark.createDataFrame(rows, "sample_id bigint, label string, a double, b double, note string")
    out = balance.smote(df, ["a", "b"], "label", {"few": 80}, standardize=False).collect()
    made = [r for r in out if r.is_synthetic]
    few = np.array([(r[2], r[3]) for r in rows if r[1] == "few"])
    assert len(made) == 50 and len(out) == 280 and len({r.sample_id for r in out}) == 280
    assert all(r.note is None and r.label == "few" for r in made)
    gap = np.sqrt(((few[:, None] - few[None]) ** 2).sum(-1))
    near = np.argsort(gap, 1)[:, 1:6]
    for r in made:
        p = np.array([r.a, r.b])
        best = min(
            np.abs(np.linalg.norm(p - few[i]) + np.linalg.norm(p - few[j]) - gap[i, j])
            for i in range(30) for j in near[i])
        assert best < 1e-9
    again = balance.smote(df.repartition(7), ["a", "b"], "label", {"few": 80}, standardize=False)
    assert {(r.sample_id, r.a) for r in again.where("is_synthetic").collect()} == {(r.sample_id, r.a) for r in made}


def test_components_and_shrunk_distances(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ np.diag([3.0, 1.0, 0.2]) + [5, -2, 1]
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id bigint, v array<double>, k string")
    pca = domain.fit_pca(df, "v")
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    assert np.allclose(pca.ratio, values[::-1] / values.sum())
    want = vectors[:, ::-1].T
    want *= np.sign(want[np.arange(3), np.abs(want).argmax(1)])[:, None]
    assert np.allclose(pca.components, want)
    got = np.array([r.pcs for r in domain.project(df, pca, "v", 2).orderBy("id").collect()])
    assert np.allclose(got, c @ want[:2].T)

    m = domain._moments(df, "v", None)["_all"]
    s = c.T @ c / 300
    mu = np.trace(s) / 3
    delta = ((s - mu * np.eye(3)) ** 2).sum() / 3
    beta = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in c]) / 300 / 3
    w = min(beta, delta) / delta
    assert np.allclose(np.linalg.inv(m.shrunk_precision()), (1 - w) * s + w * mu * np.eye(3))
    app, cuts = domain.mahalanobis(df, df, "v", "k", "id")
    d = np.sqrt(((c @ m.shrunk_precision()) * c).sum(1))
    assert np.allclose([r.global_mahalanobis for r in app.orderBy("id").collect()], d)
    assert cuts.first().md_q95 == pytest.approx(np.quantile(d, 0.95))


def test_forest_fill(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 10, 400)
    rows = [(i, float(v), None if i % 5 == 0 else float(2 * v + 1), float(v * v)) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    for chained in (True, False):
        params = impute.ForestParams(trees=10, max_depth=8, chained=chained, indicators=not chained)
        out = impute.impute(df, impute.fit_imputer(df, ["a", "b", "c"], params)).orderBy("id").collect()
        b = np.array([r.b for r in out])
        hidden = np.arange(400) % 5 == 0
        truth = 2 * a + 1
        assert (b >= 0).all()
        assert np.allclose(b[~hidden], truth[~hidden])
        median = np.median(truth[~hidden])
        assert np.abs(b - truth)[hidden].mean() < 0.3 * np.abs(median - truth)[hidden].mean()


def test_bootstrap_methods_agree(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "g", float(x), float(w)) for i, (x, w) in enumerate(zip(rng.normal(5, 2, 400), rng.uniform(0.1, 1, 400)))]
    rows += [(1000, "tiny", 1.0, 1.0), (1001, "tiny", 2.0, 1.0), (1002, "zero", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "sample_id bigint, k string, x double, w double")
    x, w = np.array([r[2] for r in rows[:400]]), np.array([r[3] for r in rows[:400]])
    draws = rng.integers(0, 400, (4000, 400))
    sem = ((x[draws] * w[draws]).sum(1) / w[draws].sum(1)).std(ddof=1)
    for method in ("multinomial", "poisson"):
        out = {r.k: r for r in uncertainty.weighted_bootstrap(df, ["k"], "x", "w", 600, 1, method=method).collect()}
        g = out["g"]
        assert g.weighted_mean == pytest.approx((x * w).sum() / w.sum())
        assert g.bootstrap_sem == pytest.approx(sem, rel=0.15)
        assert g.bootstrap_ci_lo < g.weighted_mean < g.bootstrap_ci_hi
        assert out["tiny"].weighted_mean is None and out["tiny"].n == 2 and "zero" not in out


def test_stored_raw_tables_stay_in_compiled_methods(spark):
    """Writing a wide text table first sets the size from which Spark leaves one generated loop for small methods."""
    from assaylake.registry import flows

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    rows = flows._stored(spark.range(3).withColumn("t", F.col("id").cast("string")), "small")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "0"), (1, "1"), (2, "2")]


def test_scoring_joins_nothing(spark):
    """Masks and raw values stay beside their rows, and codes count the boundaries below a value."""
    from assaylake.operators.encode import quantile_encode
    from assaylake.plans.application import score_application
    from assaylake.registry.frames import SquareShares

    rows = spark.createDataFrame([(i // 2, float(i), None if i % 3 else 1.0 * i, 100.0) for i in range(1, 40)], "sample_id long, a double, b double, AGE double")
    bounds = {"a": [3.0, 3.0, 7.5, 20.0], "b": [10.0]}
    model = SquareShares((0.0, 1.0), 4, 1)
    out = score_application(rows, ["a", "b"], ["a"], bounds, [model], ["x", "y"], ["x"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 39  # ids that repeat give one row each
    got = quantile_encode(rows, bounds, "zero").collect()
    for r, g in zip(rows.collect(), got):
        assert g.a == 1 + sum(x < r.a for x in bounds["a"]) and g.b == (0 if r.b is None else 1 + (r.b > 10))


def test_margin_models_take_whole_batches(spark):
    from assaylake.registry.frames import SquareShares

    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [3.0, None]), (5, [0.5, 0.25])], "id int, features array<double>").coalesce(1)
    model = SquareShares((4.0, 2.0), 2, 1)
    got = {r.id: r for r in model.transform(rows).collect()}
    assert all(got[i].probability is None and got[i].prediction is None and got[i].rawPrediction is None for i in (1, 2, 3, 4))
    for i, x in ((0, [1.0, 2.0]), (5, [0.5, 0.25])):
        m = model.margins(np.array([x]))[0]
        assert np.allclose(got[i].rawPrediction.toArray(), m) and np.allclose(got[i].probability.toArray(), m**2 / (m**2).sum())
        assert got[i].prediction == model.labels[int(m.argmax())]


def test_stored_rows_are_packed_and_leave_no_shuffle_files(spark):
    """A stored table is a packed file, read by column; rows that Parquet cannot hold are checkpointed."""
    from glob import glob

    from assaylake import session

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f for d in env.blockManager().diskBlockManager().localDirsString() for f in glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    rows = spark.range(5000).groupBy((F.col("id") % 50).alias("a (%)")).agg(F.max("id").alias("b c"), F.lit("x" * 200).alias("long"))
    kept = session.store_rows(rows)
    assert not files() - before and "parquet" in kept._jdf.queryExecution().toString()
    assert kept.dtypes == rows.dtypes and sorted(kept.collect()) == sorted(rows.collect())
    odd = session.store_rows(spark.range(3).select(F.lit(None).alias("nothing"), F.col("id").alias("x")))
    assert odd.count() == 3 and spark.conf.get(session.CLEAN_SHUFFLES) == "false"


def test_rows_of_the_neighbour_search_are_never_broadcast(spark):
    """Packed rows look smaller than they are; their joins are merge joins, also in a small table."""
    rows = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id")).alias("vec"))
    for far in neighbours.knn_distance(rows, rows.where("id % 3 = 0"), "id", "vec", 4):
        plan = far._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_merge_of_one_list_and_of_several(spark):
    """A query of one block keeps its list; one of several blocks gets the nearest of all, cut at k places."""
    entry = lambda *found: [(float(d), t, None) for d, t in found]
    rows = spark.createDataFrame([(1, entry((1, 2), (2, 1))), (2, entry((3, 2))), (2, entry((1, 1), (4, 3))), (3, entry((5, 1)))],
                                 "number long, found array<struct<dist double, times int, vec array<double>>>")
    got = {r.number: ([(f.dist, f.times) for f in r.found], r.bound) for r in neighbours._merge(rows, 3).collect()}
    assert got == {1: ([(1, 2), (2, 1)], 2.0), 2: ([(1, 1), (3, 2)], 3.0), 3: ([(5, 1)], math.inf)}
