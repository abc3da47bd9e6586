"""The RBF machine against a plain solve, on rings, and on odd rows."""

import numpy as np
import pytest

from assaylake.operators import kernel
from assaylake.operators.score import baseline, score
from assaylake.plans.preparation import cross_validate
from assaylake.operators.impute import ForestParams

SHAPE = "id int, features array<double>, label double"


def rings(n, seed):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(label == 1, 2.0, 0.8) + rng.normal(0, 0.15, n)
    return [(i, [float(r * np.cos(a)), float(r * np.sin(a))], float(y)) for i, (a, r, y) in enumerate(zip(angle, radius, label))]


def test_rings_are_told_apart(spark):
    """No line does that; rows that were not fitted count."""
    df = spark.createDataFrame(rings(900, 3), SHAPE)
    model = baseline("svm", c=1.0, landmarks=64).fit(df.where("id % 3 > 0"))
    rows = model.transform(df.where("id % 3 = 0")).collect()
    assert np.mean([r.prediction == r.label for r in rows]) > 0.95
    for r in rows:
        p = r.probability.toArray()
        assert p.sum() == pytest.approx(1) and len(r.rawPrediction) == 2
        if abs(r.rawPrediction[1]) > 0.3:
            assert p.argmax() == r.prediction
    linear = baseline("linear_svm").fit(df.select("id", kernel.array_to_vector("features").alias("features"), "label"))
    flat = linear.transform(df.select("id", kernel.array_to_vector("features").alias("features"), "label")).collect()
    assert np.mean([r.prediction == r.label for r in flat]) < 0.8


def test_weights_against_a_plain_solve(spark):
    """Three classes; every row a landmark; a long plain gradient descent with momentum reaches the same margins."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (45, 3))
    y = (x[:, 0] > 0.4).astype(float) + (x[:, 1] * x[:, 2] > 0)
    df = spark.createDataFrame([(i, list(map(float, a)), float(b)) for i, (a, b) in enumerate(zip(x, y))], SHAPE).repartition(3)
    model = kernel.KernelMachine(kernel.KernelParams(c=0.7, landmarks=100)).fit(df)
    gamma = 1 / (3 * x.var())
    assert model.gamma == pytest.approx(gamma) and len(model.marks) == 45
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    for at, label in enumerate(model.labels):
        sign = np.where(y == label, 1.0, -1.0)
        a, b = np.zeros(45), 0.0  # margin k a + b, penalty a' k a / 2
        for _ in range(200):  # Newton in the dual coordinates, whole and dense
            v = 1 - sign * (k @ a + b)
            on = v > 0
            system = np.zeros((46, 46))
            system[:45, :45] = np.eye(45) + 2 * 0.7 * np.diag(on.astype(float)) @ k
            system[:45, 45] = 2 * 0.7 * on
            system[45, :45], system[45, 45] = on @ k, on.sum()
            new = np.linalg.solve(system, np.append(2 * 0.7 * on * sign, (on * sign).sum()))
            if np.abs(np.append(a, b) - new).max() < 1e-12:
                break
            a, b = new[:45], new[45]
        assert model.margins(x)[:, at] == pytest.approx(k @ a + b, abs=1e-6)


def test_odd_rows_and_repeats(spark):
    rows = rings(120, 8)
    odd = [(500, None, 1.0), (501, [], 0.0), (502, [1.0, None], 1.0), (503, [float("nan"), 0.0], 0.0), (504, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows + rows[:5] + odd, SHAPE)
    model = baseline("svm", landmarks=20).fit(df)
    got = model.transform(df).collect()
    assert len(got) == 130
    assert all((r.prediction is None) == (r.id in (500, 501, 502, 503)) for r in got)
    one = baseline("svm").fit(df.where("label = 1 AND id < 100"))
    assert {r.prediction for r in one.transform(df.where("id < 20")).collect()} == {1.0}
    with pytest.raises(ValueError):
        baseline("svm").fit(df.limit(0))


def test_scores_of_mixed_classifiers(spark):
    """The machine and a forest are averaged; other columns keep their names."""
    df = spark.createDataFrame(rings(200, 2), SHAPE).withColumn("features", kernel.array_to_vector("features")).withColumnRenamed("id", "prediction")
    known = df.drop("prediction")
    models = [baseline("svm", landmarks=30).fit(known), baseline("random_forest", numTrees=3, maxDepth=3).fit(known)]
    both, alone = score(df, models), [score(df, [m]) for m in models]
    assert both.columns == ["prediction", "features", "label", "probs", "probs_std"]
    parts = [{r[0]: np.array(r.probs) for r in rows.collect()} for rows in alone]
    for r in both.collect():
        assert np.array(r.probs) == pytest.approx((parts[0][r[0]] + parts[1][r[0]]) / 2)
        assert np.array(r.probs_std) == pytest.approx(abs(parts[0][r[0]] - parts[1][r[0]]) / 2)


def test_cross_validation_reports_loss(spark):
    """Two folds, two seeds: classes far apart are told with a small loss; the summary averages the runs."""
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], *(lambda a: (float(a), float(100 - a)))(rng.normal(30 + 40 * (i % 2), 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id long, label string, m1 double, m2 double")
    runs, summary = cross_validate(df, ["m1", "m2"], ["m1", "m2"], "label", {}, {"random_forest": {"numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 1}},
                                   seeds=(42, 123), k=2, params=ForestParams(trees=2, max_depth=3))
    got = runs.collect()
    assert sorted((r.fold, r.seed) for r in got) == [(f, s) for f in (1, 2) for s in (42, 123)]
    assert all(r.accuracy > 0.9 and 0 < r.validation_loss < 0.3 for r in got)
    assert summary.first().validation_loss_mean == pytest.approx(np.mean([r.validation_loss for r in got]))
