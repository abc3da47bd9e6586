"""The soft-max booster against a plain one, its losses, draws and odd rows."""

import numpy as np
import pytest

from assaylake.operators.boosting import BoostParams, SoftmaxBooster, drawn, used_features
from assaylake.operators.score import baseline

SHAPE = "id int, features array<double>, label double"


def three_classes(n, seed, width=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, width)), 1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float) + (x[:, 2] > 0.8)
    return x, y


def table(spark, x, y, parts=3):
    return spark.createDataFrame([(i, list(map(float, a)), float(b)) for i, (a, b) in enumerate(zip(x, y))], SHAPE).repartition(parts)


def plain(x, y, p, takes=None):
    """Trees grown row by row and threshold by threshold; returns the margins of x after every round."""
    labels = np.unique(y)
    t = lambda g: np.sign(g) * max(abs(g) - p.alpha, 0)
    margins, history = np.zeros((len(x), len(labels))), []

    def grow(rows, g, h, features, depth):
        """(value, gain, feature, cut, left, right) or (value,)"""
        sg, sh = g[rows].sum(), h[rows].sum()
        best = None
        if depth < p.max_depth:
            for f in features:
                for cut in np.unique(x[:, f])[:-1]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= p.min_child_weight:
                        gain = sum(t(g[r].sum()) ** 2 / (h[r].sum() + p.lam) for r in (left, right)) - t(sg) ** 2 / (sh + p.lam)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, cut, left, right)
        value = -t(sg) / (sh + p.lam)
        if best is None:
            return (value,)
        gain, f, cut, left, right = best
        a, b = grow(left, g, h, features, depth + 1), grow(right, g, h, features, depth + 1)
        return (value,) if len(a) == len(b) == 1 and gain < p.gamma else (value, gain, f, cut, a, b)

    def leaf(tree, row):
        while len(tree) > 1:
            tree = tree[4] if row[tree[2]] <= tree[3] else tree[5]
        return tree[0]

    for turn in range(p.rounds):
        e = np.exp(margins)
        share = e / e.sum(1, keepdims=True)
        rows, step = np.arange(len(x)) if takes is None else np.flatnonzero(takes(turn)), np.zeros_like(margins)
        for c, label in enumerate(labels):
            g, h = share[:, c] - (y == label), np.maximum(2 * share[:, c] * (1 - share[:, c]), 1e-16)
            tree = grow(rows, g, h, used_features(turn, c, x.shape[1], p), 0)
            step[:, c] = [leaf(tree, r) for r in x]
        margins = margins + p.learning_rate * step
        history.append(margins)
    return history


@pytest.mark.parametrize("settings", [
    dict(subsample=1.0, colsample=1.0, min_child_weight=0.0, gamma=0.0, alpha=0.0, lam=1.0),
    dict(subsample=1.0, colsample=0.6, min_child_weight=3.0, gamma=1.5, alpha=0.5, lam=5.0),
])
def test_margins_against_a_plain_booster(spark, settings):
    """Every distinct value is a cell of its own; margins are written anew between the rounds."""
    x, y = three_classes(90, 1)
    x = np.round(x)
    p = BoostParams(rounds=5, max_depth=3, learning_rate=0.3, block=16, keep_every=2, bins=250, **settings)
    model = SoftmaxBooster(p).fit(table(spark, x, y))
    history = plain(x, y, p)
    assert model.margins(x) == pytest.approx(history[-1], abs=1e-9)
    assert any((t.feature >= 0).any() for t in model.rounds)
    for before, loss in zip([np.zeros_like(history[0]), *history], model.losses):
        e = np.exp(before)
        assert loss == pytest.approx(-np.log((e / e.sum(1, keepdims=True))[np.arange(len(y)), y.astype(int)]).mean())


def test_drawn_rows_do_not_depend_on_partitions(spark):
    x, y = three_classes(300, 2)
    p = BoostParams(rounds=4, max_depth=2, min_child_weight=1.0, block=50)
    one, two = (SoftmaxBooster(p, id_col="id").fit(table(spark, x, y, n)) for n in (1, 5))
    assert one.margins(x) == pytest.approx(two.margins(x), abs=1e-9)
    keys = np.random.default_rng(0).integers(0, 2**63, 200_000).astype(np.uint64)
    shares = [drawn(keys, t, 0.65, 42) for t in range(3)]
    assert all(abs(s.mean() - 0.65) < 0.005 for s in shares)
    assert abs((shares[0] & shares[1]).mean() - 0.65**2) < 0.005


def test_loss_falls_and_held_out_rows_are_told(spark):
    x, y = three_classes(900, 3)
    df = table(spark, x, y)
    model = baseline("softmax_boosting", rounds=15, learning_rate=0.4, subsample=1.0, colsample=1.0, min_child_weight=1.0, alpha=0.0).fit(df.where("id % 3 > 0"))
    assert model.losses[0] == pytest.approx(np.log(3))
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    got = model.transform(df.where("id % 3 = 0")).collect()
    assert np.mean([r.prediction == r.label for r in got]) > 0.9
    assert all(r.probability.toArray().sum() == pytest.approx(1) for r in got)


def test_odd_rows(spark):
    """Rows without label or finite features are not fitted; one class, repeats and no rows have defined results."""
    x, y = three_classes(60, 4)
    x, y = x[:, :2], np.minimum(y, 1)
    odd = [(500, None, 1.0), (501, [], 0.0), (502, [1.0, None], 1.0), (503, [float("nan"), 0.0], 0.0), (504, [1.0, 1.0], None)]
    df = table(spark, x, y).union(table(spark, x[:5], y[:5])).union(spark.createDataFrame(odd, SHAPE))
    quick = dict(rounds=2, max_depth=2)
    got = baseline("softmax_boosting", **quick).fit(df).transform(df).collect()
    assert len(got) == 70 and all((r.prediction is None) == (r.id in (500, 501, 502, 503)) for r in got)
    one = baseline("softmax_boosting", **quick).fit(df.where("label = 1"))
    assert {tuple(r.probability) for r in one.transform(df.where("id < 9")).collect()} == {(1.0,)}
    with pytest.raises(ValueError):
        baseline("softmax_boosting").fit(df.limit(0))
    with pytest.raises(ValueError):
        baseline("softmax_boosting", bins=300)
    with pytest.raises(ValueError):
        baseline("softmax_boosting", **quick).fit(df.union(spark.createDataFrame([(600, [1.0], 1.0)], SHAPE)))
