"""Gradient boosting with a soft-max objective: all classes in one booster, histograms summed in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_folder
from .kernel import MarginModel, cells, finite_rows

SMALLEST = 1e-16  # least second derivative of a row
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostParams:
    """rounds, max_depth, learning_rate: one tree a class and round, its depth, its share of the margin;
    subsample, colsample: share of rows a round and of features a tree; min_child_weight: second
    derivatives a child needs; gamma: gain below which the last splits are taken back; alpha, lam: L1 and
    L2 terms of the leaves; bins: cells per feature, between approximate quantiles;
    block, keep_every: rows held together as arrays, and rounds after which their margins are written."""

    rounds: int = 200
    max_depth: int = 4
    learning_rate: float = 0.05
    subsample: float = 0.65
    colsample: float = 0.7
    min_child_weight: float = 10.0
    gamma: float = 1.0
    alpha: float = 3.0
    lam: float = 5.0
    bins: int = 64
    block: int = 4096
    keep_every: int = 20
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.bins <= 256:
            raise ValueError("bins must lie between 2 and 256")


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    """A gradient sum drawn towards 0 by the L1 term."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def leaf_value(g: float, h: float, p: BoostParams) -> float:
    return float(-shrunk(np.float64(g), p.alpha) / (h + p.lam)) if h + p.lam > 0 else 0.0


def best_splits(g: np.ndarray, h: np.ndarray, p: BoostParams) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best gain, its last left bin and the sums of both sides, for histograms (rows, bins).

    Sums run from either end, so that an empty side is exactly 0; the first bin of equals is taken.
    """
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    right_g, right_h = g[:, ::-1].cumsum(1)[:, ::-1][:, 1:], h[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    worth = lambda a, b: shrunk(a, p.alpha) ** 2 / np.maximum(b + p.lam, SMALLEST)
    whole = worth(left_g + right_g, left_h + right_h)
    fits = (left_h > 0) & (right_h > 0) & (left_h >= p.min_child_weight) & (right_h >= p.min_child_weight)
    gain = np.where(fits, worth(left_g, left_h) + worth(right_g, right_h) - whole, -np.inf)
    at = gain.argmax(1)
    pick = lambda a: a[np.arange(len(a)), at]
    return pick(gain), at, [pick(a) for a in (left_g, left_h, right_g, right_h)]


@dataclass
class Trees:
    """The trees of one round, one per class, nodes numbered as in a heap; feature -1 is a leaf."""

    feature: np.ndarray
    code: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        shape = (classes, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1), np.zeros(shape, int), np.zeros(shape), np.zeros(shape), np.full(shape, -np.inf))

    def nodes(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree (rows, classes); limits are codes or cuts, as the data are."""
        own = np.arange(len(self.feature))
        at = np.zeros((len(data), len(own)), int)
        for _ in range(int(np.log2(self.feature.shape[1] + 1)) - 1):
            f = self.feature[own, at]
            right = data[np.arange(len(data))[:, None], np.maximum(f, 0)] > limits[own, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def outputs(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.value)), self.nodes(data, limits)]

    def prune(self, gamma: float) -> None:
        """Takes back splits whose children are leaves and whose gain is below gamma, from the bottom."""
        for c, feature in enumerate(self.feature):
            for n in range(len(feature) // 2 - 1, -1, -1):
                if feature[n] >= 0 and feature[2 * n + 1] < 0 and feature[2 * n + 2] < 0 and self.gain[c, n] < gamma:
                    feature[n] = -1


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def drawn(keys: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """Whether a row takes part in a round: its key and the round's number mixed by multiply-xor steps."""
    if share >= 1:
        return np.ones(len(keys), bool)
    z = keys + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * 2**53))


def used_features(turn: int, c: int, n: int, p: BoostParams) -> np.ndarray:
    """The features that a class's tree of a round may split on, in ascending order."""
    return np.sort(np.random.default_rng([p.seed, turn, c]).permutation(n)[: max(1, int(p.colsample * n))])


@dataclass(frozen=True)
class BoostedModel(MarginModel):
    """Margins of a row are the sums of its leaves; ``losses`` is the mean log loss before each round."""

    labels: tuple[float, ...]
    width: int
    rounds: tuple[Trees, ...]
    rate: float
    losses: tuple[float, ...] = ()

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.labels)))
        for trees in self.rounds:
            total += self.rate * trees.outputs(x, trees.cut)
        return total

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return softmax(margins)


_BLOCK = "codes binary, y binary, keys binary, margins binary"
_SPLIT = "c int, node int, f int, gain double, bin int, gl double, hl double, gr double, hr double"


class SoftmaxBooster:
    """``fit`` has the shape of Spark's estimators.

    ``id_col`` names the column whose hash draws the rows of a round; without it the row's own values do,
    so that equal rows are drawn together.
    """

    def __init__(self, params: BoostParams | None = None, features: str = "features", label: str = "label", id_col: str | None = None):
        self.params, self.features, self.label, self.id_col = params or BoostParams(), features, label, id_col

    def fit(self, df: DataFrame) -> BoostedModel:
        """The booster of all rows that have a label and finite features; an empty table is refused.

        Rows are written once as blocks of one-byte codes.  A level of all trees of a round is one pass:
        tasks add first and second derivatives by (class, node, feature, bin), the sums of a class's node
        meet in one row (features times bins numbers), and its best split is all that the driver gets.
        """
        p, spark = self.params, df.sparkSession
        rows = self._rows(df)
        labels = tuple(sorted(r.y for r in rows.select("y").distinct().collect()))  # a row per class
        if not labels:
            raise ValueError("no row with a label and finite features")
        cuts = self._cuts(rows)
        folder = scratch_folder(spark, "boosting")
        held = f"{folder}/0"
        try:
            self._blocks(rows, labels, cuts).write.parquet(held)
            done: list[Trees] = []
            losses: list[float] = []
            kept = 0  # rounds that the written margins hold
            for turn in range(p.rounds):
                if turn - kept >= p.keep_every:
                    new = f"{folder}/{turn}"
                    _advance(spark.read.parquet(held), done[kept:], len(labels), len(cuts), p).write.parquet(new)
                    drop_folder(spark, held)
                    held, kept = new, turn
                trees, loss = self._grow(spark.read.schema(_BLOCK).parquet(held), done[kept:], turn, len(labels), cuts)
                done.append(trees)
                losses.append(loss)
        finally:
            drop_folder(spark, folder)
        return BoostedModel(labels, len(cuts), tuple(done), p.learning_rate, tuple(losses))

    def _rows(self, df: DataFrame) -> DataFrame:
        x, y = cells(df, self.features), F.col(self.label).cast("double")
        key = F.xxhash64(F.lit(self.params.seed), F.col(self.id_col).cast("string")) if self.id_col else F.xxhash64(F.lit(self.params.seed), x, y)
        return finite_rows(df.select(x.alias("x"), y.alias("y"), key.alias("key")))

    def _cuts(self, rows: DataFrame) -> list[np.ndarray]:
        """Distinct approximate quantiles of every feature: one aggregation with a row per feature."""
        n = self.params.bins
        shares = F.array(*[F.lit(i / n) for i in range(1, n)])
        got = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(
            F.percentile_approx("v", shares, F.lit(10000)).alias("q"), F.count(F.lit(1)).alias("n")).collect()
        if len({r.n for r in got}) != 1:
            raise ValueError("rows have different numbers of features")
        return [np.unique(r.q) for r in sorted(got, key=lambda r: r.f)]

    def _blocks(self, rows: DataFrame, labels: tuple[float, ...], cuts: list[np.ndarray]) -> DataFrame:
        size, known = self.params.block, np.array(labels)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), size):
                    b = batch.iloc[at : at + size]
                    x = np.stack(b["x"])
                    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"codes": [codes.tobytes()], "y": [np.searchsorted(known, b["y"]).astype(np.int32).tobytes()],
                                        "keys": [b["key"].to_numpy(np.int64).tobytes()], "margins": [np.zeros((len(b), len(known))).tobytes()]})

        return rows.mapInPandas(each, _BLOCK)

    def _grow(self, blocks: DataFrame, pending: list[Trees], turn: int, classes: int, cuts: list[np.ndarray]) -> tuple[Trees, float]:
        """The trees of one round and the mean log loss before it."""
        p, trees, loss = self.params, Trees.empty(classes, self.params.max_depth), float("nan")
        active = {c: [0] for c in range(classes)}
        for level in range(p.max_depth):
            if not active:
                break
            following: dict[int, list[int]] = {}
            for r in self._level(blocks, pending, trees, active, turn, len(cuts)).collect():  # a row per open node
                if r.c < 0:
                    loss = r.gl / r.hl
                    continue
                if r.node == 0:
                    trees.value[r.c, 0] = leaf_value(r.gl + r.gr, r.hl + r.hr, p)
                if r.gain > LEAST_GAIN:
                    n = r.node
                    trees.feature[r.c, n], trees.code[r.c, n], trees.cut[r.c, n], trees.gain[r.c, n] = r.f, r.bin, cuts[r.f][r.bin], r.gain
                    trees.value[r.c, 2 * n + 1], trees.value[r.c, 2 * n + 2] = leaf_value(r.gl, r.hl, p), leaf_value(r.gr, r.hr, p)
                    following.setdefault(r.c, []).extend([2 * n + 1, 2 * n + 2])
            active = following
        trees.prune(p.gamma)
        return trees, loss

    def _level(self, blocks: DataFrame, pending: list[Trees], trees: Trees, active: dict[int, list[int]], turn: int, width: int) -> DataFrame:
        p, classes = self.params, len(trees.feature)
        use = {c: used_features(turn, c, width, p) for c in active}

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {c: np.zeros((2, len(nodes) * len(use[c]) * p.bins)) for c, nodes in active.items()}
            loss = np.zeros(2)
            for codes, y, keys, margins in _arrays(batches, classes, width):
                margins = margins + _sum(pending, codes, p)
                share = softmax(margins)
                if 0 in active.get(0, ()):  # the first level of a round
                    loss += -np.log(np.maximum(share[np.arange(len(y)), y], SMALLEST)).sum(), len(y)
                slope = share - (y[:, None] == np.arange(classes))
                bend = np.maximum(2 * share * (1 - share), SMALLEST)
                takes, at = drawn(keys, turn, p.subsample, p.seed), trees.nodes(codes, trees.code)
                for c, nodes in active.items():
                    slot = np.full(trees.feature.shape[1], -1)
                    slot[nodes] = np.arange(len(nodes))
                    place = slot[at[:, c]]
                    own = np.flatnonzero(takes & (place >= 0))
                    cell = (place[own, None] * len(use[c]) + np.arange(len(use[c]))) * p.bins + codes[own[:, None], use[c]]
                    for part, d in enumerate((slope, bend)):
                        sums[c][part] += np.bincount(cell.ravel(), np.repeat(d[own, c], len(use[c])), sums[c].shape[1])
            for c, nodes in active.items():
                v = sums[c].reshape(2, len(nodes), -1)
                yield pd.DataFrame({"c": c, "node": nodes, "v": list(np.concatenate([v[0], v[1]], axis=1))})
            if loss[1]:
                yield pd.DataFrame({"c": [-1], "node": 0, "v": [loss]})

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for c, node, v in zip(b["c"], b["node"], b["v"]):
                    if c < 0:
                        out.append((c, node, 0, 0.0, 0, v[0], v[1], 0.0, 0.0))
                        continue
                    gain, at, sides = best_splits(*v.reshape(2, len(use[c]), p.bins), p)
                    f = int(gain.argmax())  # the first feature of equals
                    out.append((c, node, use[c][f], gain[f], at[f], *[side[f] for side in sides]))
                yield pd.DataFrame(out, columns=["c", "node", "f", "gain", "bin", "gl", "hl", "gr", "hr"])

        sums = blocks.mapInPandas(add, "c int, node int, v array<double>").groupBy("c", "node").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        return sums.select("c", "node", vector_to_array("v").alias("v")).mapInPandas(split, _SPLIT)


def _arrays(batches: Iterator[pd.DataFrame], classes: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for r in b.itertuples():
            yield (np.frombuffer(r.codes, np.uint8).reshape(-1, width), np.frombuffer(r.y, np.int32),
                   np.frombuffer(r.keys, np.uint64), np.frombuffer(r.margins, float).reshape(-1, classes))


def _sum(pending: list[Trees], codes: np.ndarray, p: BoostParams) -> np.ndarray:
    return sum((p.learning_rate * t.outputs(codes, t.code) for t in pending), np.float64(0))


def _advance(blocks: DataFrame, pending: list[Trees], classes: int, width: int, p: BoostParams) -> DataFrame:
    """The blocks with the trees of the last rounds added to their margins."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for codes, y, keys, margins in _arrays(batches, classes, width):
            yield pd.DataFrame({"codes": [codes.tobytes()], "y": [y.tobytes()], "keys": [keys.tobytes()], "margins": [(margins + _sum(pending, codes, p)).tobytes()]})

    return blocks.mapInPandas(each, _BLOCK)
