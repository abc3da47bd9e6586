"""Support vector machine with an RBF kernel: landmark features and a distributed squared-hinge solver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KernelParams:
    """c: weight of the loss; gamma: kernel width, None for 1 / (features * variance of all cells);
    landmarks: rows that span the kernel features, the fit's only sample (lowest hashes of the features);
    rounds, tol: Newton steps at most, and the step at which they end."""

    c: float = 0.1
    gamma: float | None = None
    landmarks: int = 256
    rounds: int = 30
    tol: float = 1e-9
    seed: int = 42


def rbf(x: np.ndarray, marks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) of all rows to all landmarks."""
    square = (x * x).sum(1)[:, None] - 2 * x @ marks.T + (marks * marks).sum(1)[None, :]
    return np.exp(-gamma * np.maximum(square, 0))


def inverse_root(marks: np.ndarray, gamma: float) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix on its numerical range."""
    values, vectors = np.linalg.eigh(rbf(marks, marks, gamma))
    good = values > 1e-10 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def hinge_parts(f: np.ndarray, sign: np.ndarray, w: np.ndarray, weight: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and generalised second derivative of c * sum(weight * max(0, 1 - y f w)^2) for one class."""
    slack = 1 - sign * (f @ w)
    active = slack > 0
    a, s, v = f[active], sign[active], slack[active]
    g = weight[active]
    return c * float((g * v * v).sum()), -2 * c * a.T @ (g * s * v), 2 * c * (a * g[:, None]).T @ a


class MarginModel:
    """A classifier of ``labels`` with NumPy methods ``margins(x)`` and ``probabilities(margins)`` for rows of ``width`` cells."""

    def predicted(self, df: DataFrame, features: str) -> Column:
        """Margins, probabilities (arrays) and predicted label as one column, computed a batch at a time."""
        def predict(column: pa.Array) -> pa.Array:
            sized = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == self.width
            x = column.filter(pa.array(sized)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(sized.sum()), self.width)
            finite = np.isfinite(x).all(axis=1)
            good = np.flatnonzero(sized)[finite]
            empty = np.ones(len(column), bool)
            empty[good] = False
            m = self.margins(x[finite]) if len(good) else np.zeros((0, len(self.labels)))
            p = self.probabilities(m) if len(good) else m
            named = np.zeros(len(column))
            named[good] = np.array(self.labels, float)[m.argmax(axis=1)]

            def lists(values: np.ndarray) -> pa.Array:
                ends = np.cumsum(np.where(empty, 0, values.shape[1]))
                return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.ravel(), pa.float64()), mask=pa.array(empty))

            return pa.StructArray.from_arrays([lists(m), lists(p), pa.array(named, mask=empty)], ["raw", "probability", "prediction"])

        return F.arrow_udf(predict, "raw array<double>, probability array<double>, prediction double")(cells(df, features))

    def transform(
        self, df: DataFrame, features: str = "features", probability: str = "probability",
        prediction: str = "prediction", raw: str = "rawPrediction",
    ) -> DataFrame:
        """Adds margins and probabilities (vectors) and the predicted label under the names given.

        Rows without features, or with a missing or non-finite one, get nulls.  The label of the largest
        margin is predicted, the first of equals.
        """
        rows = df.withColumn("_made", self.predicted(df, features))
        vector = lambda c: F.when(F.col(f"_made.{c}").isNotNull(), array_to_vector(F.col(f"_made.{c}")))
        return rows.withColumn(raw, vector("raw")).withColumn(probability, vector("probability")) \
            .withColumn(prediction, F.col("_made.prediction")).drop("_made")


@dataclass(frozen=True)
class KernelModel(MarginModel):
    """Fitted machine: margins of a row are [rbf(x, marks) @ root, 1] @ weights."""

    labels: tuple[float, ...]
    marks: np.ndarray
    root: np.ndarray
    gamma: float
    weights: np.ndarray
    curve: np.ndarray  # slope and intercept of each class's logistic curve

    @property
    def width(self) -> int:
        return self.marks.shape[1]

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([rbf(x, self.marks, self.gamma) @ self.root, np.ones((len(x), 1))], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(margins * self.curve[0] + self.curve[1], -500, 500)))
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / len(self.labels))


def cells(df: DataFrame, features: str):
    """The features as an array, from an array or a vector column."""
    kind = df.schema[features].dataType.typeName()
    return F.col(features) if kind == "array" else vector_to_array(features)


def finite_rows(rows: DataFrame) -> DataFrame:
    """The rows that have a label y and at least one feature x, none missing or non-finite."""
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.col("y").isNotNull() & F.coalesce(finite & (F.size("x") > 0), F.lit(False)))


class KernelMachine:
    """One-against-the-rest machine with squared hinge loss; ``fit`` has the shape of Spark's estimators."""

    def __init__(self, params: KernelParams | None = None, features: str = "features", label: str = "label", weight: str | None = None):
        self.params, self.features, self.label, self.weight = params or KernelParams(), features, label, weight

    def _rows(self, df: DataFrame) -> DataFrame:
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(cells(df, self.features).alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w"))
        return finite_rows(rows).where("w > 0")

    def fit(self, df: DataFrame) -> KernelModel:
        """The machine of all rows that have a label, a weight above 0 and finite features.

        Every Newton step is one pass: tasks sum gradient and second derivative of each class over their
        rows, the sums are combined by row of the matrix, and landmarks-squared numbers per class come to
        the driver, however many rows there are.  Only the landmarks are a sample; its bound is a parameter.
        """
        p, rows = self.params, self._rows(df)
        labels = tuple(sorted(r.y for r in rows.select("y").distinct().collect()))  # a row per class
        if not labels:
            raise ValueError("no row with a label and finite features")
        gamma = p.gamma
        if gamma is None:
            cell = rows.select(F.explode("x").alias("v"), F.size("x").alias("d")).agg(F.var_pop("v").alias("s"), F.max("d").alias("d")).first()
            gamma = 1 / (cell.d * cell.s) if cell.s else 1.0
        drawn = rows.select("x").distinct().orderBy(F.xxhash64(F.lit(p.seed), "x"), "x").limit(p.landmarks).collect()
        marks = np.array([r.x for r in drawn], float)
        root = inverse_root(marks, gamma)
        model = KernelModel(labels, marks, root, gamma, np.zeros((root.shape[1] + 1, len(labels))), np.array([np.ones(len(labels)), np.zeros(len(labels))]))
        model = self._solve(rows, model)
        return self._calibrate(rows, model)

    def _sums(self, rows: DataFrame, model: KernelModel, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss (classes), gradient and second derivative summed over all rows."""
        size, classes, c, labels = model.root.shape[1] + 1, len(model.labels), self.params.c, np.array(model.labels)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((classes, size, size + 2))
            for b in batches:
                if len(b):
                    f, y, w = model.features(np.stack(b["x"])), b["y"].to_numpy(), b["w"].to_numpy()
                    for k in range(classes):
                        loss, g, h = hinge_parts(f, np.where(y == labels[k], 1.0, -1.0), weights[:, k], w, c)
                        total[k, :, :size] += h
                        total[k, :, size] += g
                        total[k, 0, size + 1] += loss
            yield pd.DataFrame({"k": np.repeat(np.arange(classes), size), "i": np.tile(np.arange(size), classes), "v": list(total.reshape(-1, size + 2))})

        got = rows.mapInPandas(each, "k int, i int, v array<double>").groupBy("k", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
        total = np.zeros((classes, size, size + 2))
        for r in got:
            total[r.k, r.i] = r.v.toArray()
        return total[:, 0, size + 1], total[:, :, size], total[:, :, :size]

    def _solve(self, rows: DataFrame, model: KernelModel) -> KernelModel:
        w = model.weights.copy()
        penalty = np.append(np.ones(len(w) - 1), 0.0)  # the constant is free
        value = lambda loss, w: loss + (penalty[:, None] * w * w).sum(0) / 2
        loss, gradient, curve = self._sums(rows, model, w)
        for _ in range(self.params.rounds):
            step = np.stack([np.linalg.solve(h + np.diag(penalty) + 1e-12 * np.eye(len(w)), g + penalty * w[:, k])
                             for k, (g, h) in enumerate(zip(gradient, curve))], axis=1)
            size = np.ones(w.shape[1])
            while True:  # halve the steps of classes whose loss would grow
                new = w - step * size
                after = self._sums(rows, model, new)
                worse = value(after[0], new) > value(loss, w) * (1 + 1e-12)
                if not worse.any() or size.min() < 1e-4:
                    break
                size = np.where(worse, size / 2, size)
            w, (loss, gradient, curve) = new, after
            if np.abs(step * size).max() < self.params.tol:
                break
        return KernelModel(model.labels, model.marks, model.root, model.gamma, w, model.curve)

    def _calibrate(self, rows: DataFrame, model: KernelModel) -> KernelModel:
        """Logistic curve of each class on its margins, counted in bins of 1/256 between -16 and 16."""
        labels = np.array(model.labels)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    m = model.margins(np.stack(b["x"]))
                    at = np.floor(np.clip(m, -16, 16) * 256).astype(int)
                    part = pd.DataFrame({"k": np.tile(np.arange(len(labels)), len(b)), "bin": at.ravel(),
                                         "hit": (b["y"].to_numpy()[:, None] == labels[None, :]).ravel(), "w": np.repeat(b["w"].to_numpy(), len(labels))})
                    yield part.groupby(["k", "bin", "hit"], as_index=False)["w"].sum()

        bins = rows.mapInPandas(each, "k int, bin int, hit boolean, w double").groupBy("k", "bin", "hit").agg(F.sum("w").alias("w")).toPandas()
        curve = np.zeros((2, len(labels)))
        for k in range(len(labels)):
            own = bins[bins.k == k]
            curve[:, k] = logistic((own["bin"].to_numpy() + 0.5) / 256, own["hit"].to_numpy(float), own["w"].to_numpy())
        return KernelModel(model.labels, model.marks, model.root, model.gamma, model.weights, curve)


def logistic(x: np.ndarray, hit: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Slope and intercept of a logistic curve with targets drawn in by one case on either side."""
    above, below = (weight * hit).sum(), (weight * (1 - hit)).sum()
    target = np.where(hit > 0, (above + 1) / (above + 2), 1 / (below + 2))
    f, theta = np.stack([x, np.ones(len(x))]), np.zeros(2)

    def loss(t: np.ndarray) -> float:
        z = t @ f
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(theta @ f, -500, 500)))
        step = np.linalg.solve((f * (weight * q * (1 - q))) @ f.T + 1e-9 * np.eye(2), f @ (weight * (q - target)))
        size = 1.0
        while size > 1e-8 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return theta
