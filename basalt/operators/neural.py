"""A neural regressor with hidden layers, trained by mini-batch gradients.

Rows are dealt to mini-batches by a hash and kept as numpy blocks.  For each step
every task adds up the gradients of its rows of the batch; the tasks' sums meet on
the driver (many of them in a few tasks before), where an Adam step moves the
weights, whose number the layers fix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import Fit, packed, together


def shapes(layers: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(layers, layers[1:], strict=False) for s in ((a, b), (b,))]


def split(flat: np.ndarray, layers: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(layers):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def forward(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """The values of every layer; hidden ones are rectified."""
    out = [x]
    for i in range(0, len(weights), 2):
        z = out[-1] @ weights[i] + weights[i + 1]
        out.append(np.maximum(z, 0) if i + 2 < len(weights) else z)
    return out


def gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: tuple[int, ...], w: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over rows of the gradient of half the squared error, and of the error."""
    weights = split(flat, layers)
    values = forward(x, weights)
    error = values[-1][:, 0] - y
    back, out = (w * error)[:, None], []
    for i in range(len(weights) - 2, -1, -2):
        out = [values[i // 2].T @ back, back.sum(0), *out]
        if i:
            back = (back @ weights[i].T) * (values[i // 2] > 0)
    return np.concatenate([g.ravel() for g in out]), float((w * error**2).sum())


class NeuralRegressor:
    """An estimator on the columns ``features`` (a vector) and ``label``, like those of Spark's library."""

    def __init__(self, hidden: tuple[int, ...] = (128, 64), steps: int = 120, batch: int = 100_000, rate: float = 0.02, seed: int = 42, weight: str | None = None):
        self.hidden, self.steps, self.batch, self.rate, self.seed, self.weight = hidden, steps, batch, rate, seed, weight

    def fit(self, data: DataFrame) -> NeuralRegressorModel:
        return self._fits(data, F.lit(-1), [None])[0]

    def fit_folds(self, data: DataFrame, k: int) -> list[NeuralRegressorModel]:
        """For each of k folds (column ``fold``) a model of the other folds' rows; they are trained together."""
        return self._fits(data.where("fold is not null"), F.col("fold"), list(range(k)))

    def _fits(self, data: DataFrame, fold: Column, folds: list) -> list[NeuralRegressorModel]:
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"), fold.alias("fold")).where("y is not null")
        sizes = dict(tuple(r) for r in rows.groupBy("fold").agg(F.count("*")).collect())  # a row for each fold
        least = min(sum(n for g, n in sizes.items() if g != f) for f in folds)
        if not least:
            raise ValueError("no rows to fit")
        batches = max(1, round(least / self.batch))
        dealt = rows.withColumn("b", F.pmod(F.xxhash64("x", "y"), F.lit(batches)) if batches > 1 else F.lit(0))
        with packed(dealt) as blocks:
            made = together(blocks, {f: self._trained(batches) for f in folds})
        return [made[f] for f in folds]

    def _trained(self, batches: int) -> Fit:
        _, middle, squares = moments = yield None, _moments, _joined
        spreads = np.sqrt(squares / moments[0])
        mean, spread, y_mean, y_spread = middle[:-1], np.maximum(spreads[:-1], 1e-9), middle[-1], max(spreads[-1], 1e-9)
        layers, rng = (len(mean), *self.hidden, 1), np.random.default_rng(self.seed)
        flat = np.concatenate([(rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes(layers)])
        speed, size = np.zeros_like(flat), np.zeros_like(flat)
        for step in range(1, self.steps + 1):
            total, n = yield (step - 1) % batches, self._gradients(flat, layers, (mean, spread, y_mean, y_spread)), lambda a, b: (a[0] + b[0], a[1] + b[1])
            if not n:
                continue
            g = total / n + 1e-5 * flat
            speed, size = 0.9 * speed + 0.1 * g, 0.99 * size + 0.01 * g * g
            rate = self.rate * (1 - 0.9 * (step - 1) / self.steps)
            flat = flat - rate * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
        return NeuralRegressorModel(flat, layers, mean, spread, y_mean, y_spread)

    @staticmethod
    def _gradients(flat: np.ndarray, layers: tuple[int, ...], scale: tuple):
        def run(own: list[tuple]) -> tuple[np.ndarray, float]:
            mean, spread, y_mean, y_spread = scale
            total, n = np.zeros_like(flat), 0.0
            for x, y, w in own:
                total += gradient((x - mean) / spread, (y - y_mean) / y_spread, flat, layers, w)[0]
                n += w.sum()
            return total, n

        return run


def _moments(own: list[tuple]) -> tuple | None:
    """Rows, means and sums of squares about them, of the features and then the target."""
    out = None
    for x, y, _ in own:
        z = np.column_stack([x, y])
        out = _joined(out, (len(z), z.mean(0), ((z - z.mean(0)) ** 2).sum(0)))
    return out


def _joined(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


class NeuralRegressorModel:
    def __init__(self, flat: np.ndarray, layers: tuple[int, ...], *scale):
        self.flat, self.layers, self.scale = flat, layers, scale

    def transform(self, data: DataFrame) -> DataFrame:
        shared = data.sparkSession.sparkContext.broadcast((self.flat, self.layers, self.scale))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            flat, layers, (mean, spread, y_mean, y_spread) = shared.value
            for column in batches:
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), layers[0])
                yield pa.array(forward((x - mean) / spread, split(flat, layers))[-1][:, 0] * y_spread + y_mean)

        return data.withColumn("prediction", F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)(vector_to_array("features")))
