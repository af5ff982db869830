"""Extremely randomised trees, grown level by level.

All trees grow together.  At each level every open node draws a few features and
one cut for each, uniformly between the ends that the node's path leaves of the
feature's range.  One pass over the rows sends each through all trees and adds up
what lies left of every drawn cut: class weights, or weights and targets; the sums
of the tasks are added up, and the driver keeps each node's best cut.  The rows are
kept as numpy blocks for these passes.
The trees, and so everything that is broadcast or brought back, have a size that
the parameters fix.  Targets and weights are summed as whole numbers, so the trees
are the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import Fit, packed, together

#: Whole numbers that targets and weights are counted in.
UNITS = 1 << 20


class Forest:
    """Trees as flat arrays, shape (trees, nodes); node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    def __init__(self, trees: int, depth: int, width: int):
        n = (1 << (depth + 1)) - 1
        self.feature = np.full((trees, n), -1, np.int32)  # -1: a leaf
        self.cut = np.zeros((trees, n))
        self.value = np.zeros((trees, n, width))
        self.depth = depth

    def leaves(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row in each tree, after so many levels."""
        n = self.feature.shape[1]
        first = np.arange(len(self.feature)) * n
        row = (np.arange(len(x)) * x.shape[1])[:, None]
        feature, cut, x = self.feature.ravel(), self.cut.ravel(), x.ravel()
        node = np.zeros((len(row), len(first)), np.int64)
        for _ in range(self.depth if levels is None else levels):
            at = first + node
            f = feature.take(at)
            right = x.take(row + np.maximum(f, 0)) > cut.take(at)
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature)), self.leaves(x)].mean(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ends(own: list[tuple]) -> tuple | None:
    """Least and greatest of each feature and of the target, and the greatest weight; None without rows."""
    out = None
    for x, y, w in own:
        out = _wider(out, (np.fmin.reduce(x), x.max(0), (y.min(), y.max()), w.max()))
    return out


def _wider(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return np.fmin(a[0], b[0]), np.maximum(a[1], b[1]), (min(a[2][0], b[2][0]), max(a[2][1], b[2][1])), max(a[3], b[3])


class ExtraTrees:
    """An estimator with ``fit``; the fitted model has ``transform`` and ``featureImportances`` like those of Spark's library."""

    def __init__(self, task: str, trees: int = 100, depth: int = 8, tried: int | None = None, least: int = 2, seed: int = 42, weight: str | None = None):
        self.task, self.trees, self.depth, self.tried, self.least, self.seed, self.weight = task, trees, depth, tried, least, seed, weight

    def fit(self, data: DataFrame) -> ExtraTreesModel:
        """Fit on the columns ``features`` (a vector) and ``label``."""
        return self._fits(data, F.lit(-1), [None])[0]

    def fit_folds(self, data: DataFrame, k: int) -> list[ExtraTreesModel]:
        """For each of k folds (column ``fold``) a model of the other folds' rows; they are grown together."""
        return self._fits(data.where("fold is not null"), F.col("fold"), list(range(k)))

    def _fits(self, data: DataFrame, fold: Column, folds: list) -> list[ExtraTreesModel]:
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"), fold.alias("fold"), F.lit(0).alias("b")).where("y is not null")
        with packed(rows) as blocks:
            made = together(blocks, {f: self._grown() for f in folds})
        return [made[f] for f in folds]

    def _grown(self) -> Fit:
        ends = yield None, _ends, _wider
        if ends is None:
            raise ValueError("no rows to fit")
        low, high, (y_low, y_high), most = ends
        p, regression = len(low), self.task == "regression"
        width = 1 if regression else int(y_high) + 1
        middle, span = (y_low + y_high) / 2, max(y_high - y_low, 1e-300)
        rng, tried = np.random.default_rng(self.seed), min(p, self.tried or (max(1, p // 3) if regression else max(1, round(p**0.5))))
        forest, gains = Forest(self.trees, self.depth, width), np.zeros(p)
        boxes = {(t, 0): (low, high) for t in range(self.trees)}
        for level in range(self.depth + 1):
            nodes = sorted(boxes)
            if not nodes:
                break
            drawn = np.array([rng.permutation(p)[:tried] for _ in nodes])
            at = rng.random((len(nodes), tried))
            cuts = np.array([[boxes[k][0][f] + u * (boxes[k][1][f] - boxes[k][0][f]) for f, u in zip(fs, us, strict=True)] for k, fs, us in zip(nodes, drawn, at, strict=True)])
            total, left = yield from self._sums(forest, level, nodes, drawn, cuts, width, regression, middle, span, most)
            grown: dict[tuple[int, int], tuple] = {}
            for i, (t, node) in enumerate(nodes):
                own = total[i]
                n = own[:, 0].sum() if regression else own.sum()
                if n <= 0:
                    continue
                forest.value[t, node] = middle + span * own[0, 1] / own[0, 0] if regression else own / n
                if level == self.depth or n < self.least * UNITS / max(most, 1e-300):
                    continue
                gain = [self._gain(own, left[i, j], regression) for j in range(tried)]
                best = int(np.argmax(gain))
                if gain[best] <= 0:
                    continue
                f, cut = int(drawn[i, best]), float(cuts[i, best])
                forest.feature[t, node], forest.cut[t, node] = f, cut
                gains[f] += gain[best]
                (a, b), (c, d) = boxes[t, node], boxes[t, node]
                b, c = b.copy(), c.copy()
                b[f] = c[f] = cut
                grown[t, 2 * node + 1], grown[t, 2 * node + 2] = (a, b), (c, d)
                for child in (1, 2):  # what a child says until it has its own sums
                    forest.value[t, 2 * node + child] = forest.value[t, node]
            boxes = grown
        return ExtraTreesModel(forest, self.task, gains)

    @staticmethod
    def _gain(own: np.ndarray, left: np.ndarray, regression: bool) -> float:
        right = own - left
        if regression:
            score = lambda s: s[0, 1] ** 2 / s[0, 0]
            sides = (left[0, 0], right[0, 0])
        else:
            score = lambda s: (s**2).sum() / s.sum()
            sides = (left.sum(), right.sum())
        if min(sides) <= 0:
            return 0.0
        whole = score(own)
        gain = float(score(left) + score(right) - whole)
        return gain if gain > 1e-12 * max(abs(whole), 1.0) else 0.0

    def _sums(self, forest: Forest, level: int, nodes: list, drawn: np.ndarray, cuts: np.ndarray, width: int, regression: bool, middle: float, span: float, most: float) -> Fit:
        """What each open node holds, and what of it lies left of each drawn cut."""
        place = np.full(forest.feature.shape, -1, np.int64)
        for i, (t, node) in enumerate(nodes):
            place[t, node] = i
        tried, cells = drawn.shape[1], 2 if regression else width

        def run(own_blocks: list[tuple]) -> np.ndarray:
            sums = np.zeros((len(drawn) * (tried + 1), cells), np.int64)
            for x, y, w in own_blocks:
                w = np.rint(w * (UNITS / most)).astype(np.int64)
                own = place[np.arange(len(place)), forest.leaves(x, level)]
                row, tree = np.nonzero(own >= 0)
                node = own[row, tree]
                # Whole numbers, whose sums over a block are far below 2**53, so adding them as doubles is exact.
                values = (w, np.rint((y - middle) / span * w)) if regression else (w,)
                kind = 0 if regression else y.astype(np.int64)[row]
                groups = 1 if regression else cells
                flat, own_values = x.ravel(), [v.take(row).astype(np.float64) for v in values]
                for j in range(tried + 1):
                    inside = 1.0 if j == tried else flat.take(row * x.shape[1] + drawn[:, j].take(node)) <= cuts[:, j].take(node)
                    slot = node * groups + kind
                    for i, v in enumerate(own_values):
                        found = np.bincount(slot, v * inside, minlength=len(drawn) * groups).reshape(len(drawn), groups)
                        sums[j :: tried + 1, i : i + groups] += np.rint(found).astype(np.int64)
            return sums

        got = yield None, run, lambda a, b: a + b  # a row for each open node and cut
        out = got.astype(np.float64).reshape(len(nodes), tried + 1, cells)
        out = out[:, :, None, :] if regression else out
        return out[:, tried], out[:, :tried]


class ExtraTreesModel:
    def __init__(self, forest: Forest, task: str, gains: np.ndarray):
        self.forest, self.task = forest, task
        self.featureImportances = DenseVector(gains / (gains.sum() or 1.0))

    def transform(self, data: DataFrame) -> DataFrame:
        shared = data.sparkSession.sparkContext.broadcast(self.forest)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                found = shared.value.predict(_matrix(column)) if len(column) else np.zeros((0, 1))
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

        made = data.withColumn("__made", F.arrow_udf(run, "array<double>", F.ArrowUDFType.SCALAR_ITER)(vector_to_array("features")))
        if self.task == "regression":
            return made.withColumn("prediction", F.col("__made")[0]).drop("__made")
        best = (F.array_position("__made", F.array_max("__made")) - 1).cast("double")  # the smallest class on ties
        return made.withColumns({"prediction": best, "probability": array_to_vector("__made"), "rawPrediction": array_to_vector("__made")}).drop("__made")
