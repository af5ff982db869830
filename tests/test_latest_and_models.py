"""Latest records in a stream, extremely randomised trees, neural regression, class weights, and results that don't depend on partitions."""

import random

import numpy as np
import pytest
from basalt.operators import drift, models
from basalt.plans import QUERIES
from basalt.streaming import LatestDrift, latest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

# -- latest records ---------------------------------------------------------------------


def events(n):
    rng = random.Random(3)
    return [(i, 1000 + i // 3, "abc"[min(i % 7, 2)], rng.gauss(40, 5) + (20 if i > 500 else 0)) for i in range(n)]


SCHEMA = "id long, at long, kind string, value double"


def baseline(spark, rows):
    df = spark.createDataFrame(rows[:300], SCHEMA)
    edges = drift.numeric_edges(df, ["value"])
    return edges, drift.numeric_bins(df, ["value"], edges)


@pytest.mark.parametrize("key", [None, "kind"])
def test_stream_of_latest_records_equals_batch(spark, tmp_path, key):
    rows = events(700)
    edges, base = baseline(spark, rows)
    mixed = rows[:]
    random.Random(4).shuffle(mixed)  # late rows everywhere
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    tried = []

    class Noted(LatestDrift):
        def merge(self, batch, batch_id):
            tried[:] = [[tuple(r) for r in batch.collect()], batch_id]
            super().merge(batch, batch_id)

    new = lambda: Noted(spark, folder, ["at", "id"], ["value"], edges, base, 90, key)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    for part in (mixed[:250], mixed[250:600], mixed[600:]):  # a restart after each
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        seen += part
        new().start(stream()).awaitTermination()
        told = latest(spark.createDataFrame(seen, SCHEMA), ["at", "id"], 90, key)
        assert {r.id for r in new().state().collect()} == {r.id for r in told.collect()}
        assert sorted(map(tuple, new().last().collect())) == sorted(map(tuple, new().scores(told).collect()))
    assert len(new().versions()) == 2 and new().last().count() == (1 if key is None else 3)
    if key is None:
        own = drift.last_n(spark.createDataFrame(rows, SCHEMA), [F.desc("at"), F.desc("id")], 90)
        assert new().last().first().psi == drift.psi(base, drift.numeric_bins(own, ["value"], edges)).first().psi
    # A batch that is tried again gives the same; a reset forgets all.
    before = sorted(map(tuple, new().state().collect()))
    new().merge(spark.createDataFrame(tried[0], SCHEMA), tried[1])
    assert sorted(map(tuple, new().state().collect())) == before
    new().reset()
    new().reset()
    assert new().state().count() == 0
    spark.createDataFrame([(9999, 5000, "a", 1.0)], SCHEMA).write.mode("append").parquet(source)
    new().start(stream()).awaitTermination()
    assert [r.id for r in new().state().collect()] == [9999]


# -- models -----------------------------------------------------------------------------


def frame(spark, x, y, parts=3):
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", label double").repartition(parts)
    return VectorAssembler(inputCols=[f"x{i}" for i in range(x.shape[1])], outputCol="features").transform(df).cache()


def test_extra_trees_for_classes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int) + (x[:, 2] > 1.5)
    train, test = frame(spark, x[:800], y[:800]), frame(spark, x[800:], y[800:])
    trees = models.ExtraTrees("multiclass", trees=25, depth=8, tried=3, seed=5)
    model = trees.fit(train)
    score = models.first_metric(model.transform(test), "multiclass")
    single = models.first_metric(models.candidates("multiclass", 4, 3)["OneSplit"].fit(train).transform(test), "multiclass")
    assert score > 0.8 > single + 0.1
    other = trees.fit(frame(spark, x[:800], y[:800], 7))
    assert np.array_equal(model.forest.feature, other.forest.feature) and np.array_equal(model.forest.cut, other.forest.cut) and np.allclose(model.forest.value, other.forest.value)
    assert not np.array_equal(model.forest.cut, models.ExtraTrees("multiclass", trees=25, depth=8, tried=3, seed=6).fit(train).forest.cut)
    share = model.featureImportances.toArray()
    assert share.sum() == pytest.approx(1) and share[:2].sum() > share[2] > share[3]
    out = model.transform(test).first()
    assert out.probability.toArray().sum() == pytest.approx(1) and out.prediction == out.probability.toArray().argmax()


def test_extra_trees_for_numbers(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(900, 3))
    y = 1e6 + 1000 * np.abs(x[:, 0]) * x[:, 1]
    train, test = frame(spark, x[:700], y[:700]), frame(spark, x[700:], y[700:])
    score = models.first_metric(models.ExtraTrees("regression", trees=20, depth=8, tried=3).fit(train).transform(test), "regression")
    single = models.first_metric(models.candidates("regression", 3)["OneSplit"].fit(train).transform(test), "regression")
    assert score > 0.85 and score > single + 0.2
    flat = models.ExtraTrees("regression", trees=3, depth=3).fit(frame(spark, x[:50], np.full(50, 7.0)))
    assert {r.prediction for r in flat.transform(test).collect()} == {7.0}


def test_neural_regression_of_a_known_curve(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, size=(1500, 2))
    y = 50 + 20 * np.sin(x[:, 0]) + 5 * x[:, 1]
    train, test = frame(spark, x[:1200], y[:1200]), frame(spark, x[1200:], y[1200:])
    score = models.first_metric(models.NeuralRegressor((32, 16), steps=120).fit(train).transform(test), "regression")
    ridge = models.first_metric(models.candidates("regression", 2)["Ridge"].fit(train).transform(test), "regression")
    assert score > 0.97 > ridge + 0.1
    dealt = models.first_metric(models.NeuralRegressor((32, 16), steps=120, batch=300).fit(train).transform(test), "regression")  # four mini-batches
    assert dealt > 0.9


def test_gradient_of_the_network():
    from basalt.operators.neural import gradient, shapes

    rng = np.random.default_rng(4)
    layers, x, y, w = (3, 5, 4, 1), rng.normal(size=(7, 3)), rng.normal(size=7), rng.uniform(1, 2, 7)
    flat = rng.normal(size=sum(int(np.prod(s)) for s in shapes(layers)))
    told, _ = gradient(x, y, flat, layers, w)
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (gradient(x, y, flat + step, layers, w)[1] - gradient(x, y, flat - step, layers, w)[1]) / 4e-6
        assert told[i] == pytest.approx(slope, abs=1e-4)


def test_class_weights_raise_the_recall_of_the_small_class(spark):
    rng = np.random.default_rng(5)
    n = 1500
    y = (rng.random(n) < 0.06).astype(int)
    x = rng.normal(size=(n, 3)) + 1.2 * y[:, None] * np.array([1, 1, 0])
    df = spark.createDataFrame([(*map(float, r), int(v), i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y int, fold int")
    weighed = {r.y: r.weight for r in models.class_weights(df, "y").select("y", "weight").distinct().collect()}
    assert weighed == {v: pytest.approx(n / (2 * (y == v).sum())) for v in (0, 1)}
    out = {(r.model, r.weighted): r for r in models.weighted_comparison(df, ["a", "b", "c"], "y", ["LogisticRegression", "ExtraTrees", "RandomForest"], trees=10).collect()}
    for name in ("LogisticRegression", "ExtraTrees", "RandomForest"):
        assert out[name, True].recall > out[name, False].recall + 0.15
        assert 0 < out[name, True].best_threshold < 1 and out[name, True].best_f1 >= out[name, True].f1 - 0.02


def test_new_models_are_in_the_leaderboard(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), float(b), float(a * b), int(a > 0), i % 3) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "a double, b double, t double, y int, fold int")
    for task, target in (("regression", "t"), ("binary", "y")):
        board = {r.model: r for r in models.leaderboard(df, ["a", "b"], target, task, names=["ExtraTrees", "NeuralNet"], trees=8, rounds=3, hidden=(16, 8)).collect()}
        assert board["ExtraTrees"].error is None and board["ExtraTrees"].score > board["OneSplit"].score - (0.3 if task == "binary" else 0)
        assert board["NeuralNet"].error is None and board["NeuralNet"].score > 0.5
    family = {r.model: r.family for r in models.leaderboard_labels(models.leaderboard(df, ["a", "b"], "y", "binary", names=["ExtraTrees"], trees=3), "ExtraTrees").collect()}
    assert family["ExtraTrees"] == "bagged trees"


# -- the same answer for any partitioning -----------------------------------------------


@pytest.mark.parametrize("name", ["elbow", "parameter_sensitivity", "model_gate", "run_grades", "leaderboard_labels", "legacy_comparison"])
def test_judged_runs_do_not_depend_on_partitions(spark, name, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    seen = set()
    for parts in (1, 4, 32):
        orders.orderBy(F.xxhash64("o_orderkey", F.lit(parts))).repartition(parts).write.parquet(str(tmp_path / str(parts) / "orders.parquet"))
        seen.add(str(sorted(map(str, QUERIES[name](spark, str(tmp_path / str(parts))).collect()))))
    assert len(seen) == 1
