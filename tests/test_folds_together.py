"""Fits of folds that take their steps in shared jobs, and metrics of both sides from one pass."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from basalt.operators import models


def table(spark, n=3000):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    rows = [(*map(float, a), float(a[0] * 2 - a[1] + e), None if i == 5 else i % 3) for i, (a, e) in enumerate(zip(x, rng.normal(0, 0.1, n), strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int").repartition(3)
    return models.assemble(df, ["a", "b", "c"], "y").select("features", "label", "fold").persist()


def test_folds_share_the_jobs_of_their_steps(spark):
    data = table(spark)
    data.count()
    spark.sparkContext.setJobGroup("folds", "")
    metrics, train = models.cross_validate(data, models.NeuralRegressor((8,), steps=12), "regression", 3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds"))
    spark.sparkContext.setJobGroup("rest", "")
    assert list(metrics) == ["r2", "rmse", "mae"] and train <= 1
    assert 0 < jobs < 30  # twelve steps for all three folds, not for each


def test_models_of_folds_are_those_of_single_fits(spark):
    data = table(spark)
    trees, net = models.ExtraTrees("regression", trees=4, depth=4), models.NeuralRegressor((8,), steps=10, batch=700)
    for f, (grown, trained) in enumerate(zip(trees.fit_folds(data, 3), net.fit_folds(data, 3), strict=True)):
        rest = data.where(F.col("fold") != f)
        alone = trees.fit(rest)
        assert np.array_equal(grown.forest.cut, alone.forest.cut) and np.array_equal(grown.forest.value, alone.forest.value)
        assert np.allclose(trained.flat, net.fit(rest).flat, rtol=1e-6, atol=1e-9)
    for model in (trees, net):
        with pytest.raises(ValueError):
            model.fit(data.limit(0))


def test_metrics_of_numbers_are_those_of_the_library(spark):
    df = spark.range(1000).select((F.col("id") % 13).cast("double").alias("label"), (F.col("id") % 7 + 0.5).alias("prediction").cast("double"))
    for rows in (df, df.where("label = 3")):
        got = models.evaluate(rows, "regression")
        for name, value in got.items():
            want = RegressionEvaluator(metricName=name).evaluate(rows)
            assert value == pytest.approx(want, rel=1e-9) or math.isinf(value) and math.isinf(want)
    assert models.first_metric(df, "regression") == models.evaluate(df, "regression")["r2"]
    with pytest.raises(ValueError):
        models.evaluate(df.limit(0), "regression")
