"""Mutual information by nearest neighbours over blocks: rows are shuffled once, and radii that leave a block are whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources_and_relations import place, plain_mi

from basalt.operators import synth


def shuffled(spark) -> int:
    """Records that all stages so far have written to shuffles."""
    none, no_doubles = spark._jvm.java.util.ArrayList, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, no_doubles, none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_are_shuffled_once(spark):
    n = 30_000
    df = spark.range(n).select("id", (F.col("id") % 3).alias("y"), F.rand(1).alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    before = shuffled(spark)
    synth.mi_nearest(df, ["a", "b"], "y", ["id"], block=10_000).collect()
    assert shuffled(spark) - before < 1.2 * 2 * n


@pytest.mark.parametrize("block", [40, 700])
def test_radii_that_leave_their_block(spark, block):
    rng = np.random.default_rng(3)
    n = 2000
    y = [f"c{i}" for i in rng.integers(0, 150, n)]
    y[:1000] = ["many"] * 1000
    x = rng.normal(size=n)
    x[1000:] += np.array([int(c[1:]) for c in y[1000:]]) / 50
    far = np.argsort(x)
    for i, name in ((0, "pair"), (-1, "pair"), (700, "trio"), (1300, "trio"), (1900, "trio"), (50, "alone"), (1000, "alone too"), (1950, "alone at last")):
        y[far[i]] = name
    df = spark.createDataFrame([(i, y[i], float(x[i])) for i in range(n)], "id long, y string, x double")
    want = plain_mi(place(x.tolist(), range(n), "x"), y)
    assert want > 0.05
    for parts in (1, 7):
        assert synth.mi_nearest(df.repartition(parts), ["x"], "y", ["id"], block=block).first().mi == pytest.approx(want, abs=1e-4)


def test_places_that_several_rows_share_across_tasks(spark):
    rng = np.random.default_rng(4)
    n = 1200
    names, y = rng.integers(0, 40, n).tolist(), rng.choice(["a", "b"], n).tolist()
    x = rng.integers(0, 12, n).astype(float).tolist()
    df = spark.createDataFrame(list(zip(names, y, x, strict=True)), "id long, y string, x double")
    at = np.array(place(x, names, "x"))
    got = {(p, b): synth.mi_nearest(df.repartition(p), ["x"], "y", ["id"], block=b).first().mi for p in (1, 9) for b in (30, 100_000)}
    want = max(plain_mi(at, y), 0)
    assert got == {k: pytest.approx(want, abs=1e-4) for k in got}
