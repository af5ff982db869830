"""Drift in Structured Streaming: over event-time windows, and over the latest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import drift


def drift_stream(stream: DataFrame, time: str, columns: list[str], edges: DataFrame, baseline: DataFrame, folder: str, window: str = "7 days", watermark: str = "1 day"):
    """Start a query that writes the drift of every closed window to ``folder``.

    The stream is reduced to counts by window, feature and bin (its only state);
    each micro-batch of closed windows is compared with the stored baseline.
    Batches carry their id in the path, so that a retried batch overwrites itself.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = stream.withWatermark(time, watermark).select(time, F.explode(pairs).alias("p")).select(time, "p.*").where("x is not null").join(F.broadcast(edges), "feature")
    bins = long.groupBy(F.window(time, window), "feature", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bin")).agg(F.count("*").alias("n"))

    def compare(batch: DataFrame, batch_id: int) -> None:
        closed = batch.select(F.col("window.start").alias("start"), "feature", "bin", "n")
        windows = closed.select("start").distinct()
        grid = windows.join(baseline.select("feature", "bin", F.col("n").alias("a")), how="cross")  # a window's bins
        both = grid.join(closed.withColumnRenamed("n", "b"), ["start", "feature", "bin"], "left").fillna(0, ["b"])
        keyed = lambda c: both.select(F.concat_ws("|", F.col("start").cast("string"), "feature").alias("feature"), "bin", F.col(c).alias("n"))
        scores = drift.psi(keyed("a"), keyed("b"))
        scores.select(F.substring_index("feature", "|", 1).alias("start"), F.substring_index("feature", "|", -1).alias("feature"), "psi").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return bins.writeStream.outputMode("append").foreachBatch(compare).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


# -- the latest records -----------------------------------------------------------------


def latest(rows: DataFrame, order: list[str], n: int, key: str | None = None, shares: int = 32) -> DataFrame:
    """The latest ``n`` rows by the columns of ``order``, of each key if there is one.

    A key's rows are cut down in several shares first, so no key meets in one task.
    """
    if key is None:
        return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
    columns = [F.desc(c) for c in order]
    share = F.pmod(F.xxhash64(*order), F.lit(shares))
    some = rows.withColumn("__share", share)
    for by in (["__share", key], [key]):
        some = some.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*columns))).where(F.col("__place") <= n).drop("__place")
    return some.drop("__share")


class LatestDrift:
    """Drift of the latest ``n`` records of a stream (of each key) against a baseline, as ``last_n`` gives it in batch.

    The state is a table of the records, kept in ``folder`` in one version for each
    micro-batch: a batch merges the version before it with its own rows and writes
    the next, so a batch that is tried again overwrites itself, a restart goes on
    where the stream stopped, and late rows take their place by their time.
    ``reset`` empties the state between two runs.
    """

    def __init__(self, spark: SparkSession, folder: str, order: list[str], columns: list[str], edges: DataFrame, baseline: DataFrame, n: int = 1000, key: str | None = None):
        self.spark, self.folder, self.order, self.columns, self.edges, self.baseline, self.n, self.key = spark, folder, order, columns, edges, baseline, n, key

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Whole versions of the state, oldest first; a reset sorts after the batch it follows."""
        path, fs = self._fs()
        top = path(f"{self.folder}/state")
        found = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(p.getName() for p in found if fs.exists(path(p, "_SUCCESS")))

    def state(self) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(f"{self.folder}/state/{known[-1]}") if known else None

    def reset(self) -> None:
        """Forget all records; the next batch starts from none."""
        if (known := self.versions()) and not known[-1].endswith("r"):
            self.state().limit(0).write.mode("overwrite").parquet(f"{self.folder}/state/{known[-1]}r")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        own = f"{batch_id:012d}"
        before = [v for v in self.versions() if v < own]
        rows = batch.unionByName(self.spark.read.parquet(f"{self.folder}/state/{before[-1]}")) if before else batch
        latest(rows, self.order, self.n, self.key).write.mode("overwrite").parquet(f"{self.folder}/state/{own}")
        self.scores(self.spark.read.parquet(f"{self.folder}/state/{own}")).write.mode("overwrite").parquet(f"{self.folder}/drift/batch={batch_id}")
        path, fs = self._fs()
        for old in before[:-1]:  # the last one is there for another try of this batch
            fs.delete(path(f"{self.folder}/state/{old}"), True)

    def scores(self, rows: DataFrame) -> DataFrame:
        """(key if any, feature, psi, n) of some records."""
        if self.key is None:
            return drift.psi(self.baseline, drift.numeric_bins(rows, self.columns, self.edges)).join(rows.agg(F.count("*").alias("n")), how="cross")
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in self.columns])
        long = rows.select(F.col(self.key).alias("key"), F.explode(pairs).alias("p")).select("key", "p.*").where("x is not null").join(F.broadcast(self.edges), "feature")  # a row for each feature
        counted = long.groupBy("key", "feature", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bin")).agg(F.count("*").alias("b"))
        grid = rows.select(F.col(self.key).alias("key")).distinct().join(F.broadcast(self.baseline.select("feature", "bin", F.col("n").alias("a"))), how="cross")  # a key's bins
        both = grid.join(counted, ["key", "feature", "bin"], "left").fillna(0, ["b"])
        w = Window.partitionBy("key", "feature")
        share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(w) + 0.5 * F.count("*").over(w))
        parts = both.select("key", "feature", "b", ((share("b") - share("a")) * F.log(share("b") / share("a"))).alias("x"))
        return parts.groupBy("key", "feature").agg(F.round(F.sum("x"), 4).alias("psi"), F.sum("b").alias("n")).withColumnRenamed("key", self.key)

    def start(self, stream: DataFrame):
        """Start a query over all that has come; start it again to go on."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.folder}/_checkpoint").trigger(availableNow=True).start()

    def last(self) -> DataFrame:
        """The scores after the last batch."""
        return self.scores(self.state())
