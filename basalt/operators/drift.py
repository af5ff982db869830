"""Scoring output, drift against a baseline, alerts; in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import exact_quantiles, running_sums
from .recommend import tier


def risk_tier(df: DataFrame, risk: str) -> DataFrame:
    return df.withColumn("tier", tier(F.col(risk), 0.7, 0.4, ("HIGH", "MEDIUM", "NORMAL")))


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count("*").alias("n"))


def risk_rank(df: DataFrame, risk: str, key: str) -> DataFrame:
    """Rank by risk (ties by key) and percentile, without one task for all rows.

    Rows are counted by risk value and by a block of keys inside it; a row's rank
    is its place in its block plus the rows of the same risk's blocks before and
    the rows of higher risks, which ``running_sums`` adds up in blocks too.
    """
    block = F.floor(F.col(key) / 100_000)
    placed = df.withColumn("__block", block)
    sizes = placed.groupBy(F.col(risk).alias("__risk"), "__block").agg(F.count("*").alias("c"))
    higher = running_sums(sizes.groupBy("__risk").agg(F.sum("c").alias("c")), "__risk", ["c"], descending=True)
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("__risk").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sizes.select(F.col("__risk"), F.col("__block").alias("__b"), inside.alias("__inside"))
    sums = sums.join(higher.select(F.col("__risk").alias("__r"), "c_before", F.col("c_total").alias("__total")), F.col("__risk").eqNullSafe(F.col("__r"))).select("__risk", "__b", (F.col("__inside") + F.col("c_before")).alias("__before"), "__total")
    inner = F.row_number().over(Window.partitionBy(risk, "__block").orderBy(key))
    out = placed.withColumn("__inner", inner).join(sums, F.col(risk).eqNullSafe(F.col("__risk")) & F.col("__block").eqNullSafe(F.col("__b")))
    rank = F.col("__before") + F.col("__inner")
    return out.select(*df.columns, rank.alias("risk_rank"), F.round(100 * rank / F.col("__total"), 4).alias("percentile"))


# -- baselines --------------------------------------------------------------------------


def _bin(c: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < c))


def numeric_edges(df: DataFrame, columns: list[str], bins: int = 8) -> DataFrame:
    """(feature, edges): distinct inner quantiles of columns with more than five values."""
    many = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    cuts = exact_quantiles(df, [c for c in columns if many[c] > 5], [i / bins for i in range(1, bins)])
    return df.sparkSession.createDataFrame([(c, list(dict.fromkeys(e))) for c, e in cuts.items() if e], "feature string, edges array<double>")


def numeric_bins(df: DataFrame, columns: list[str], edges: DataFrame) -> DataFrame:
    """(feature, bin, n) over the full grid of bins."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null").join(F.broadcast(edges), "feature")  # one row for each feature
    counted = long.groupBy("feature", _bin(F.col("x"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    return grid.join(counted, ["feature", "bin"], "left").fillna(0, ["n"])


def smoothed(counts: DataFrame) -> DataFrame:
    """(n + 0.5) / (N + 0.5 k) within each feature."""
    w = Window.partitionBy("feature")
    return counts.withColumn("share", (F.col("n") + 0.5) / (F.sum("n").over(w) + 0.5 * F.count("*").over(w)))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    from .profile import long_form

    return long_form(df, columns).where("value is not null").groupBy(F.col("column_name").alias("feature"), F.col("value").alias("bin")).agg(F.count("*").alias("n"))


def psi(base: DataFrame, current: DataFrame) -> DataFrame:
    """Population stability index of each feature from counts by bin; bins of either side count on both."""
    both = base.select("feature", F.col("bin").cast("string").alias("bin"), F.col("n").alias("a")).join(current.select("feature", F.col("bin").cast("string").alias("bin"), F.col("n").alias("b")), ["feature", "bin"], "full").fillna(0, ["a", "b"])
    w = Window.partitionBy("feature")
    share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(w) + 0.5 * F.count("*").over(w))
    e, a = share("a"), share("b")
    return both.select("feature", ((a - e) * F.log(a / e)).alias("x")).groupBy("feature").agg(F.round(F.sum("x"), 4).alias("psi"))


def drift_levels(scores: DataFrame) -> DataFrame:
    p = F.col("psi")
    return scores.withColumn("level", F.when(p < 0.10, "STABLE").when(p < 0.25, "MODERATE").otherwise("SEVERE"))


def drift_report(scores: DataFrame, n_current, least: int = 30) -> DataFrame:
    """Mean and largest index and the verdict by the largest; ``n_current`` is a one-row count."""
    out = scores.agg(F.round(F.avg("psi"), 4).alias("mean_psi"), F.max("psi").alias("max_psi"), F.count("*").alias("features")).join(n_current.select(F.col("n").alias("n_current")), how="cross")
    verdict = F.when(F.col("n_current") < least, "INSUFFICIENT_DATA").when(F.col("max_psi") < 0.10, "STABLE").when(F.col("max_psi") < 0.25, "MODERATE").otherwise("SEVERE")
    return out.withColumn("verdict", verdict)


def last_n(df: DataFrame, order: list, n: int = 1000) -> DataFrame:
    """The latest n records (a top-n, which sorts in parallel)."""
    return df.orderBy(*order).limit(n)


def alerts(df: DataFrame, risk: str, key: str, drifted: DataFrame, at_least: float = 0.4, urgent: float = 0.7) -> DataFrame:
    """Alert rows for risky records with the most drifted features beside them."""
    top = drifted.orderBy(F.desc("psi"), "feature").limit(3).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("psi"), "feature"))), lambda x: x["feature"]), ",").alias("drifted_features"))
    return df.where(F.col(risk) >= at_least).join(top, how="cross").select(key, risk, F.when(F.col(risk) >= urgent, "URGENT").otherwise("CAUTION").alias("level"), "drifted_features")


def care_list(df: DataFrame, key: str, risk: str, factors: str) -> DataFrame:
    """Per record: risk, tier, care level and its two leading factors."""
    from .recommend import care_prescription

    made = care_prescription(risk_tier(df, risk), risk, factors)
    return made.select(key, F.round(risk, 4).alias("probability"), "tier", "care", F.concat_ws(", ", F.slice(factors, 1, 2)).alias("top_factors"))


def save_baseline(edges: DataFrame, numbers: DataFrame, categories: DataFrame, folder: str) -> None:
    """Edges and counts of a baseline as Parquet, to be compared with later records."""
    for name, df in (("edges", edges), ("numbers", numbers), ("categories", categories)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_baseline(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("edges", "numbers", "categories"))
