"""Evaluation and statistics.

Threshold, ROC and PR operators count positives and negatives by score (or grid
bin) first; running sums over those counts go through ``running_sums``, which
needs no task for all scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.distributions import normal_quantile, normal_tail, signed_rank_tail, t_two_sided
from ..functions.ordered import exact_quantiles, running_sums


def every():
    return Window.partitionBy()


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class of a confusion matrix."""
    cells = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit("a").alias("side"), "n", (F.col("actual") == F.col("predicted")).alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side"), "n", F.lit(False).alias("hit")))).alias("x")).select("x.*")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    out = cells.groupBy("label").agg(side("a").alias("support"), side("p").alias("predicted"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return out.select("label", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(div(2 * p * r, p + r), 4).alias("f1"))


def weighted_report(report: DataFrame) -> DataFrame:
    w = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 4).alias(c)
    return report.agg(w("precision"), w("recall"), w("f1"))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve (ties count half)."""
    c = running_sums(_by_score(df, y, score), "s", ["neg"])
    parts = c.select((F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), "pos", "neg")
    return parts.agg(F.round(F.sum("u") / (F.sum("pos") * F.sum("neg")), 4).alias("auc"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    c = running_sums(_by_score(df, y, score), "s", ["pos", "neg"], descending=True)
    rate = lambda n: (F.col(f"{n}_before") + F.col(n)) / F.col(f"{n}_total")
    return c.select(F.col("s").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def pr_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 at precision 1."""
    c = running_sums(_by_score(df, y, score), "s", ["pos", "neg"], descending=True)
    tp, fp = F.col("pos_before"), F.col("neg_before")
    before = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    precision = (tp + F.col("pos")) / (tp + F.col("pos") + fp + F.col("neg"))
    step = F.col("pos") / F.col("pos_total") * (precision + before) / 2
    return c.select(step.alias("step")).agg(F.round(F.sum("step"), 4).alias("pr_auc"))


def threshold_counts(df: DataFrame, y: str, score: str, low: float, step: float, points: int) -> DataFrame:
    """tp, fp, fn, tn at every grid threshold (positive from the threshold on), from one count by bin."""
    digits = 6
    at = F.least(F.lit(points), F.greatest(F.lit(0), F.floor(F.round((F.col(score) - low) / step, digits)) + 1)).cast("int")
    bins = df.where(F.col(score).isNotNull()).groupBy(at.alias("b")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    grid = df.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("b")).join(bins, "b", "left").fillna(0)
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    made = grid.select("b", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every()).alias("p"), F.sum("neg").over(every()).alias("n"))
    return made.where("b > 0").select(F.round(low + (F.col("b") - 1) * step, digits).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def cost_threshold(df: DataFrame, y: str, score: str, fn_cost: float = 5.0, fp_cost: float = 1.0, low: float = 0.05, step: float = 0.01, points: int = 91) -> DataFrame:
    """The cheapest threshold (the smallest on ties), its precision and recall, and the saving against 0.5."""
    t = threshold_counts(df, y, score, low, step, points).withColumn("cost", fn_cost * F.col("fn") + fp_cost * F.col("fp"))
    best = t.agg(F.min_by(F.struct("threshold", "cost", "tp", "fp", "fn", "tn"), F.struct("cost", "threshold")).alias("b"), F.min_by("cost", F.abs(F.col("threshold") - 0.5)).alias("base"))
    b = best.select("b.*", "base")
    div = lambda a, c: F.round(F.when(c > 0, a / c).otherwise(0.0), 4)
    return b.select("threshold", "cost", "tp", "fp", "fn", "tn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(100 * (F.col("base") - F.col("cost")), F.col("base")).alias("saved_pct"))


def threshold_sweep(df: DataFrame, y: str, score: str, fn_cost: float = 10.0) -> DataFrame:
    """Thresholds that maximise F1, minimise cost, balance precision and recall (precision > 0.1), and 0.5."""
    t = threshold_counts(df, y, score, 0.01, 0.01, 99)
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    t = t.withColumns({"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "cost": fn_cost * F.col("fn") + F.col("fp")})
    row = F.struct("threshold", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("f1"), "cost")
    gap = F.when(F.col("precision") > 0.1, F.round(F.abs(F.col("precision") - F.col("recall")), 9)).otherwise(9.0)
    picked = t.agg(F.min_by(row, F.struct(-F.round("f1", 9), "threshold")).alias("max_f1"), F.min_by(row, F.struct("cost", "threshold")).alias("min_cost"), F.min_by(row, F.struct(gap, "threshold")).alias("balanced"), F.min_by(row, F.abs(F.col("threshold") - 0.5)).alias("default"))
    names = ("max_f1", "min_cost", "balanced", "default")
    return picked.select(F.explode(F.array(*[F.struct(F.lit(n).alias("goal"), F.col(n).alias("r")) for n in names])).alias("x")).select("x.goal", "x.r.*")


def threshold_curve(df: DataFrame, y: str, score: str, fn_cost: float = 10.0, points: int = 20) -> DataFrame:
    """Precision, recall and cost at so many thresholds spread over the grid of the sweep."""
    t = threshold_counts(df, y, score, 0.01, 0.01, 99)
    step = max(1, 99 // points)
    div = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    at = F.round((F.col("threshold") - 0.01) * 100).cast("int")
    return t.where((at % step == 0) & (at < step * points)).select("threshold", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), (fn_cost * F.col("fn") + F.col("fp")).alias("cost"))


def regression_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    e = F.col(y) - F.col(predicted)
    return df.agg(F.round(1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)), 4).alias("r2"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


def residual_hist(df: DataFrame, y: str, predicted: str, bins: int = 40) -> DataFrame:
    e = df.select((F.col(y) - F.col(predicted)).alias("e"))
    range_ = e.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("e") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int")
    return e.join(range_, how="cross").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def cf_threshold(df: DataFrame, y: str, score: str, points: int = 10) -> DataFrame:
    """Weighted F1 of cutting a score at equal steps between its ends; the best cut first."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    grid = ends.select(F.explode(F.sequence(F.lit(1), F.lit(points))).alias("i"), "lo", "hi").select("i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points + 1)).alias("cut"))
    c = _by_score(df, y, score).join(F.broadcast(grid), how="cross")  # distinct scores times ten cuts
    s = lambda cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))
    up = F.col("s") >= F.col("cut")
    m = c.groupBy("i", "cut").agg(s(up, "pos").alias("tp"), s(up, "neg").alias("fp"), s(~up, "pos").alias("fn"), s(~up, "neg").alias("tn"))
    f1 = lambda a, b, x: F.when(2 * F.col(a) + F.col(b) + F.col(x) > 0, 2 * F.col(a) / (2 * F.col(a) + F.col(b) + F.col(x))).otherwise(0.0)
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return m.select("i", F.round("cut", 4).alias("cut"), F.round((pos * f1("tp", "fp", "fn") + neg * f1("tn", "fn", "fp")) / (pos + neg), 4).alias("weighted_f1"))


def slice_bands(df: DataFrame, column: str) -> Column:
    """Bands of a column: ages up to 29, to 49 and above; thirds of other numbers; the three most frequent values of a text (null else)."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, NumericType):
        if "age" in column.lower():
            return F.when(c <= 29, "up to 29").when(c <= 49, "30 to 49").when(c.isNotNull(), "50 and above")
        low, high = exact_quantiles(df, [column], [0.33, 0.66])[column]
        return F.when(c <= low, "low").when(c <= high, "middle").when(c.isNotNull(), "high")
    top = df.where(c.isNotNull()).groupBy(c.alias("v")).count().orderBy(F.desc("count"), "v").limit(3).collect()
    return F.when(c.isin([r.v for r in top]), c)


def slice_metrics(df: DataFrame, slices: Column, y: str, champion: str, baseline: str, least: int = 5) -> DataFrame:
    """Accuracy of two predictions in every slice of at least so many rows."""
    acc = lambda c: F.avg((F.col(c) == F.col(y)).cast("double"))
    out = df.groupBy(slices.alias("slice")).agg(F.count("*").alias("n"), acc(champion).alias("a"), acc(baseline).alias("b")).where(F.col("n") >= least)
    return out.select("slice", "n", F.round("a", 4).alias("champion"), F.round("b", 4).alias("baseline"), F.round(100 * (F.col("a") - F.col("b")) / F.when(F.col("b") != 0, F.abs("b")), 4).alias("lift_pct"))


# -- tests ------------------------------------------------------------------------------


def bootstrap_ci(df: DataFrame, value: str, key: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a mean by Poisson resampling: each row comes into each replicate as often as a Poisson(1) draw.

    A draw inverts the distribution function at a hash of the row's key and the
    replicate's number, so it is the same in every run and for any partitioning.
    A task adds up its rows for all replicates; only these sums are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])

    def run(batches):
        numbers = np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total, weight = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(keys), 1024):
                x = keys[at : at + 1024, None] + numbers
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of the splitmix generator
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                draw = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right")
                total += values[at : at + 1024] @ draw
                weight += draw.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(total), pa.array(weight)], names=["rep", "total", "weight"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key)).alias("k"), F.col(value).cast("double").alias("v"))
    means = rows.mapInArrow(run, "rep long, total double, weight double").groupBy("rep").agg((F.sum("total") / F.sum("weight")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.round(F.avg("m"), 2).alias("mean"), F.round(F.percentile("m", tail), 2).alias("low"), F.round(F.percentile("m", 1 - tail), 2).alias("high"), F.round(F.stddev_samp("m"), 2).alias("std_error"))  # over the replicates


def wilcoxon(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Signed-rank statistics of a - b: pairs, W+, z (normal approximation with ties), effect size, and whether there are five pairs at least."""
    d = F.round(F.col(a) - F.col(b), digits)
    counted = df.select(d.alias("d")).where("d <> 0").groupBy(F.abs("d").alias("s")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    rank = F.col("t_before") + (F.col("t") + 1) / 2
    sums = running_sums(counted, "s", ["t"]).select("t", (rank * F.col("up")).alias("r")).agg(F.sum("t").alias("n"), F.sum("r").alias("w_plus"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.select("n", F.round("w_plus", 1).alias("w_plus"), F.round(z, 4).alias("z"), F.round(z / F.sqrt(n), 4).alias("effect"), (F.col("n") >= 5).alias("is_sufficient"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    t = F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))
    return df.agg(F.count(d).alias("n"), F.round(F.avg(d), 4).alias("mean_difference"), F.round(t, 4).alias("t"))


#: Pairs up to which the signed-rank distribution is exact.
EXACT_PAIRS = 50


def _with_groups(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row at most for each group."""
    if not by:
        return left.join(right, how="cross")  # a row each
    names = [f"__g{i}" for i in range(len(by))]
    right = right.withColumnsRenamed(dict(zip(by, names, strict=True)))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    return left.join(right, same, "left").drop(*names)


def wilcoxon_test(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Signed-rank test that b is greater than a, for each group: pairs, pairs that differ, W+, p, effect size, significance label and mean lift.

    Equal pairs are left out and ties share their middle rank.  Up to
    ``EXACT_PAIRS`` pairs p is exact, beyond it is that of the normal distribution with
    the ties' correction.  Under five pairs the test is insufficient (p 0.5).
    """
    exact_type = f"decimal(38,{digits})"
    rows = df.select(*by, F.round(F.col(b) - F.col(a), digits).cast(exact_type).alias("d")).where("d is not null")
    pairs = rows.groupBy(*by).agg(F.count("*").alias("n_pairs"), (F.sum("d").cast("double") / F.count("*")).alias("lift"))
    counted = rows.where("d <> 0").groupBy(*by, F.abs("d").alias("s")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    doubled = 2 * F.col("t_before") + F.col("t") + 1
    few = F.when(F.col("t_total") <= EXACT_PAIRS, F.struct(doubled.alias("r"), "t"))
    ties = F.col("t").cast("decimal(38,0)") * F.col("t") * F.col("t") - F.col("t")
    sums = running_sums(counted, "s", ["t"], by=by).groupBy(*by).agg(F.sum("t").alias("n"), F.sum((doubled * F.col("up")).cast("decimal(38,0)")).cast("double").alias("w2"), F.sum(ties).cast("double").alias("ties"), F.sort_array(F.collect_list(few)).alias("ranks"))
    n, w = F.col("n").cast("double"), F.col("w2") / 2
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    # At most EXACT_PAIRS ranks, each as often as it is tied.
    ranks = F.flatten(F.transform("ranks", lambda x: F.array_repeat(x["r"], x["t"].cast("int"))))
    out = _with_groups(pairs, sums, by).withColumn("n", F.coalesce("n", F.lit(0)))
    enough, exact = F.col("n") >= 5, F.col("n") <= EXACT_PAIRS
    out = out.withColumn("p", F.when(~enough, 0.5).when(exact, signed_rank_tail(ranks, F.col("w2"))).otherwise(normal_tail(z)))
    strength = F.when(~enough | (F.col("p") <= 0) | (F.col("p") >= 1), 0.0).when(exact, normal_quantile(F.col("p"))).otherwise(z) / F.sqrt(F.greatest(n, F.lit(1.0)))
    label = F.when(enough, significance_label(F.col("p"))).otherwise("insufficient")
    return out.select(*by, "n_pairs", "n", F.round(F.when(enough, w).otherwise(0.0), 2).alias("w_plus"), F.round("p", 6).alias("p_value"), F.round(F.abs(F.coalesce(strength, F.lit(0.0))), 3).alias("effect_size_r"), label.alias("significance"), F.round("lift", 4).alias("mean_lift"))


def paired_t_test(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), digits: int = 6, level: float = 0.05) -> DataFrame:
    """Two-sided paired t-test of b against a, for each group: pairs, means, lift in percent, wins of b, t, p and the verdict.

    b is better if p is below ``level`` and its lift is positive.  p is 1 where all pairs are
    equal or there are fewer than two, 0 where all differ by the same.  Sums are
    exact decimals, so the result is the same for any partitioning.
    """
    exact = lambda c: F.round(c, digits).cast(f"decimal(24,{digits})")
    rows = df.select(*by, exact(F.col(a)).alias("x"), exact(F.col(b)).alias("y")).where("x is not null and y is not null").withColumn("d", (F.col("y") - F.col("x")).cast(f"decimal(18,{digits})"))
    total = lambda c: F.sum(c).cast("double")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), total("x").alias("sx"), total("y").alias("sy"), total("d").alias("sd"), total(F.col("d") * F.col("d")).alias("sq"), F.count_if(F.col("d") > 0).alias("b_wins"), F.min("d").alias("lo"), F.max("d").alias("hi")).where("n > 0")
    n = F.col("n").cast("double")
    spread = F.greatest((F.col("sq") - F.col("sd") * F.col("sd") / n) / (n - 1), F.lit(0.0))
    flat = F.col("lo") == F.col("hi")
    t = F.when((n > 1) & ~flat, F.col("sd") / n / F.sqrt(spread / n))
    p = F.when((n < 2) | (flat & (F.col("lo") == 0)), 1.0).when(flat, 0.0).otherwise(t_two_sided(F.col("t"), n - 1))
    lift = 100 * (F.col("sy") - F.col("sx")) / n / F.greatest(F.abs(F.col("sx") / n), F.lit(1e-4))
    out = out.withColumn("t", t).withColumn("p", p).withColumn("lift", F.round(lift, 2))
    better = (F.col("p") < level) & (F.col("lift") > 0)
    verdict = F.when(better, "b is better").when(F.col("p") < level, "b is worse").otherwise("no difference shown")
    return out.select(*by, "n", F.round(F.col("sx") / n, 4).alias("mean_a"), F.round(F.col("sy") / n, 4).alias("mean_b"), F.col("lift").alias("lift_pct"), "b_wins", F.round("t", 4).alias("t"), F.round("p", 6).alias("p_value"), better.alias("is_significant"), verdict.alias("verdict"))


def normal_p(z: float) -> float:
    """One-sided p (greater) of a standard normal statistic."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_p(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return float(x)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return 1 - front * h if flip else front * h


def significance(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"


def significance_label(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
