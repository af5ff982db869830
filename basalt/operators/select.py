"""Feature importance, attribution, consensus ranks and selection."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import exact_quantiles
from .models import assemble, at_once, candidates, cross_validate, held


def attribute(model: Model, df: DataFrame, features: list[str], key: str) -> DataFrame:
    """Marginal attribution: prediction minus the prediction with a feature at its median, for every row and feature.

    Contributions are rescaled so that they add up to prediction minus base (the
    prediction with all features at their medians).  One ``transform`` covers
    all variants of all rows.
    """
    med = {f: v[0] for f, v in exact_quantiles(df, features, [0.5]).items()}
    variants = F.explode(F.sequence(F.lit(-2), F.lit(len(features) - 1)))
    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in features], variants.alias("v"))
    swapped = rows.select(key, "v", *[F.when((F.col("v") == i) | (F.col("v") == -2), F.lit(float(med[f]))).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)])
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(swapped))
    score = F.element_at(vector_to_array("probability"), -1) if "probability" in scored.columns else F.col("prediction")
    scored = scored.select(key, "v", score.alias("p"))
    w = Window.partitionBy(key)
    full, base = F.max(F.when(F.col("v") == -1, F.col("p"))).over(w), F.max(F.when(F.col("v") == -2, F.col("p"))).over(w)
    raw = scored.select(key, "v", "p", full.alias("prediction"), base.alias("base")).where("v >= 0").withColumn("raw", F.col("prediction") - F.col("p"))
    total, n = F.sum("raw").over(w), len(features)
    even = (F.col("prediction") - F.col("base")) / n
    out = raw.withColumn("contribution", F.when(F.abs(total) > 1e-12, F.col("raw") / total * (F.col("prediction") - F.col("base"))).otherwise(even))
    return out.select(key, F.element_at(F.array(*map(F.lit, features)), F.col("v") + 1).alias("feature"), "contribution", "prediction", "base")


def global_importance(contributions: DataFrame) -> DataFrame:
    out = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    share = 100 * F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy())
    return out.select("feature", "mean_abs", share.alias("share_pct"), F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")).alias("rank"), (share < 1.5).alias("is_noise"))


def effect_direction(contributions: DataFrame, values: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Sign of the correlation between a feature and its contribution."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = values.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    r = contributions.join(long, [key, "feature"]).groupBy("feature").agg(F.corr("x", "contribution").alias("r"))
    return r.select("feature", "r", F.when(F.col("r") > 0.05, "positive").when(F.col("r") < -0.05, "negative").otherwise("non-linear").alias("direction"))


def representative_cases(contributions: DataFrame, key: str, drivers: int = 6) -> DataFrame:
    """Rows of the highest, middle and lowest prediction with their strongest drivers."""
    preds = contributions.select(key, "prediction").distinct().persist()
    mid = (exact_quantiles(preds, ["prediction"], [0.5], discrete=True)["prediction"] or [None])[0]
    away = F.abs(F.col("prediction") - F.lit(mid).cast("double"))
    found = preds.agg(F.max_by(key, F.struct("prediction", F.col(key))).alias("highest"), F.min_by(key, F.struct(away, F.col(key))).alias("median"), F.min_by(key, F.struct("prediction", F.col(key))).alias("lowest"))
    picked = contributions.sparkSession.createDataFrame([tuple(found.first())], found.schema)
    preds.unpersist()
    cases = F.broadcast(picked.select(F.explode(F.array(*[F.struct(F.lit(c).alias("case"), F.col(c).alias(key)) for c in ("highest", "median", "lowest")])).alias("x")).select("x.*"))  # three rows
    place = F.row_number().over(Window.partitionBy("case").orderBy(F.desc(F.abs("contribution")), "feature"))
    return contributions.join(cases, key).withColumn("place", place).where(F.col("place") <= drivers)


def consensus_rank(importance: DataFrame, mi: DataFrame) -> DataFrame:
    """Weighted sum of two ranks: 0.65 importance, 0.35 mutual information."""
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "feature"))
    both = importance.select("feature", "importance", rank("importance").alias("r1")).join(mi.select("feature", "mi", rank("mi").alias("r2")), "feature")
    return both.withColumn("score", 0.65 * F.col("r1") + 0.35 * F.col("r2")).withColumn("rank", F.row_number().over(Window.orderBy("score", "feature")))


def select_features(ranked: DataFrame, pairs: DataFrame, cap: int = 12, most_r: float = 0.8, least_share: float = 0.01, coverage: float = 0.95, at_least: int = 3, profile: str = "lean_pareto") -> DataFrame:
    """Greedy choice in rank order with a status and reason for every feature.

    ``ranked`` (feature, importance, rank) and ``pairs`` (column_a, column_b, r)
    have a row for each feature or pair of features, so they are driver-sized.
    """
    derived = ("ratio", "poly", "_per_", "inter")
    near: dict[str, set[str]] = {}
    for p in pairs.where(F.abs("r") > most_r).collect():
        near.setdefault(p.column_a, set()).add(p.column_b)
        near.setdefault(p.column_b, set()).add(p.column_a)
    rows = ranked.orderBy("rank").collect()
    total = sum(r.importance for r in rows) or 1.0
    chosen, status, covered = [], {}, 0.0
    for r in rows:
        twin = next((c for c in chosen if c in near.get(r.feature, ())), None)
        if twin:
            status[r.feature] = ("pruned", f"redundant with {twin}")
        elif profile == "explainable" and any(x in r.feature for x in derived):
            status[r.feature] = ("pruned", "not explainable")
        elif r.importance / total < least_share:
            status[r.feature] = ("pruned", "noise")
        elif profile != "max_performance" and (len(chosen) >= cap or covered >= coverage):
            status[r.feature] = ("pruned", "cap" if len(chosen) >= cap else "coverage reached")
        else:
            chosen.append(r.feature)
            covered += r.importance / total
            status[r.feature] = ("selected", "ranked")
    for r in rows:  # too few: the best that are not redundant come back
        if len(chosen) < at_least and status[r.feature][1] in ("noise", "cap", "coverage reached"):
            chosen.append(r.feature)
            status[r.feature] = ("selected", "rescued")
    return ranked.sparkSession.createDataFrame([(r.feature, r.rank, *status[r.feature]) for r in rows], "feature string, rank int, status string, reason string")


def reduction_summary(selection: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("status") == "selected")
    return selection.agg(F.count("*").alias("before"), kept.alias("after"), F.round(100 * (F.count("*") - kept) / F.count("*"), 4).alias("reduced_pct"))


def elbow(curve: DataFrame, at_least: int = 3, retention: float = 0.97, gain: float = 0.015) -> DataFrame:
    """The first k whose score keeps enough of the best, or whose gain is small; with the whole curve."""
    w = Window.orderBy("k")
    best = F.max("score").over(Window.partitionBy())
    step = curve.withColumns({"retention": F.col("score") / best, "gain": F.col("score") - F.lag("score").over(w)})
    ok = (F.col("k") >= at_least) & ((F.col("retention") >= retention) | (F.coalesce(F.col("gain"), F.lit(1.0)) < gain))
    first = F.min(F.when(ok, F.col("k"))).over(Window.partitionBy())
    return step.withColumn("is_elbow", F.col("k") == F.coalesce(first, F.max("k").over(Window.partitionBy())))


def _held(df: DataFrame, features: list[str], target: str, *more: str):
    """The columns that fits read, kept for all of them, so that no fit computes the mart again."""
    own = list(dict.fromkeys([*features, target, *more]))
    if set(own) <= set(df.columns) and df.storageLevel.useMemory:
        return nullcontext(df)  # kept by the caller
    return held(df.select(*own))


def pareto_curve(df: DataFrame, ranked: list[str], target: str, task: str, k: int = 3, model: str = "RandomForest", **sizes) -> DataFrame:
    """Cross-validated score of the first 1, 2, ... features; ``df`` has a fold column."""
    with _held(df, ranked, target, "fold") as data:
        fit = lambda size: cross_validate(assemble(data, ranked[:size], target), candidates(task, size, **sizes)[model], task, k)[0]
        rows = [(i + 1, float(next(iter(metrics.values())))) for i, metrics in enumerate(at_once(fit, range(1, len(ranked) + 1)))]
    return elbow(df.sparkSession.createDataFrame(rows, "k int, score double"))


def forward_selection(df: DataFrame, ranked: list[str], target: str, task: str, k: int = 3, tolerance: float = 0.0, model: str = "RandomForest", **sizes) -> DataFrame:
    """Add features one by one; one that lowers the best score by more than the tolerance is left out."""
    rows, kept, best = [], [], float("-inf")
    with _held(df, ranked, target, "fold") as data:
        for f in ranked:
            metrics, _ = cross_validate(assemble(data, [*kept, f], target), candidates(task, len(kept) + 1, **sizes)[model], task, k)
            score = float(next(iter(metrics.values())))
            keep = score >= best - tolerance
            rows.append((len(rows) + 1, f, score, keep))
            if keep:
                kept, best = [*kept, f], max(best, score)
    out = df.sparkSession.createDataFrame(rows, "step int, feature string, score double, kept boolean")
    w = Window.orderBy("step")
    return out.withColumns({"lift": F.col("score") - F.lag("score").over(w), "total_lift": F.col("score") - F.first("score").over(w)})


def segment_importance(df: DataFrame, features: list[str], target: str, segment: str, least: int = 15, **sizes) -> DataFrame:
    """Importances in every segment (segments are few), with their spread; too small ones use all rows."""
    from .models import importances, refit

    with _held(df, features, target, segment) as data:
        fit = lambda rows: importances(refit(rows, features, target, "binary", "RandomForest", **sizes), features, df.sparkSession)
        segments = data.groupBy(segment).agg(F.count("*").alias("n"), F.countDistinct(target).alias("c")).orderBy(segment).collect()
        large = [row[0] for row in segments if row.n >= least and row.c >= 2]
        every, *made = at_once(fit, [data, *[data.where(F.col(segment).eqNullSafe(v)) for v in large]])
    own = dict(zip(large, made, strict=True))
    out = every.withColumn("segment", F.lit("ALL"))
    for row in segments:
        out = out.unionByName(own.get(row[0], every).withColumn("segment", F.lit(str(row[0]))))
    w = Window.partitionBy("feature")
    return out.withColumns({"divergence": F.max("importance").over(w) - F.min("importance").over(w), "top_segment": F.max_by("segment", F.struct("importance", "segment")).over(w)})


def screen_features(df: DataFrame, features: list[str], target: str, task: str, above: int = 50, keep: int = 30, **sizes) -> list[str]:
    """All features if there are at most ``above``; else the ``keep`` most important ones of a first fit."""
    if len(features) <= above:
        return features
    from .models import importances, refit

    first = importances(refit(df, features, target, task, "RandomForest", **sizes), features, df.sparkSession)
    chosen = {r.feature for r in first.orderBy(F.desc("importance"), "feature").limit(keep).collect()}
    return [f for f in features if f in chosen]


def scout(df: DataFrame, features: list[str], target: str, task: str, k: int = 3, **sizes) -> DataFrame:
    """Boosted trees (bagged ones for several classes) on the screened features: each one's importance and the cross-validated score."""
    from .models import importances, refit

    own = screen_features(df, features, target, task, **sizes)
    name = "RandomForest" if task == "multiclass" else "GradientBoosting"
    with _held(df, own, target, "fold") as data:
        n_classes = 0 if task == "regression" else int(data.agg(F.max(target)).first()[0]) + 1
        metrics, _ = cross_validate(assemble(data, own, target), candidates(task, len(own), n_classes, **sizes)[name], task, k)
        score = metrics.get("auc", next(iter(metrics.values())))
        made = importances(refit(data, own, target, task, name, **sizes), own, df.sparkSession)
    return made.withColumns({"score": F.lit(float(score)), "rank": F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))})  # a row for each feature


def feature_ab(df: DataFrame, base: list[str], engineered: list[str], target: str, task: str, k: int = 5, model: str = "GradientBoosting", **sizes) -> DataFrame:
    """Two feature sets on the same folds: fold scores, lift, paired t-test and folds won by the engineered set."""
    from .models import evaluate
    from .stats import t_p

    with _held(df, [*base, *engineered], target, "fold") as kept:

        def fold_score(job: tuple[list[str], int]) -> float:
            features, fold = job
            data = assemble(kept, features, target)
            fitted = candidates(task, len(features), **sizes)[model].fit(data.where(F.col("fold") != fold))
            return float(next(iter(evaluate(fitted.transform(data.where(F.col("fold") == fold)), task).values())))

        every = at_once(fold_score, [(features, fold) for features in (base, engineered) for fold in range(k)])
    scores = [every[:k], every[k:]]
    a, b = (sum(s) / k for s in scores)
    gaps = [y - x for x, y in zip(*scores, strict=True)]
    mean = sum(gaps) / k
    spread = (sum((g - mean) ** 2 for g in gaps) / (k - 1)) ** 0.5
    p = 1.0 if not spread else t_p(mean / (spread / k**0.5), k - 1)
    lift = round(100 * (b - a) / max(abs(a), 1e-4), 2)
    row = (*scores, a, b, lift, p, p < 0.05 and lift > 0, sum(g > 0 for g in gaps))
    return df.sparkSession.createDataFrame([row], "base_scores array<double>, engineered_scores array<double>, base_mean double, engineered_mean double, lift_pct double, p_value double, is_significant boolean, folds_won int")


def segment_insights(segments: DataFrame, lift: float = 0.2, k: int = 2) -> DataFrame:
    """The strongest features of each segment that stand out against all rows."""
    base = segments.where("segment = 'ALL'").select("feature", F.col("importance").alias("base"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("importance"), "feature"))
    out = segments.where("segment <> 'ALL'").join(base, "feature").withColumn("place", place).where(F.col("place") <= k)
    return out.where(F.col("importance") > (1 + lift) * F.col("base"))


def recommend_features(summary: DataFrame, importance: DataFrame, top: int = 3, prune: int = 4) -> DataFrame:
    """Ratios among the strongest features, logarithms of skewed ones, and what to prune.

    ``summary``: feature, distinct_values, min_value, skew (sample-corrected).
    """
    joined = summary.join(importance, "feature").withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    a, b = (joined.where(f"distinct_values > 10 and place <= {top}").select(F.col("feature").alias(n), F.col("place").alias(f"p{n}")) for n in "ab")
    ratios = a.join(b, F.col("pa") < F.col("pb")).select(F.lit("ratio").alias("kind"), F.concat_ws("/", "a", "b").alias("feature"))
    logs = joined.where("min_value >= 0 and abs(skew) > 1.2").select(F.lit("log1p").alias("kind"), "feature")
    worst = joined.withColumn("back", F.row_number().over(Window.orderBy("importance", "feature"))).where(F.col("back") <= prune).select(F.lit("prune").alias("kind"), "feature")
    return ratios.unionByName(logs).unionByName(worst)


def parameter_sensitivity(runs: DataFrame, params: list[str], score: str) -> DataFrame:
    """|correlation| of each run parameter with the score, as shares."""
    from .profile import stack

    agg = runs.agg(*[F.coalesce(F.abs(F.corr(p, score)), F.lit(0.0)).alias(p) for p in params])
    out = stack(agg, [{"param": F.lit(p), "r": F.col(p)} for p in params])
    total = F.sum("r").over(Window.partitionBy())
    return out.select("param", F.when(total > 0, F.col("r") / total).otherwise(1.0 / len(params)).alias("share"))


def apply_selection(df: DataFrame, selected: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in selected])


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    ends = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    made = {c: F.when(F.col(f"{c}__hi") > F.col(f"{c}__lo"), (F.col(c) - F.col(f"{c}__lo")) / (F.col(f"{c}__hi") - F.col(f"{c}__lo"))).otherwise(0.0) for c in columns}
    return df.join(ends, how="cross").withColumns(made).select(*df.columns)
