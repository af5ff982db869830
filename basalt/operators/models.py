"""Models on common folds: baselines, MLlib families, leaderboard, champion, predictions."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extra_trees import ExtraTrees
from .neural import NeuralRegressor

BASELINES = ("GlobalStat", "OneSplit")


def task_type(df: DataFrame, target: str) -> DataFrame:
    """binary, multiclass or regression, by type and number of values."""
    text = isinstance(df.schema[target].dataType, T.StringType)
    n = F.countDistinct(target)
    return df.agg(n.alias("distinct_values")).select(F.lit(target).alias("column_name"), "distinct_values", F.when(F.col("distinct_values") == 2, "binary").when(F.lit(text) | (F.col("distinct_values") <= 10), "multiclass").otherwise("regression").alias("task"))


def baseline_global(df: DataFrame, target: str) -> DataFrame:
    """The most frequent class (smallest on ties) and its accuracy."""
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("majority")).agg(F.count("*").alias("n"))
    return counted.agg(F.min_by("majority", F.struct(-F.col("n"), F.col("majority"))).alias("majority"), F.round(F.max("n") / F.sum("n"), 4).alias("accuracy"))


def assemble(df: DataFrame, features: list[str], target: str) -> DataFrame:
    ready = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], *[c for c in df.columns if c not in features and c not in ("features", "label")], F.col(target).cast("double").alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(ready)


def candidates(task: str, n_features: int, n_classes: int = 2, seed: int = 42, trees: int = 100, rounds: int = 100, hidden: tuple[int, ...] = (128, 64), weight: str | None = None) -> dict:
    """Estimators by name, with the one-split baseline; ``trees`` are bagged, ``rounds`` boosted.

    ``weight`` names a column of row weights for every model that takes one (the
    classifying network doesn't).
    """
    extra = ExtraTrees(task, trees=trees, seed=seed, weight=weight)
    if task == "regression":
        out = {"OneSplit": DecisionTreeRegressor(maxDepth=1), "Ridge": LinearRegression(regParam=0.1), "ElasticNet": LinearRegression(regParam=0.1, elasticNetParam=0.5), "RandomForest": RandomForestRegressor(numTrees=trees, seed=seed), "ExtraTrees": extra, "GradientBoosting": GBTRegressor(maxIter=rounds, maxDepth=4, stepSize=0.08, seed=seed), "NeuralNet": NeuralRegressor(hidden, steps=max(30, rounds), seed=seed, weight=weight)}
    else:
        boosted = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.08, seed=seed)
        out = {
            "OneSplit": DecisionTreeClassifier(maxDepth=1), "LogisticRegression": LogisticRegression(), "RandomForest": RandomForestClassifier(numTrees=trees, seed=seed), "ExtraTrees": extra,
            "GradientBoosting": boosted if task == "binary" else OneVsRest(classifier=boosted), "NeuralNet": MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=30, seed=seed),
        }
    for model in out.values():
        if weight and hasattr(model, "hasParam") and model.hasParam("weightCol"):
            model.set(model.getParam("weightCol"), weight)
    return out


def class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """``df`` with each row's balanced weight, rows / (classes * rows of its class), as a column for ``weight``."""
    counts = [tuple(r) for r in df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*")).orderBy(target).collect()]  # a row for each class
    total = sum(n for _, n in counts)
    worth = F.lit(None).cast("double")
    for value, n in counts:
        worth = F.when(F.col(target) == F.lit(value), F.lit(total / (len(counts) * n))).otherwise(worth)
    return df.withColumn(name, worth)


def _told(predicted: DataFrame, task: str, by: str) -> dict:
    """The metrics (but for auc) of each value of ``by``, a column of few values, from one pass.

    Of numbers r2, rmse and mae; of classes f1 (by class, weighted by the classes'
    rows) and accuracy, from a count of label and prediction.
    """
    if task == "regression":
        off = F.col("prediction") - F.col("label")
        rows = predicted.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("n"), F.sum(off * off).alias("e"), F.sum(F.abs(off)).alias("a"), F.var_pop("label").alias("v")).collect()
        # As the library's: without spread of the labels r2 is minus infinity, or no number if nothing is off.
        share = lambda e, v: e / v if v else math.inf if e else math.nan
        return {r["__by"]: {"r2": 1 - share(r.e, r.v * r.n), "rmse": math.sqrt(r.e / r.n), "mae": r.a / r.n} for r in rows}
    told: dict = {}
    for r in predicted.groupBy(F.col(by).alias("__by"), "label", "prediction").agg(F.count("*").alias("n")).collect():  # a row for each pair of classes
        told.setdefault(r["__by"], {})[r.label, r.prediction] = r.n
    return {key: _of_counts(counts) for key, counts in told.items()}


def _of_counts(counts: dict[tuple, int]) -> dict[str, float]:
    total = sum(counts.values())
    side = lambda i, v: sum(n for k, n in counts.items() if k[i] == v)
    f1 = sum(side(0, v) * 2 * counts.get((v, v), 0) / (side(0, v) + side(1, v)) for v in sorted({k[0] for k in counts})) / total
    return {"f1": f1, "accuracy": sum(n for (a, b), n in counts.items() if a == b) / total}


def _with_auc(metrics: dict[str, float] | None, predicted: DataFrame, task: str) -> dict[str, float]:
    if metrics is None:
        raise ValueError("no rows to score")
    return metrics | ({"auc": BinaryClassificationEvaluator().evaluate(predicted)} if task == "binary" and "rawPrediction" in predicted.columns else {})


def first_metric(predicted: DataFrame, task: str) -> float:
    """The metric that models are ranked by."""
    return next(iter(_with_auc(_told(predicted.withColumn("__all", F.lit(True)), task, "__all").get(True), predicted.select("label"), task).values()))


def evaluate(predicted: DataFrame, task: str) -> dict[str, float]:
    return _with_auc(_told(predicted.withColumn("__all", F.lit(True)), task, "__all").get(True), predicted, task)


#: Tasks of a table kept for fits: the root of its rows over this, so both tasks and rows of a task grow.
PACK = 2_000


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept for the passes of fits, in as many tasks as its rows are worth.

    A fit runs hundreds of short jobs; over the partitions of the last shuffle,
    whose number is a setting and not the table's, starting tasks takes all the time.
    """
    wide = df.persist()
    packed = wide.coalesce(max(1, math.ceil((wide.count() / PACK) ** 0.5))).persist()
    packed.count()
    wide.unpersist()
    try:
        yield packed
    finally:
        packed.unpersist()


#: Fits that run side by side; Spark shares the executors among their jobs.
SIDE_BY_SIDE = 3


def at_once(run, jobs) -> list:
    """``run`` of each job, a few at a time; the results are in the order of the jobs."""
    with ThreadPool(SIDE_BY_SIDE) as pool:
        return pool.map(inheritable_thread_target(run), jobs)


def cross_validate(data: DataFrame, estimator, task: str, k: int) -> tuple[dict[str, float], float]:
    """Mean fold metrics and the mean training score; ``data`` has a fold column."""
    together = estimator.fit_folds(data, k) if hasattr(estimator, "fit_folds") else None

    def one(fold: int) -> tuple[dict[str, float], float]:
        model = together[fold] if together else estimator.fit(data.where(F.col("fold") != fold))
        made = model.transform(data).withColumn("__out", F.col("fold") == fold)
        told = _told(made, task, "__out")  # both sides in one pass
        return _with_auc(told.get(True), made.where("__out"), task), next(iter(_with_auc(told.get(False), made.select("label"), task).values()))

    scores, trained = zip(*at_once(one, range(k)), strict=True)
    return {m: sum(s[m] for s in scores) / k for m in scores[0]}, sum(trained) / k


def leaderboard(df: DataFrame, features: list[str], target: str, task: str, k: int = 3, fold: str = "fold", names: list[str] | None = None, **sizes) -> DataFrame:
    """One row for each model: score, all metrics, overfit gap, time and rank; failures keep a row.

    ``df`` has a column of fold numbers, the same for all models; ``sizes`` (and the
    name of a column of weights) go to ``candidates``.  Metrics count every row once.
    """
    weights = [sizes["weight"]] if sizes.get("weight") else []
    with held(assemble(df, features, target).select("features", "label", F.col(fold).alias("fold"), *weights)) as data:
        n_classes = 0 if task == "regression" else int(data.agg(F.max("label")).first()[0]) + 1
        rows = [("GlobalStat", *_global(data, task, k), 0.0, 0.0, None)]
        for name, estimator in candidates(task, len(features), n_classes, **sizes).items():
            if names and name not in names and name not in BASELINES:
                continue
            began = time.time()
            try:
                metrics, train = cross_validate(data, estimator, task, k)
                score = next(iter(metrics.values()))
                rows.append((name, score, {m: float(v) for m, v in metrics.items()}, abs(train - score), time.time() - began, None))
            except Exception as error:  # a model that cannot be fitted keeps its row
                rows.append((name, None, {}, None, time.time() - began, str(error)[:200]))
    out = df.sparkSession.createDataFrame(rows, "model string, score double, metrics map<string,double>, overfit_gap double, seconds double, error string")
    gap = F.col("overfit_gap")
    out = out.withColumns({"is_baseline": F.col("model").isin(*BASELINES), "overfit": F.when(gap > 0.15, "High").when(gap > 0.08, "Moderate").otherwise("Low")})
    for column, model in (("lift_pct", "GlobalStat"), ("lift_segment_pct", "OneSplit")):
        base = F.max(F.when(F.col("model") == model, F.col("score"))).over(Window.partitionBy())  # over a row for each model
        out = out.withColumn(column, F.when(base != 0, 100 * (F.col("score") - base) / F.abs(base)))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "model")))


def weighted_comparison(df: DataFrame, features: list[str], target: str, names: list[str], k: int = 3, points: int = 99, **sizes) -> DataFrame:
    """(model, weighted, recall, precision, f1, best_threshold, best_f1) of class 1 over all folds, without and with balanced class weights.

    Each fold's weights come from its training rows; scores of the left-out rows
    are counted on a grid of thresholds, whose best f1 is told too.
    """
    from .stats import threshold_counts

    rows = []
    div = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    jobs = [(name, weighted) for name in names for weighted in (False, True)]
    with held(assemble(df, features, target).select("features", "label", "fold")) as data:

        def scored(job: tuple[str, bool]) -> DataFrame:
            name, weighted = job
            out = None
            for fold in range(k):
                train = data.where(F.col("fold") != fold)
                train = class_weights(train, "label", "__weight") if weighted else train
                model = candidates("binary", len(features), weight="__weight" if weighted else None, **sizes)[name].fit(train)
                part = model.transform(data.where(F.col("fold") == fold)).select("label", "prediction", F.element_at(vector_to_array("probability"), -1).alias("score"))
                out = part if out is None else out.unionByName(part)
            return out

        for (name, weighted), own in zip(jobs, at_once(scored, jobs), strict=True):
            hit = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
            plain = own.agg(div(hit, F.count_if(F.col("label") == 1)).alias("recall"), div(hit, F.count_if(F.col("prediction") == 1)).alias("precision"), div(2 * hit, F.count_if(F.col("label") == 1) + F.count_if(F.col("prediction") == 1)).alias("f1"))
            grid = threshold_counts(own, "label", "score", 0.01, 0.01, points).withColumn("f", div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
            best = grid.agg(F.min_by(F.struct("threshold", "f"), F.struct(-F.col("f"), "threshold")).alias("b")).first().b
            rows.append((name, weighted, *plain.first(), best.threshold, best.f))
    return df.sparkSession.createDataFrame(rows, "model string, weighted boolean, recall double, precision double, f1 double, best_threshold double, best_f1 double")


def leaderboard_labels(board: DataFrame, best: str) -> DataFrame:
    """``board`` (model, rank, is_baseline) with each model's role, family and complexity."""
    m = F.col("model")
    role = F.when(m == best, "champion").when(m == "GlobalStat", "baseline: overall statistic").when(m == "OneSplit", "baseline: segment rule").when(F.col("rank") <= 2, "runner-up").otherwise("alternative")
    family = F.when(m.isin(*BASELINES), "heuristic baseline").when(m.contains("Boosting"), "boosted trees").when(m.contains("Net"), "neural network").when(m.rlike("Forest|ExtraTrees"), "bagged trees").when(m.rlike("Logistic|Ridge|Elastic"), "linear").otherwise("machine learning")
    cost = F.when(m == "GlobalStat", "minimal").when((m == "OneSplit") | m.rlike("Logistic|Ridge"), "low").when(m.contains("Net"), "high").otherwise("medium")
    return board.withColumns({"role": role, "family": family, "complexity": cost})


def legacy_comparison(board: DataFrame, best: str, legacy: str | None = None) -> DataFrame:
    """The champion against a named model, else against the best-ranked baseline, else against the runner-up: scores and lift."""
    named = F.lower("model").contains((legacy or "").lower()) if legacy else F.lit(False)
    order = F.struct(F.when(named, 0).when(F.col("is_baseline"), 1).when(F.col("rank") == 2, 2).otherwise(3), "rank")
    old = board.where(F.col("model") != best).agg(F.min_by(F.struct("model", "score"), order).alias("o"))
    new = board.where(F.col("model") == best).select(F.col("model").alias("champion"), F.col("score").alias("champion_score"))
    lift = 100 * (F.col("champion_score") - F.col("o.score")) / F.greatest(F.abs("o.score"), F.lit(1e-6))
    return new.join(old, how="cross").select(F.col("o.model").alias("legacy"), "champion", F.round("o.score", 4).alias("legacy_score"), F.round("champion_score", 4).alias("champion_score"), F.round(lift, 2).alias("lift_pct"))  # one row each


def _global(data: DataFrame, task: str, k: int) -> tuple[float, dict[str, float]]:
    """The constant model: majority class or mean of the other folds."""

    def one(fold: int) -> dict[str, float]:
        train = data.where(F.col("fold") != fold)
        value = train.agg(F.avg("label")).first()[0] if task == "regression" else baseline_global(train, "label").first()[0]
        return evaluate(data.where(F.col("fold") == fold).withColumn("prediction", F.lit(float(value))), task)

    totals = at_once(one, range(k))
    metrics = {m: sum(t[m] for t in totals) / k for m in totals[0]}
    return next(iter(metrics.values())), metrics


def champion(board: DataFrame) -> str:
    return board.where("not is_baseline and score is not null").orderBy("rank").first().model


def refit(df: DataFrame, features: list[str], target: str, task: str, name: str, **sizes) -> Model:
    """A named model on all rows."""
    data = assemble(df, features, target)
    n_classes = 0 if task == "regression" else int(data.agg(F.max("label")).first()[0]) + 1
    return candidates(task, len(features), n_classes, **sizes)[name].fit(data)


def importances(model: Model, features: list[str], spark) -> DataFrame:
    """Normalised importances, or absolute coefficients, of a fitted model."""
    raw = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    raw = [abs(float(x)) for x in raw.toArray()]
    total = sum(raw) or 1.0
    return spark.createDataFrame([(f, x / total) for f, x in zip(features, raw, strict=True)], "feature string, importance double")


def predict(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """Predictions (missing features are 0) with the probability of the last class."""
    full = df.withColumns({f: F.lit(0.0) for f in features if f not in df.columns})
    data = VectorAssembler(inputCols=features, outputCol="features").transform(full.fillna(0.0, features))
    out = model.transform(data)
    if "probability" in out.columns:
        out = out.withColumn("probability", F.element_at(vector_to_array("probability"), -1))
    return out.drop("features", "rawPrediction")
