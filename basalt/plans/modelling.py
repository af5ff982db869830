"""Queries of models, importance and selection.  Fits are iterative, so most have no SQL."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import clean, models, profile, select, synth
from ..operators.mart import child_agg
from .registry import query, read

FEATURES = ["ord_count", "ord_o_totalprice_sum", "ord_o_totalprice_mean", "ord_o_totalprice_max", "c_nationkey"]


#: Sizes that keep the registered fits short; the operators' defaults are 100 trees and rounds.
SIZES = {"trees": 20, "rounds": 10, "hidden": (32, 16)}


def customers(spark, d):
    """A mart of all customers with a binary target and stratified folds."""
    orders = child_agg(read(spark, d, "orders"), "o_custkey", "ord", ["o_totalprice"], [])
    df = read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("__key"), "left").drop("__key").fillna(0)
    df = df.withColumn("target", ((F.col("c_acctbal") + F.col("ord_o_totalprice_sum") / 1000) > 6000).cast("int"))
    return clean.kfold(df, "c_custkey", 3, "target")


@contextmanager
def ranked(spark, d) -> Iterator[tuple]:
    """The mart's columns for fits, kept while they are used, and the features' ranks."""
    with models.held(customers(spark, d).select(*FEATURES, "target", "fold")) as df:
        importance = models.importances(models.refit(df, FEATURES, "target", "binary", "RandomForest", **SIZES), FEATURES, spark)
        mi = synth.mi_scores(df, FEATURES, "target").withColumnRenamed("column_name", "feature")
        yield df, select.consensus_rank(importance, mi)


@query()
def leaderboard(spark, d):
    return models.leaderboard(customers(spark, d), FEATURES, "target", "binary", **SIZES)


@query()
def regression_leaderboard(spark, d):
    return models.leaderboard(customers(spark, d), FEATURES, "c_acctbal", "regression", names=["Ridge", "ElasticNet", "RandomForest", "ExtraTrees", "NeuralNet"], **SIZES)


@query()
def weighted_leaderboard(spark, d):
    """Models of the rarest order status, with and without class weights: what of the small class they find."""
    df = read(spark, d, "lineitem").join(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.groupBy("o_orderkey", "o_orderstatus", "o_totalprice").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("pieces"), F.max("l_discount").alias("discount"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"))
    df = clean.kfold(df.withColumn("target", (F.col("o_orderstatus") == "P").cast("int")), "o_orderkey", 3, "target")
    return models.weighted_comparison(df, ["o_totalprice", "lines", "pieces", "discount", "open_lines"], "target", ["LogisticRegression", "ExtraTrees"], **SIZES)


@query()
def batch_prediction(spark, d):
    df = customers(spark, d)
    model = models.refit(df, FEATURES, "target", "binary", "GradientBoosting", **SIZES)
    return models.predict(model, df.select("c_custkey", *[F.col(f).cast("double").alias(f) for f in FEATURES]), FEATURES).select("c_custkey", "prediction", F.round("probability", 6).alias("probability"))


def contributions(spark, d):
    df = customers(spark, d)
    return df, select.attribute(models.refit(df, FEATURES, "target", "binary", "RandomForest", **SIZES), df, FEATURES, "c_custkey")


@query()
def attribution(spark, d):
    return contributions(spark, d)[1]


@query()
def global_importance(spark, d):
    return select.global_importance(contributions(spark, d)[1])


@query()
def effect_direction(spark, d):
    df, made = contributions(spark, d)
    return select.effect_direction(made, df, "c_custkey", FEATURES)


@query()
def representative_cases(spark, d):
    return select.representative_cases(contributions(spark, d)[1], "c_custkey")


@query()
def consensus_selection(spark, d):
    with ranked(spark, d) as (df, ranks):
        found = [tuple(r) for r in ranks.collect()]  # a row for each feature
        return select.select_features(spark.createDataFrame(found, ranks.schema), profile.corr_pairs(df, FEATURES, 0.0))


@query()
def pareto_curve(spark, d):
    with ranked(spark, d) as (df, ranks):
        return select.pareto_curve(df, [r.feature for r in ranks.orderBy("rank").collect()], "target", "binary", **SIZES)


@query()
def forward_selection(spark, d):
    with ranked(spark, d) as (df, ranks):
        return select.forward_selection(df, [r.feature for r in ranks.orderBy("rank").collect()], "target", "binary", **SIZES)


@query()
def segment_importance(spark, d):
    return select.segment_importance(customers(spark, d), FEATURES, "target", "c_mktsegment", **SIZES)


@query()
def feature_ab(spark, d):
    df = customers(spark, d).withColumn("order_share", F.col("ord_o_totalprice_max") / (F.col("ord_o_totalprice_sum") + 1))
    return select.feature_ab(df, FEATURES, [*FEATURES, "order_share"], "target", "binary", 3, **SIZES)


@query()
def scout(spark, d):
    return select.scout(customers(spark, d), FEATURES, "target", "binary", **SIZES)
