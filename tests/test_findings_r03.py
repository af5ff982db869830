"""What a review of round 3 found: tasks of fits, medians, numbering of blocks, token weights, neighbours."""

import duckdb
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from basalt.functions.ordered import exact_quantiles, running_sums
from basalt.operators import models, recommend, select


def test_tables_of_fits_have_tasks_by_their_rows(spark):
    with models.held(spark.range(9000).repartition(64)) as df:
        assert df.rdd.getNumPartitions() == 3 and df.count() == 9000
    assert not df.storageLevel.useMemory


def test_metrics_of_one_count_are_those_of_the_library(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("label"), F.when(F.col("id") % 7 < 3, 2.0).otherwise((F.col("id") % 2).cast("double")).alias("prediction"))
    got = models.evaluate(df, "multiclass")
    for name, value in got.items():
        assert value == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(df), abs=1e-12)


@pytest.mark.parametrize("n", [5, 60_000])
def test_the_middle_case_is_the_exact_median(spark, n):
    # Values whose approximate median is another row's once there are more than 10,000 of them.
    made = spark.range(n).select(F.col("id").alias("key"), F.lit("f").alias("feature"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("prediction"), F.lit(1.0).alias("contribution"))
    rows = made.select("key", "prediction").toPandas()
    mid = duckdb.sql("select quantile_disc(prediction, 0.5) from rows").fetchall()[0][0]
    want = rows.loc[(rows.prediction - mid).abs().idxmin(), "key"]
    got = {r.case: r.key for r in select.representative_cases(made, "key").collect()}
    assert got["median"] == want and got["highest"] == rows.loc[rows.prediction.idxmax(), "key"]
    assert exact_quantiles(made, ["prediction"], [0.1, 0.5], discrete=True)["prediction"] == list(duckdb.sql("select quantile_disc(prediction, [0.1, 0.5]) from rows").fetchall()[0][0])


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_running_sums_of_groups_in_many_blocks(spark, kind):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.when(F.col("id") > 2, (F.col("id") * 7919) % 20_011)).cast(kind).alias("x"), (F.col("id") % 5).alias("n"))
    rows = df.toArrow()  # noqa: F841
    want = duckdb.sql("select g, x, coalesce(sum(n) over (partition by g order by x nulls first rows between unbounded preceding and 1 preceding), 0)::bigint as b from rows").fetchall()
    got = {(r.g, r.x): r.n_before for r in running_sums(df, "x", ["n"], by=("g",)).collect()}
    assert len(got) == 20_000 and got == {(g, x): b for g, x, b in want}


@pytest.mark.parametrize("most", [0, 7, 1_000_000])
def test_token_weights_for_any_number_of_broadcast_tokens(spark, most):
    docs = spark.range(60).select("id", F.expr("concat_ws(' ', 'All', id % 2, 'a-b a-b', id % 11, 'own' || id)").alias("text"))
    rows = docs.toArrow()  # noqa: F841
    counts = recommend.token_counts(docs, "id", "text")
    assert str(counts._jdf.queryExecution().executedPlan()).count("hashpartitioning(") == 1  # texts by id, postings nowhere
    got = {(r.id, r.token): r.weight for r in recommend.tfidf(counts, recommend.idf(counts, docs.agg(F.count("*").alias("docs"))), most).collect()}
    sql = "with d as (select id, unnest(regexp_extract_all(lower(text), '[\\w-]+')) as token from rows), c as (select id, token, count(*) as tf from d group by 1, 2), w as (select token, ln(61 / (1 + count(*))::double) + 1 as idf from c group by 1) select id, token, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by id)) from c join w using (token)"
    want = {(i, t): w for i, t, w in duckdb.sql(sql).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
