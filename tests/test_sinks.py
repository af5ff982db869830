"""Run records, histories, scored files, warmed feature tables and bounded one-row results."""

import pytest
from basalt import sources
from basalt.operators import audit, clean, recommend
from pyspark.sql import functions as F


def test_feature_store_is_warmed_for_several_tasks(spark, tmp_path):
    store, df, made = sources.FeatureStore(spark, str(tmp_path / "store")), spark.range(20), []

    def twice(rows):
        made.append("twice")
        return rows.withColumn("twice", 2 * F.col("id"))

    def square(rows):
        made.append("square")
        return rows.withColumn("square", F.col("id") * F.col("id"))

    tasks = {"a": twice, "b": square}
    assert [tuple(r) for r in store.warm(df, tasks).collect()] == [("a", False), ("b", False)]
    assert [tuple(r) for r in store.warm(df, tasks).collect()] == [("a", True), ("b", True)] and made == ["twice", "square"]
    assert [tuple(r) for r in store.warm(df.limit(5), {"a": twice}).collect()] == [("a", False)]  # other rows, another table
    assert store.get("b", df, square)[0].agg(F.sum("square")).first()[0] == sum(i * i for i in range(20))
    assert len(store.clear()) == 3 and store.warm(df, {"a": twice}).first().hit is False


def test_run_records(spark, tmp_path):
    board = spark.createDataFrame([("a", 0.5), ("b", None)], "model string, score double")
    run = sources.write_run({"leaderboard": board, "rows": spark.range(3)}, str(tmp_path))
    back = spark.read.json(f"{tmp_path}/{run}/leaderboard")
    assert {(r.model, r.score) for r in back.collect()} == {("a", 0.5), ("b", None)} and spark.read.json(f"{tmp_path}/{run}/rows").count() == 3
    again = sources.write_run({"rows": spark.range(7)}, str(tmp_path), run)
    assert again == run and spark.read.json(f"{tmp_path}/{run}/rows").count() == 7


def test_run_history_grows(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for i in range(3):
        sources.append_run(spark.createDataFrame([(f"run{i}", i / 10)], "run string, score double"), folder)
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == [("run0", 0.0), ("run1", 0.1), ("run2", 0.2)]


def test_scored_csv(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("x")).repartition(4).write.option("header", True).csv(str(tmp_path / "in"))
    sources.score_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda df: df.withColumn("score", F.round(F.col("x") / 7, 3)))
    out = spark.read.options(header=True, inferSchema=True).csv(str(tmp_path / "out"))
    assert out.columns == ["id", "x", "score"] and out.count() == 1000 and out.where("abs(score - x / 7.0) > 0.001").count() == 0
    with pytest.raises(Exception, match="already exists"):
        sources.score_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda df: df)


def test_thin_classes_are_named_up_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(audit, "MOST_NAMED", 4)
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(30) for _ in range(1 if i % 2 else 20)] + [(None,)], "y string")
    row = audit.class_sufficiency(df, "y").first()
    assert (row.classes, row.least, row.thin_classes, row.status) == (30, 1, "c01,c03,c05,c07", "FAIL")
    assert audit.class_sufficiency(df.where("y = 'c00'"), "y").first().thin_classes == ""


def test_frequencies_and_offers(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert sorted(map(str, clean.freq_encode(df, "v").collect())) == ["Row(v='a', v_freq=0.5)"] * 2 + ["Row(v='b', v_freq=0.25)", "Row(v=None, v_freq=0.25)"]
    taken, planned = spark.createDataFrame([("u", "m1"), ("v", "x")], "user string, item string"), spark.createDataFrame([("u", "m2")], "user string, item string")
    needed = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m3",)], "item string")
    assert {tuple(r) for r in recommend.remaining_mandatory(taken, planned, needed).collect()} == {("u", "m3"), ("v", "m1"), ("v", "m2"), ("v", "m3")}


def test_too_many_mandatory_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(recommend, "MOST_BROADCAST", 2)
    taken = spark.createDataFrame([("u", "m1")], "user string, item string")
    with pytest.raises(ValueError, match="mandatory items"):
        recommend.remaining_mandatory(taken, taken, spark.createDataFrame([(f"m{i}",) for i in range(3)], "item string"))


@pytest.mark.parametrize("as_folder", [True, False])
def test_streams_of_a_folder_and_of_one_file(spark, tmp_path, as_folder):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    path = str(tmp_path / "t") if as_folder else str(next((tmp_path / "t").glob("part-*.parquet")))
    query = sources.read_stream(spark, path, "id long").writeStream.format("memory").queryName(f"seen_{as_folder}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table(f"seen_{as_folder}").count() == 10
