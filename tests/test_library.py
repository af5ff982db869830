"""Hand-computed fixtures and invariants of the library's own operators."""

import math

import pytest
from pyspark.sql import functions as F

from basalt import sources
from basalt.operators import audit, clean, drift, models, profile, recommend, select, stats, synth
from basalt.plans import flagship, oracle_sql, queries
from basalt.streaming import drift_stream

SMALL = "/root/testdata/sf0.001"


def test_missing_tiers(spark):
    df = spark.createDataFrame([(v, "a") for v in [1.0, 2.0, None, 4.0, 5.0] * 20], "num_low double, cat string")
    fitted = clean.Imputer.fit(df, ["num_low", "cat"])
    assert fitted.tier("num_low") == "medium" and fitted.fills["num_low"] == 3.0
    assert fitted.transform(df).agg(F.sum("num_low_is_missing")).first()[0] == 20


def test_class_weights(spark):
    df = spark.range(100).select((F.col("id") < 25).cast("int").alias("y"))
    rows = {r.label: r for r in profile.class_balance(df, "y").collect()}
    assert (rows["0"].weight, rows["1"].weight, rows["1"].minority_pct, rows["1"].severity) == (0.6667, 2.0, 25.0, "MODERATE_IMBALANCE")


def test_audit_verdict(spark):
    df = spark.range(100).select(F.when(F.col("id") < 40, "UNKNOWN_999").otherwise("DS01").alias("code"), (F.col("id") % 2).alias("y"))
    master = spark.createDataFrame([("DS01",), ("BE02",)], "code string")
    row = audit.code_integrity(df, "code", master, "code").first()
    assert (row.mismatch, row.mismatch_rate, row.examples) == (40, 0.4, "UNKNOWN_999")
    assert audit.feasibility(df, "y", "code", master, "code").first().verdict == "NO_GO"
    assert audit.feasibility(df, "nothing").first().verdict == "NO_GO"
    assert audit.preset_catalog(spark).count() == 11 and audit.preset_catalog(spark, "generic").count() == 2


def test_health_score(spark):
    view = spark.createDataFrame([(5.0, 1.0)], "missing_pct double, duplicate_pct double")
    assert profile.health_score(view, 2).first()[0] == 76.0


def test_model_gate(spark):
    runs = spark.createDataFrame([("binary", 0.9, 20.0, 20.0, 0.01, 5.0), ("binary", 0.5, 20.0, 20.0, 0.01, 5.0), ("binary", 0.9, 1.0, 2.0, 0.01, 5.0)], "task string, score double, lift_global double, lift_segment double, overfit_gap double, sparsity double")
    assert [r.verdict for r in audit.model_gate(runs).collect()] == ["GO", "NO_GO_PIVOT", "CONDITIONAL_GO"]


def test_hybrid_score(spark):
    one = lambda v: spark.createDataFrame([(1, "ds", v)], "user long, item string, value double")
    row = recommend.hybrid_score({"ml": one(0.85), "tree": one(0.9), "persona": one(0.75), "popularity": one(0.8)}).first()
    assert row.score == pytest.approx(0.8375)
    assert [round(row[f"{n}_pct"], 1) for n in recommend.WEIGHTS] == [35.5, 32.2, 17.9, 14.3]


def test_pathway_profile(spark):
    rows = [("DS", e, i) for e, items in enumerate([["Python", "Databases"], ["Python", "Machine Learning", "Databases"], ["Python", "Machine Learning"]]) for i in items]
    got = {r.item: (r.n, round(100 * r.coverage, 1)) for r in recommend.pathway_profile(spark.createDataFrame(rows, "target string, entity int, item string")).collect()}
    assert got == {"Python": (3, 100.0), "Machine Learning": (2, 66.7), "Databases": (2, 66.7)}


def test_cost_threshold(spark):
    df = spark.createDataFrame([(1, 0.35)] * 5 + [(0, 0.245)] * 95, "y int, s double")
    row = stats.cost_threshold(df, "y", "s", 10.0).first()
    assert (row.cost, row.fn, row.fp, row.threshold) == (0.0, 0, 0, 0.25)


def test_no_drift(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("x"))
    edges = drift.numeric_edges(df, ["x"])
    bins = drift.numeric_bins(df, ["x"], edges)
    assert drift.psi(bins, bins).first().psi == 0.0


def test_p_values():
    assert stats.t_p(2.0, 10) == pytest.approx(0.0734, abs=1e-4) and stats.t_p(0.5, 30) == pytest.approx(0.6207, abs=1e-4)
    assert stats.normal_p(1.6449) == pytest.approx(0.05, abs=1e-4) and stats.significance(0.02) == "*"
    assert clean.ks_p_value(0.5, 100, 100) < 1e-6 < clean.ks_p_value(0.05, 100, 100)


def test_elbow(spark):
    curve = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.85), (4, 0.9), (5, 0.9)], "k int, score double")
    assert [r.k for r in select.elbow(curve).where("is_elbow").collect()] == [4]


def test_selection_rules(spark):
    ranks = spark.createDataFrame([("a", 0.5, 1), ("a2", 0.3, 2), ("b", 0.19, 3), ("z", 0.001, 4)], "feature string, importance double, rank int")
    pairs = spark.createDataFrame([("a", "a2", 0.95)], "column_a string, column_b string, r double")
    got = {r.feature: (r.status, r.reason) for r in select.select_features(ranks, pairs).collect()}
    assert got["a2"] == ("pruned", "redundant with a") and got["b"][0] == "selected" and got["z"] == ("selected", "rescued")
    assert select.reduction_summary(select.select_features(ranks, pairs)).first().after == 3


def test_attribution_adds_up(spark):
    rows = queries()["attribution"](spark, SMALL).groupBy("c_custkey").agg(F.sum("contribution").alias("s"), F.max("prediction").alias("p"), F.max("base").alias("b")).collect()
    assert rows and all(math.isclose(r.s, r.p - r.b, abs_tol=1e-6) for r in rows)


def test_leaderboard(spark):
    rows = queries()["leaderboard"](spark, SMALL).orderBy("rank").collect()
    scores = [r.score for r in rows if r.score is not None]
    assert scores == sorted(scores, reverse=True) and {"GlobalStat", "OneSplit"} < {r.model for r in rows} and not [r.error for r in rows if r.error]


def test_group_split_and_folds(spark):
    df = spark.range(2000).select("id", (F.col("id") % 20).alias("g"), (F.col("id") % 3).alias("y"))
    sides = clean.hash_split(df, "g").groupBy("g").agg(F.countDistinct("is_train").alias("n"))
    assert sides.where("n > 1").count() == 0
    sizes = clean.kfold(df, "id", 3, "y").groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.where("d > 1").count() == 0


def test_partitioning_does_not_matter(spark):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    for run in (lambda x: stats.wilcoxon(x, "l_quantity", "l_discount"), lambda x: sources.content_digest(x.select("l_orderkey", "l_returnflag")), lambda x: profile.top_values(x, ["l_returnflag"])):
        assert sorted(run(df.repartition(1)).collect()) == sorted(run(df.repartition(7)).collect())


def test_read_only_gate():
    assert sources.check_read_only("select 'drop' as x -- delete\n from t /* update\n */")
    for bad in ("drop table x", "select 1; DELETE from t", "insert into t values (1)"):
        with pytest.raises(PermissionError):
            sources.check_read_only(bad)
    assert [sources.detect_kind(u) for u in ("a.parquet", "x/b.csv", "c.jsonl", "jdbc:derby:x", "t")] == ["parquet", "csv", "json", "jdbc", "table"]


def test_csv_encodings_and_frozen_splits(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("번호,지역\n1,서울\n2,부산\n".encode("cp949"))
    df = sources.read_source(spark, str(tmp_path / "k.csv"))
    assert df.columns == ["번호", "지역"] and {r[1] for r in df.collect()} == {"서울", "부산"}
    out = str(tmp_path / "frozen")
    manifest = sources.freeze({"train": spark.range(8), "test": spark.range(2)}, out)
    assert {r.split: r.n_rows for r in manifest.collect()} == {"train": 8, "test": 2}
    assert all(r.intact for r in sources.verify_frozen(spark, out).collect())
    spark.range(3).write.mode("append").parquet(f"{out}/test")
    assert {r.split: r.intact for r in sources.verify_frozen(spark, out).collect()} == {"train": True, "test": False}


def test_feature_store(spark, tmp_path):
    store, calls = sources.FeatureStore(spark, str(tmp_path / "store")), []
    make = lambda df: calls.append(1) or df.withColumn("twice", 2 * F.col("id"))
    hits = [store.get("t", spark.range(5), make)[1] for _ in range(2)]
    assert hits == [False, True] and len(calls) == 1 and store.stats().first().files > 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    edges = drift.numeric_edges(events, ["value"])
    base = drift.numeric_bins(events, ["value"], edges)
    late = events.select((F.col("ts") + F.expr("interval 4000 days")).alias("ts"), "value").limit(1)
    events.select("ts", "value").write.parquet(str(tmp_path / "in"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    drift_stream(stream, "ts", ["value"], edges, base, out).awaitTermination(120)
    got = {r.start[:10]: r.psi for r in spark.read.parquet(out).collect()}
    for start, psi in list(got.items())[:2]:
        own = events.where(F.window("ts", "7 days").isNotNull()).withColumn("w", F.date_format(F.window("ts", "7 days")["start"], "yyyy-MM-dd")).where(F.col("w") == start)
        assert drift.psi(base, drift.numeric_bins(own, ["value"], edges)).first().psi == psi
    assert got


def test_rule_parsing(spark):
    table = spark.createDataFrame([("AI", "Core", "3 credits", "Math; Stats"), ("Art", "optional", "2", "none")], "Course_Name string, Category string, Units string, Prereq string")
    rules, needs = recommend.curriculum_rules(table)
    assert {tuple(r) for r in rules.collect()} == {("AI", "mandatory", 3), ("Art", "elective", 2)}
    assert {tuple(r) for r in needs.collect()} == {("AI", "Math"), ("AI", "Stats")}
    docs = spark.createDataFrame([(1, "AI requires Math.\nArt is an elective course\nTotal credits: 120\nnothing")], "id long, text string")
    assert [(r.kind, r.subject, r.value) for r in recommend.text_rules(docs, "id", "text").orderBy("line_no").collect()] == [("prerequisite", "AI", "Math"), ("type", "Art", "elective"), ("credits", "Total", "120")]
    assert recommend.requirement_cells(spark.createDataFrame([(1, "total 120\nmandatory 60\ntotal 130")], "id long, c string"), "id", ["c"]).first().total == 130
    js = spark.createDataFrame([(1, '{"AI": ["Math", "Stats"], "Art": "Drawing, Color"}')], "id long, j string")
    assert recommend.json_rules(js, "id", "j").count() == 4


def test_profile_document(spark):
    df = spark.createDataFrame([("Computer Science", ["Deep Learning", "SQL"])], "major string, items array<string>")
    assert df.select(recommend.profile_document(df, "major", "items")).first()[0] == "major_Computer_Science Deep_Learning SQL"


def test_pipeline_on_new_rows(spark):
    df = spark.read.parquet(f"{SMALL}/customer.parquet").withColumn("y", F.col("c_custkey") % 2)
    fitted = clean.FeaturePipeline.fit(df.where("c_custkey % 3 <> 0"), "y", key="c_custkey", pii=["c_name"])
    out = fitted.transform(df.where("c_custkey % 3 = 0"))
    assert "c_name" not in out.columns and "c_mktsegment" not in out.columns and fitted.lineage_log(spark).count() > 0
    assert out.columns == fitted.transform(df.limit(1)).columns


def test_synthesis_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0)], "a double, b double")
    assert [round(r.a_per_b, 3) for r in synth.ratio_features(df, ["a", "b"]).collect()] == [0.0, 0.5]


def test_entry(spark):
    assert flagship(spark, SMALL).count() > 5
    assert set(oracle_sql()) <= set(queries())


def test_predictions(spark):
    rows = queries()["batch_prediction"](spark, SMALL).collect()
    assert len(rows) == 150 and all(0 <= r.probability <= 1 for r in rows)
    assert models.champion(spark.createDataFrame([("GlobalStat", True, 0.9, 1), ("Ridge", False, 0.8, 2)], "model string, is_baseline boolean, score double, rank int")) == "Ridge"
