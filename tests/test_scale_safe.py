"""Quantiles, running sums, ranks and resampling that need no single task, against plain Python; rules in Korean."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt import sources
from basalt.functions import ordered
from basalt.operators import audit, clean, drift, models, profile, recommend, select, stats, synth


def test_exact_quantiles(spark, monkeypatch):
    rng = random.Random(3)
    columns = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [float(rng.randint(0, 3)) for _ in range(3000)], "c": [None if rng.random() < 0.3 else rng.random() for _ in range(3000)], "d": [None] * 3000}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), "a double, b double, c double, d double").repartition(5)
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for few in (200_000, 40):  # one bracket, and brackets that are narrowed
        monkeypatch.setattr(ordered, "FEW", few)
        monkeypatch.setattr(ordered, "ACCURACY", 100 if few == 40 else 10_000)
        got = ordered.exact_quantiles(df, list(columns), at)
        for name, values in columns.items():
            own = [v for v in values if v is not None]
            assert got[name] == (pytest.approx(list(np.quantile(own, at)), abs=1e-12) if own else None)
    assert ordered.exact_quantiles(df, [], at) == {}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_running_sums(spark, kind):
    rng = random.Random(5)
    values = sorted({rng.randint(-10**6, 10**6) for _ in range(900)}, key=str if kind == "string" else int)
    rows = [(str(v) if kind == "string" else v, rng.randint(0, 9)) for v in values]
    df = spark.createDataFrame([*rows, (None, 4)], f"v {kind}, n long").repartition(7)
    for down in (False, True):
        got = ordered.running_sums(df, "v", ["n"], descending=down).collect()
        order = [(None, 4), *rows]
        total = 0
        want = {}
        for v, n in reversed(order) if down else order:
            want[v] = total
            total += n
        assert {r.v: r.n_before for r in got} == want and {r.n_total for r in got} == {total}
    assert ordered.running_sums(df.limit(0), "v", ["n"]).count() == 0


def test_strata_and_ranks(spark):
    df = spark.range(5000).withColumns({"y": F.when(F.col("id") % 50 == 0, "rare").otherwise("common"), "risk": (F.col("id") * 37 % 101) / 100.0})
    parts = clean.stratified_split(df, "id", "y", 0.8).groupBy("y").agg(F.sum(F.col("is_train").cast("int")).alias("n")).collect()
    assert {r.y: r.n for r in parts} == {"rare": 80, "common": 3920}
    assert clean.kfold(df, "id", 5, "y").groupBy("y", "fold").count().agg(F.max("count") - F.min("count")).first()[0] > 0
    ranked = [r.risk_rank for r in drift.risk_rank(df, "risk", "id").orderBy(F.desc("risk"), "id").collect()]
    assert ranked == list(range(1, 5001))


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    values = rng.exponential(10, 4000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    got = stats.bootstrap_ci(df.repartition(3), "v", "id").first()
    assert got == stats.bootstrap_ci(df.repartition(7), "v", "id").first()  # the same for any partitioning
    error = values.std() / math.sqrt(len(values))
    assert got.mean == pytest.approx(values.mean(), abs=0.02) and got.std_error == pytest.approx(error, rel=0.1)
    means = [rng.choice(values, len(values)).mean() for _ in range(1000)]
    assert got.low == pytest.approx(np.quantile(means, 0.025), abs=0.25 * error + 0.01) and got.high == pytest.approx(np.quantile(means, 0.975), abs=0.25 * error + 0.01)


def test_top_values_leave_null_out(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,)], "c string")
    assert [(r.value, r.n, r.pct) for r in profile.top_values(df, ["c"]).collect()] == [("a", 2, 40.0)]


def test_personal_data(spark):
    df = spark.createDataFrame([("1234 5678 1234 5678",), ("1234567812345678",), ("91234567-1234567",), ("x@y.kr",)], "password string")
    assert profile.pii_by_name(df) == ["password"]
    assert {r.pattern: r.matches for r in profile.pii_scan(df, ["password"]).collect()} == {"CREDIT_CARD": 2, "EMAIL": 1}


def test_code_audits_agree(spark):
    df = spark.createDataFrame([(" A ",), ("B",), ("C",), (None,)], "code string")
    master = spark.createDataFrame([("A",), ("B ",)], "m string")
    assert {r.code: r.n for r in audit.code_mismatch_breakdown(df, "code", master, "m").collect()} == {"C": 1, None: 1}
    assert audit.code_integrity(df, "code", master, "m").first().examples == "C"


def test_digest_of_cells(spark):
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("a|b", "c"), ("a", "b|c")))
    assert sources.content_digest(a).first() != sources.content_digest(b).first()


def test_korean_table(spark):
    rows = [("기초파이썬", "전선", "3", None), ("자료구조", "전공필수", "3학점", "기초파이썬"), ("딥러닝비전", "전공선택", "3", "인공지능개론; 선형대수학"), ("총학점=130", "전필=18", "전선=36", None)]
    table = spark.createDataFrame(rows, "`과목명` string, `이수구분` string, `학점` string, `선수과목` string")
    rules, needs = recommend.curriculum_rules(table)
    by_course = {r.course: r for r in rules.collect()}
    assert by_course["자료구조"].type == "전필" and by_course["딥러닝비전"].type == "전선" and by_course["자료구조"].credits == 3
    assert {tuple(r) for r in needs.collect()} == {("자료구조", "기초파이썬"), ("딥러닝비전", "인공지능개론"), ("딥러닝비전", "선형대수학")}
    cells = recommend.requirement_cells(table.withColumns({"k": F.lit(1), "i": F.monotonically_increasing_id()}), "k", table.columns, "i").first()
    assert (cells.total, cells.mandatory, cells.elective) == (130, 18, 36)
    other = spark.createDataFrame([("웹", "전필", 3, "자바기초"), ("클라우드", "전선", 3, "웹, 운영체제")], "`교과목` string, `구분` string, `단위수` int, `선수교과목` string")
    assert {tuple(r) for r in recommend.curriculum_rules(other)[1].collect()} == {("웹", "자바기초"), ("클라우드", "웹"), ("클라우드", "운영체제")}


def test_korean_sentences(spark):
    text = """
    1. 선수과목 이수 규정:
    - 머신러닝 과목을 수강하려면 반드시 기초파이썬을 선수 이수하여야 한다.
    - 로봇비전제어의 선수과목: 선형대수학, ROS실습
    - 스프링부트 과목을 이수하기 위해 자바프로그래밍을 필수 이수해야 함.
    - 전공필수 과목: 자료구조, 알고리즘
    - 졸업을 위한 총이수학점: 130학점
    - 전공필수 18학점, 전공선택 36학점, 교양 30학점 이상
    """
    got = {(r.kind, r.subject, r.value) for r in recommend.text_rules(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()}
    assert {("prerequisite", "머신러닝", "기초파이썬"), ("prerequisite", "로봇비전제어", "선형대수학"), ("prerequisite", "로봇비전제어", "ROS실습"), ("prerequisite", "스프링부트", "자바프로그래밍")} <= got
    assert {("type", "자료구조", "전필"), ("type", "알고리즘", "전필"), ("credits", "총학점", "130"), ("credits", "전필", "18"), ("credits", "전선", "36"), ("credits", "교양", "30")} <= got


def test_shared_keys(spark):
    rng = random.Random(2)
    asks, holds = ([(rng.randint(0, 30), f"k{rng.randint(0, 9)}") for _ in range(60)] for _ in "ab")
    items = [(rng.randint(0, 30), f"i{rng.randint(0, 12)}") for _ in range(120)]
    got = recommend.shared_key_items(*(spark.createDataFrame(r, s) for r, s in ((asks, "user long, key string"), (holds, "id long, key string"), (items, "id long, item string"), (items, "user long, item string"))), k=2)
    want = {}
    for u in {u for u, _ in asks}:
        mine = {k for x, k in asks if x == u}
        pals = {i for i, k in holds if k in mine and i != u}
        count = {}
        for i, item in set(items):
            if i in pals and (u, item) not in items:
                count[item] = count.get(item, 0) + 1
        for place, (item, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:2], 1):
            want[u, place] = (item, n)
    assert {(r.user, r.place): (r.item, r.holders) for r in got.collect()} == want


def test_feature_sets_and_screening(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, *(rng.random() for _ in range(4))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, d double").withColumn("y", (F.col("a") * F.col("b") > 0.25).cast("int")).withColumn("ab", F.col("a") * F.col("b"))
    row = select.feature_ab(df, ["c", "d"], ["c", "d", "ab"], "y", "binary", 3, model="RandomForest", trees=5).first()
    assert row.engineered_mean > row.base_mean and row.folds_won == 3 and row.lift_pct > 0 and 0 <= row.p_value <= 1
    assert select.screen_features(df, ["a", "b", "c", "d", "ab"], "y", "binary", above=4, keep=2, trees=5).count("ab") == 1
    scout = select.scout(df, ["a", "b", "c", "d"], "y", "binary", 3, rounds=3, trees=5).collect()
    assert len(scout) == 4 and 0.5 < scout[0].score <= 1


def test_board_and_baseline(spark, tmp_path):
    board = spark.createDataFrame([("GradientBoosting", 0.9, False, 1), ("Ridge", 0.8, False, 2), ("GlobalStat", 0.5, True, 3)], "model string, score double, is_baseline boolean, rank int")
    assert {r.model: r.role for r in models.leaderboard_labels(board, "GradientBoosting").collect()} == {"GradientBoosting": "champion", "Ridge": "runner-up", "GlobalStat": "baseline: overall statistic"}
    assert models.legacy_comparison(board, "GradientBoosting").first().legacy == "GlobalStat"
    assert models.legacy_comparison(board, "GradientBoosting", "ridge").first().lift_pct == 12.5
    df = spark.range(100).withColumns({"x": F.col("id") * 1.0, "c": F.col("id") % 3})
    edges = drift.numeric_edges(df, ["x"])
    drift.save_baseline(edges, drift.numeric_bins(df, ["x"], edges), drift.category_counts(df, ["c"]), f"{tmp_path}/base")
    e, n, c = drift.load_baseline(spark, f"{tmp_path}/base")
    assert drift.psi(n, drift.numeric_bins(df, ["x"], e)).first().psi == 0 and c.count() == 3
    audited = synth.synthesis_audit(df, ["x"], ["c"], ["x_dev_from_c_avg"])
    assert [(r.feature, r.selected) for r in audited.collect()] == [("x_dev_from_c_avg", True)]


def test_listing_and_views(spark, tmp_path):
    spark.range(3).write.csv(f"{tmp_path}/t.csv")
    spark.range(3).createOrReplaceTempView("kept_view")
    assert [r.table_name for r in sources.list_tables(spark, str(tmp_path)).collect()] == ["t"]
    got = sources.query_over_files(spark, {"kept_view": spark.range(9)}, "select count(*) as n from kept_view")
    assert got.first().n == 9 and spark.table("kept_view").count() == 3
    spark.catalog.dropTempView("kept_view")


def test_manifest_and_clearing(spark, tmp_path):
    made = sources.freeze({"train": spark.range(8), "test": spark.range(2)}, f"{tmp_path}/frozen", seed=7, features=["id"]).collect()
    assert {r.split: (r.n_rows, r.ratio, r.seed, r.features) for r in made} == {"train": (8, 0.8, 7, ["id"]), "test": (2, 0.2, 7, ["id"])}
    assert all(r.intact for r in sources.verify_frozen(spark, f"{tmp_path}/frozen").collect())
    store = sources.FeatureStore(spark, f"{tmp_path}/store")
    assert not store.get("t", spark.range(3), lambda df: df)[1] and store.get("t", spark.range(3), lambda df: df)[1]
    assert store.clear(3600) == [] and len(store.clear()) == 1 and not store.get("t", spark.range(3), lambda df: df)[1]
