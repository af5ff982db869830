"""Queries of rule parsing, gates, reports and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import audit, clean, mart, models, profile, recommend, select, stats, synth
from .profiling import union
from .recommending import WITH, items
from .registry import query, read

# Sentences of four kinds, made from the parts table: the SQL states the rules that they hold.
_PART = "select p_partkey, 'B' || substr(p_brand, 7) as b, split_part(p_name, ' ', 1) as x, split_part(p_name, ' ', 2) as y, p_size from part"


def handbook(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.concat(F.lit("B"), F.substring("p_brand", 7, 9)).alias("b"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("x"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("y"), "p_size")
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("- "), "b", F.lit("의 선수과목: "), "x", F.lit(", "), "y")).when(kind == 1, F.concat("b", F.lit(" 과목을 수강하려면 반드시 "), "x", F.lit("을 선수 이수하여야 한다.")))
    line = line.when(kind == 2, F.concat(F.lit("2. 전공필수 과목: "), "x", F.lit(", "), "y")).otherwise(F.concat(F.lit("졸업 총이수학점: "), F.col("p_size").cast("string"), F.lit("학점, 전공선택 "), (F.col("p_size") + 1).cast("string"), F.lit("학점")))
    return part.select("p_partkey", F.concat(F.lit("규정\n"), line).alias("text"))


@query(
    f"with p as ({_PART}) select p_partkey, 1 as line_no, kind, subject, value from ("
    "select p_partkey, 'prerequisite' as kind, b as subject, x as value from p where p_partkey % 4 in (0, 1) union all select p_partkey, 'prerequisite', b, y from p where p_partkey % 4 = 0 "
    "union all select p_partkey, 'type', x, '전필' from p where p_partkey % 4 = 2 union all select p_partkey, 'type', y, '전필' from p where p_partkey % 4 = 2 "
    "union all select p_partkey, 'credits', '총학점', p_size::varchar from p where p_partkey % 4 = 3 union all select p_partkey, 'credits', '전선', (p_size + 1)::varchar from p where p_partkey % 4 = 3)"
)
def text_rules(spark, d):
    return recommend.text_rules(handbook(spark, d), "p_partkey", "text")


def curriculum(spark, d):
    kind = F.col("p_partkey") % 3
    return read(spark, d, "part").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("과목명"), F.when(kind == 0, "전공필수").when(kind == 1, "교양선택").otherwise("특별").alias("이수구분"),
        F.concat((F.col("p_size") % 4).cast("string"), F.when(kind == 0, "학점").otherwise("")).alias("학점"), F.when(kind == 0, F.concat_ws("; ", "p_brand", "p_type")).when(kind == 1, "없음").alias("선수과목"),
    )


@query("select p_name || ' ' || p_partkey::varchar as course, case p_partkey % 3 when 0 then '전필' when 1 then '교선' else '특별' end as type, (p_size % 4)::int as credits from part")
def curriculum_courses(spark, d):
    return recommend.curriculum_rules(curriculum(spark, d))[0]


@query("with c as (select p_name || ' ' || p_partkey::varchar as item, p_brand, p_type from part where p_partkey % 3 = 0) select item, p_brand as needs from c union all select item, p_type from c")
def curriculum_needs(spark, d):
    return recommend.curriculum_rules(curriculum(spark, d))[1]


@query("with t as (select p_brand, p_partkey, p_size, p_partkey % 2 as odd from part) select p_brand, max_by(p_size, p_partkey) filter (where odd = 0)::int as total, max_by(p_size, p_partkey) filter (where odd = 1)::int as mandatory, max_by(p_size + 1, p_partkey) filter (where odd = 1)::int as elective, null::int as general, null::int as semester from t group by 1")
def requirement_cells(spark, d):
    size = F.col("p_size").cast("string")
    cells = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("총학점="), size)).otherwise(F.concat(F.lit("전필="), size, F.lit(",전선="), (F.col("p_size") + 1).cast("string")))
    return recommend.requirement_cells(read(spark, d, "part").select("p_brand", "p_partkey", cells.alias("cell")), "p_brand", ["cell"], "p_partkey")


@query("select event_id, 'k' as item, json_extract_string(props, '$.k') as needs from events where json_extract_string(props, '$.k') is not null")
def json_rules(spark, d):
    return recommend.json_rules(read(spark, d, "events").select("event_id", "props"), "event_id", "props")


@query("select doc_id, 'major_' || lang || ' ' || source || ' chars_' || n_chars::varchar as document from documents")
def profile_document(spark, d):
    df = read(spark, d, "documents").withColumn("own", F.array("source", F.concat_ws(" ", F.lit("chars"), "n_chars")))
    return df.select("doc_id", recommend.profile_document(df, "lang", "own").alias("document"))


@query("with y as (select year(o_orderdate) as yr from orders) select count(*) as n_rows, count(*) filter (where yr < 1996) as removed, round(100::double * count(*) filter (where yr < 1996) / count(*), 2) as removed_pct from y")
def recency_report(spark, d):
    return recommend.recency_report(read(spark, d, "orders").select(F.year("o_orderdate").alias("yr")), "yr", 1997, 1)


@query(WITH + """, u as (select distinct "user" from i where yr % 2 = 0 union select distinct "user" from i where yr % 2 = 1), m as (select distinct item from i where substr(item, 7)::int % 2 = 0) select "user", item from u, m where ("user", item) not in (select "user", item from i)""")
def remaining_mandatory(spark, d):
    own = items(spark, d)
    mandatory = own.where(F.substring("item", 7, 9).cast("int") % 2 == 0).select("item")
    return recommend.remaining_mandatory(own.where("yr % 2 = 0"), own.where("yr % 2 = 1"), mandatory)


@query("with h as (select distinct o_custkey as u, l_partkey as item from lineitem join orders on l_orderkey = o_orderkey), p as (select c_custkey as u, c_custkey + 1 as id from customer) select p.u as \"user\", p.id as id, list(a.item order by a.item) as shared from p join h a on a.u = p.u join h b on b.u = p.id and b.item = a.item group by 1, 2")
def shared_items(spark, d):
    held = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
    pairs = read(spark, d, "customer").select(F.col("c_custkey").alias("user"), (F.col("c_custkey") + 1).alias("id"))
    return recommend.shared_items(pairs, held.withColumnRenamed("user", "id"), held)


# -- runs of models, made from the orders of each clerk-like group: what is checked are the rules over them --

# Means are quotients of whole numbers (prices in cents), rounded half up to four digits in whole numbers too, so they don't depend on the order of the rows.
_MEANS = {"score": (1000, 1000), "lift_global": (17, 1), "lift_segment": (13, 1), "overfit_gap": (31, 100), "sparsity": (71, 1)}  # modulus and divisor
_RUNS = "select run, task, " + ", ".join(f"((20000 * {n} + 100 * {by} * c) // (200 * {by} * c)) / 10000::double as {n}" for n, (_, by) in _MEANS.items()) + " from (select o_custkey % 50 as run, case when o_custkey % 2 = 0 then 'regression' else 'binary' end as task, count(*) as c, " + ", ".join(f"sum(round(100 * o_totalprice)::bigint % {100 * m})::bigint as {n}" for n, (m, _) in _MEANS.items()) + " from orders group by 1, 2)"


def runs(spark, d):
    cents = F.round(100 * F.col("o_totalprice")).cast("long")
    df = read(spark, d, "orders").withColumns({"run": F.col("o_custkey") % 50, "task": F.when(F.col("o_custkey") % 2 == 0, "regression").otherwise("binary")})
    summed = df.groupBy("run", "task").agg(F.count("*").alias("c"), *[F.sum(cents % (100 * m)).alias(n) for n, (m, _) in _MEANS.items()])
    return summed.select("run", "task", *[(F.expr(f"(20000 * {n} + {100 * by} * c) div ({200 * by} * c)") / 10000.0).alias(n) for n, (_, by) in _MEANS.items()])


_TRIGGERS = "list_filter([case when lift_global < 5 and lift_segment < 5 then 'MARGINAL_LIFT' end, case when overfit_gap > 0.15 then 'HIGH_OVERFITTING' end, case when score < case when task = 'regression' then 0.10 else 0.58 end then 'SIGNAL_DEFICIENCY' end, case when sparsity > 35 then 'HIGH_SPARSITY' end], lambda t: t is not null)"


@query(f"select run, t as triggers, case when list_contains(t, 'SIGNAL_DEFICIENCY') or len(t) >= 2 then 'NO_GO_PIVOT' when len(t) > 0 then 'CONDITIONAL_GO' else 'GO' end as verdict from (select run, {_TRIGGERS} as t from ({_RUNS}))")
def model_gate(spark, d):
    return audit.model_gate(runs(spark, d)).select("run", "triggers", "verdict")


@query(f"with r as (select abs(corr(lift_global, score)) as a, abs(corr(overfit_gap, score)) as b, abs(corr(sparsity, score)) as c from ({_RUNS})) " + union(f"select '{n}' as param, round({c} / (a + b + c), 6) as share from r" for n, c in (("lift_global", "a"), ("overfit_gap", "b"), ("sparsity", "c"))))
def parameter_sensitivity(spark, d):
    return select.parameter_sensitivity(runs(spark, d), ["lift_global", "overfit_gap", "sparsity"], "score").withColumn("share", F.round("share", 6))


_NAMES = "['GlobalStat', 'OneSplit', 'Ridge', 'RandomForest', 'GradientBoosting', 'NeuralNet']"
#: The mean of four-digit scores, in whole numbers.
_MEAN = "((2 * sum(round(10000 * score)::bigint) + count(*)) // (2 * count(*)))::bigint / 10000::double"
_BOARD = f"select * from (select ({_NAMES})[(run % 6 + 1)::int] as model, {_MEAN} as score, run % 6 < 2 as is_baseline, row_number() over (order by {_MEAN} desc, ({_NAMES})[(run % 6 + 1)::int])::int as rank from ({_RUNS}) group by run % 6)"


def board(spark, d):
    from pyspark.sql import Window

    names = F.array(*map(F.lit, ("GlobalStat", "OneSplit", "Ridge", "RandomForest", "GradientBoosting", "NeuralNet")))
    summed = runs(spark, d).groupBy((F.col("run") % 6).cast("int").alias("i")).agg(F.sum(F.round(10000 * F.col("score")).cast("long")).alias("s"), F.count("*").alias("c"))
    rows = summed.select("i", (F.expr("(2 * s + c) div (2 * c)") / 10000.0).alias("score")).select(names[F.col("i")].alias("model"), "score", (F.col("i") < 2).alias("is_baseline"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "model")))  # a row for each model


@query(f"with b as ({_BOARD}) select model, rank, case when model = 'RandomForest' then 'champion' when model = 'GlobalStat' then 'baseline: overall statistic' when model = 'OneSplit' then 'baseline: segment rule' when rank <= 2 then 'runner-up' else 'alternative' end as role, case model when 'GlobalStat' then 'heuristic baseline' when 'OneSplit' then 'heuristic baseline' when 'Ridge' then 'linear' when 'RandomForest' then 'bagged trees' when 'GradientBoosting' then 'boosted trees' else 'neural network' end as family, case model when 'GlobalStat' then 'minimal' when 'OneSplit' then 'low' when 'Ridge' then 'low' when 'NeuralNet' then 'high' else 'medium' end as complexity from b")
def leaderboard_labels(spark, d):
    return models.leaderboard_labels(board(spark, d), "RandomForest").select("model", "rank", "role", "family", "complexity")


@query(f"with b as ({_BOARD}), o as (select * from b where model = 'Ridge'), n as (select * from b where model = 'RandomForest') select o.model as legacy, n.model as champion, round(o.score, 4) as legacy_score, round(n.score, 4) as champion_score, round(100 * (n.score - o.score) / greatest(abs(o.score), 1e-6), 2) as lift_pct from o, n")
def legacy_comparison(spark, d):
    return models.legacy_comparison(board(spark, d), "RandomForest", "ridge")


@query(f"with b as ({_BOARD}), c as (select rank as k, score, max(score) over () as best, score - lag(score) over (order by rank) as gain from b), e as (select min(k) as first from c where k >= 3 and (score / best >= 0.97 or coalesce(gain, 1) < 0.015)) select k, score, round(score / best, 6) as retention, round(gain, 6) as gain, k = coalesce(first, 6) as is_elbow from c, e")
def elbow(spark, d):
    return select.elbow(board(spark, d).select(F.col("rank").alias("k"), "score")).select("k", "score", F.round("retention", 6).alias("retention"), F.round("gain", 6).alias("gain"), "is_elbow")


# -- features -------------------------------------------------------------------------

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("select * from (" + union(f"select '{c}' as column_name, count(distinct {c}) as distinct_values, round(avg({c}), 4) as mean from lineitem" for c in _NUM) + ") where column_name in ('l_quantity', 'l_discount', 'l_tax')")
def candidate_columns(spark, d):
    df = read(spark, d, "lineitem")
    chosen = synth.candidate_columns(df.select("l_orderkey", *_NUM), ["quantity", "discount", "tax"], ["l_orderkey"])
    agg = df.agg(*[F.countDistinct(c).alias(f"{c}__d") for c in chosen], *[F.avg(c).alias(f"{c}__m") for c in chosen])
    return profile.stack(agg, [{"column_name": F.lit(c), "distinct_values": F.col(f"{c}__d"), "mean": F.round(F.col(f"{c}__m"), 4)} for c in chosen])


_SKEW = "(select avg(power({c} - m, 3)) / power(var_pop({c}), 1.5) from {t}, (select avg({c}) as m from {t}))"
_WIDE = "(select *, power(l_quantity, 6) as wide, l_suppkey % 3 as tri, l_suppkey % 40 as forty from lineitem)"


_AUDITED = {"wide": "power(l_quantity, 6)", "l_tax": "l_tax"}
_GROUPED = {"tri": "l_suppkey % 3", "forty": "l_suppkey % 40", "flag": "l_returnflag"}


@query(
    "with t as (select " + ", ".join(f"{e} as {c}" for c, e in (_AUDITED | _GROUPED).items()) + " from lineitem) "
    + union(f"select 'log1p_{c}' as feature, 'log transform' as type, 'log1p({c})' as formula, '{c}' = 'wide' as selected from (select min({c}) as low, abs({_SKEW.format(c=c, t='t')}) as skew from t) where low >= 0 and skew > 1.2" for c in _AUDITED)
    + " union all select 'wide_per_l_tax', 'ratio', 'wide / l_tax', false union all "
    + union(f"select '{c}_dev_from_{g}_avg', 'group deviation', '{c} - mean({c} by {g})', '{c}' = 'wide' and '{g}' = 'tri' where (select count(distinct {g}) from t) between 2 and 15" for g in _GROUPED for c in _AUDITED)
)
def synthesis_audit(spark, d):
    df = read(spark, d, "lineitem").withColumns({"wide": F.pow("l_quantity", F.lit(6.0)), "tri": F.col("l_suppkey") % 3, "forty": F.col("l_suppkey") % 40, "flag": F.col("l_returnflag")})
    return synth.synthesis_audit(df, ["wide", "l_tax"], ["tri", "forty", "flag"], ["log1p_wide", "wide_dev_from_tri_avg"], 1.2)


def _summary():
    return union(f"select '{c}' as feature, count(distinct {c}) as distinct_values, min({c})::double as min_value, {_SKEW.format(c=c, t=_WIDE)} as skew, {w}::double as importance from {_WIDE}" for c, w in (("l_quantity", 0.4), ("l_extendedprice", 0.3), ("wide", 0.15), ("l_discount", 0.1), ("l_tax", 0.05)))


@query(f"with s as ({_summary()}), r as (select *, row_number() over (order by importance desc, feature) as place, row_number() over (order by importance, feature) as back from s), t as (select * from r where distinct_values > 10 and place <= 3) select 'ratio' as kind, a.feature || '/' || b.feature as feature from t a join t b on a.place < b.place union all select 'log1p', feature from r where min_value >= 0 and abs(skew) > 1.2 union all select 'prune', feature from r where back <= 2")
def recommend_features(spark, d):
    df = read(spark, d, "lineitem").withColumn("wide", F.pow("l_quantity", F.lit(6.0)))
    weights = {"l_quantity": 0.4, "l_extendedprice": 0.3, "wide": 0.15, "l_discount": 0.1, "l_tax": 0.05}
    agg = df.agg(*[f(c).alias(f"{c}__{n}") for c in weights for n, f in (("d", F.countDistinct), ("m", F.min), ("s", F.skewness))])
    summary = profile.stack(agg, [{"feature": F.lit(c), "distinct_values": F.col(f"{c}__d"), "min_value": F.col(f"{c}__m").cast("double"), "skew": F.col(f"{c}__s")} for c in weights])
    return select.recommend_features(summary, spark.createDataFrame(list(weights.items()), "feature string, importance double"), 3, 2)


def _corr(a, b):
    return f"select '{a}' as feature, abs(corr({a}, {b})) as importance from lineitem"


_RANKED = "select feature, round(importance, 9) as importance, row_number() over (order by importance desc, feature)::int as rank from (" + union((_corr("l_quantity", "l_extendedprice"), _corr("l_discount", "l_extendedprice"), _corr("l_tax", "l_extendedprice"), _corr("l_suppkey", "l_extendedprice"), _corr("l_partkey", "l_extendedprice"))) + ")"


def ranked(spark, d):
    from pyspark.sql import Window

    names = ["l_quantity", "l_discount", "l_tax", "l_suppkey", "l_partkey"]
    agg = read(spark, d, "lineitem").agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in names])
    rows = profile.stack(agg, [{"feature": F.lit(c), "importance": F.col(c)} for c in names])
    return rows.select("feature", F.round("importance", 9).alias("importance"), F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"))  # a row for each feature


def selection(spark, d):
    twins = spark.createDataFrame([("l_suppkey", "l_partkey", 0.9)], "column_a string, column_b string, r double")
    return select.select_features(ranked(spark, d), twins, cap=3, coverage=2.0, least_share=0.0)


@query(f"with r as ({_RANKED}), t as (select *, case when feature in ('l_suppkey', 'l_partkey') and rank = max(rank) filter (where feature in ('l_suppkey', 'l_partkey')) over () then 'twin' else 'own' end as kind from r), p as (select *, row_number() over (partition by kind order by rank) as place from t) select feature, rank, case when kind = 'own' and place <= 3 then 'selected' else 'pruned' end as status from p")
def select_features(spark, d):
    return selection(spark, d).select("feature", "rank", "status")


@query(f"with r as ({_RANKED}), s as (select importance / sum(importance) over () >= 0.05 as strong from r) select count(*) as before, greatest(3, count(*) filter (where strong)) as after, round(100 * (count(*) - greatest(3, count(*) filter (where strong))) / count(*)::double, 4) as reduced_pct from s")
def reduction_summary(spark, d):
    """What is left of the features when weak ones go, but for three at least."""
    none = spark.createDataFrame([], "column_a string, column_b string, r double")
    return select.reduction_summary(select.select_features(ranked(spark, d), none, coverage=2.0, least_share=0.05))


_MI_EDGES = ", ".join(str(i / 10) for i in range(1, 10))


def _mi(c):
    return f"select '{c}' as column_name, l_returnflag as y, len(list_filter((select quantile_cont({c}, [{_MI_EDGES}]) from lineitem), lambda e: e < {c})) as b from lineitem"


@query("with x as (" + union(_mi(c) for c in _NUM) + "), n as (select column_name, b, y, count(*) as n from x group by all), p as (select *, sum(n) over (partition by column_name) as t, sum(n) over (partition by column_name, b) as nb, sum(n) over (partition by column_name, y) as ny from n), m as (select column_name, round(sum(n / t::double * ln(n * t / (nb * ny)::double)), 4) as mi from p group by 1) select * from m order by mi desc, column_name limit 2")
def mi_gate(spark, d):
    return synth.mi_gate(synth.mi_scores(read(spark, d, "lineitem"), list(_NUM), "l_returnflag"), 2)


# -- grades, bands and samples ----------------------------------------------------------


@query(union(f"select '{c}' as column_name, case when abs(s) <= 0.5 then 'symmetric' when abs(s) <= 1.5 then 'mildly skewed' else 'strongly skewed' end as grade from (select {_SKEW.format(c=c, t=_WIDE)} as s)" for c in ("l_quantity", "l_extendedprice", "wide")))
def skew_grades(spark, d):
    df = read(spark, d, "lineitem").withColumn("wide", F.pow("l_quantity", F.lit(6.0)))
    return profile.skewness(df, ["l_quantity", "l_extendedprice", "wide"]).select("column_name", profile.skew_grade(F.col("skew")).alias("grade"))


@query(f"select run, case when overfit_gap <= 0.05 then 'best' when overfit_gap <= 0.12 then 'adequate' else 'overfitted' end as overfit, case when score >= 0.05 then 'preserved' when score >= 0.01 then 'slightly shifted' else 'distorted' end as ks from ({_RUNS})")
def run_grades(spark, d):
    return runs(spark, d).select("run", profile.overfit_grade(F.col("overfit_gap")).alias("overfit"), profile.ks_grade(F.col("score")).alias("ks"))


@query("with q as (select quantile_cont(c_acctbal, 0.33) as a, quantile_cont(c_acctbal, 0.66) as b from customer) select case when c_acctbal <= a then 'low' when c_acctbal <= b then 'middle' else 'high' end as slice, count(*) as n from customer, q group by 1")
def slice_bands(spark, d):
    df = read(spark, d, "customer")
    return df.groupBy(stats.slice_bands(df, "c_acctbal").alias("slice")).agg(F.count("*").alias("n"))


@query("with t as (select c_mktsegment from customer group by 1 order by count(*) desc, 1 limit 3) select case when c_mktsegment in (from t) then c_mktsegment end as slice, count(*) as n from customer group by 1")
def slice_categories(spark, d):
    df = read(spark, d, "customer")
    return df.groupBy(stats.slice_bands(df, "c_mktsegment").alias("slice")).agg(F.count("*").alias("n"))


_S = "(select doc_id, toxic as y, round(0.6::double * (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100) / 100::double + 0.3::double * toxic, 4) as s from labels)"


@query(f"with g as (select i, round(0.01 + i * 0.01, 6)::double as threshold from (select unnest(range(0, 80, 4)) as i)), c as (select threshold, count(*) filter (where y = 1 and s >= threshold) as tp, count(*) filter (where y = 0 and s >= threshold) as fp, count(*) filter (where y = 1 and s < threshold) as fn from {_S}, g group by 1) select threshold, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 4) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 4) as recall, 10::double * fn + fp as cost from c")
def threshold_curve(spark, d):
    from .statistics import scores

    return stats.threshold_curve(scores(spark, d), "y", "s")


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE = "md5(" + " || '|' || ".join(_LINE_KEY) + ")"


@query(f"select count(*) as n_rows, sum(l_orderkey)::bigint as orders, sum(l_partkey)::bigint as parts, max({_LINE}) as last_hash from (select * from lineitem order by {_LINE} limit 50000)")
def adaptive_sample(spark, d):
    """Exactly 50,000 rows of a larger table, by the hash of its key."""
    sample = sources.adaptive_sample(read(spark, d, "lineitem"), _LINE_KEY)
    return sample.agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("orders"), F.sum("l_partkey").alias("parts"), F.max(F.md5(F.concat_ws("|", *_LINE_KEY))).alias("last_hash"))


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES))
def list_tables(spark, d):
    """The tables of a folder with their rows."""
    names = [r.table_name for r in sources.list_tables(spark, d).collect()]
    return sources.row_counts({n: read(spark, d, n) for n in names})


# Columns of the tables that end like a key, by their names without the tables' prefixes.
_KEYS = {"regionkey": ("region.r_regionkey", "nation.n_regionkey"), "nationkey": ("nation.n_nationkey", "customer.c_nationkey", "supplier.s_nationkey"), "custkey": ("customer.c_custkey", "orders.o_custkey"), "suppkey": ("supplier.s_suppkey", "lineitem.l_suppkey"), "partkey": ("part.p_partkey", "lineitem.l_partkey"), "orderkey": ("orders.o_orderkey", "lineitem.l_orderkey"), "doc_id": ("documents.doc_id", "labels.doc_id")}
_PAIRS = [(*a.split("."), *b.split(".")) for columns in _KEYS.values() for a in columns for b in columns if a != b]


@query(
    "select child_table, child_column, parent_table, parent_column, source, child_keys, orphan_keys, parent_rows from ("
    + " union all ".join(f"select '{ct}' as child_table, '{cc}' as child_column, '{pt}' as parent_table, '{pc}' as parent_column, 'name' as source, (select count(distinct {cc}) from {ct}) as child_keys, (select count(distinct {cc}) from {ct} where {cc} not in (select {pc} from {pt})) as orphan_keys, (select count(*) from {pt}) as parent_rows, (select count(distinct {pc}) from {pt}) as parent_keys" for ct, cc, pt, pc in _PAIRS)
    + ") r where orphan_keys = 0 and parent_rows = parent_keys"
)
def relations(spark, d):
    """Keys between all tables, found by sketches of their columns."""
    return mart.discover_relations({t: read(spark, d, t) for t in TABLES})


@query("select c_mktsegment, k, count(*) as n from (select c_mktsegment, case when c_acctbal is null then 1 else 0 end as k from customer) group by 1, 2")
def bool_flags(spark, d):
    """Boolean columns become numbers in a fitted pipeline."""
    df = read(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").isNull().alias("k"))
    fitted = clean.FeaturePipeline([], clean.Imputer(), clean.OneHot({}), clean.RobustScaler({}))
    return fitted.transform(df).groupBy("c_mktsegment", "k").agg(F.count("*").alias("n"))


# -- attributions of a linear score over customers, whose contributions are known --

_PARTS = {"c_acctbal": "(c_acctbal - 4500) / 1000", "c_custkey": "((c_custkey % 11) - 5) / 4::double", "c_nationkey": "(c_nationkey - 12) / 30::double"}
_TOTAL = " + ".join(_PARTS.values())
_MADE = "(" + union(f"select c_custkey as key, '{c}' as feature, {e} as contribution, {_TOTAL} as prediction, {c}::double as x from customer" for c, e in _PARTS.items()) + ")"


def linear(spark, d):
    df = read(spark, d, "customer").withColumn("key", F.col("c_custkey"))
    parts = {"c_acctbal": (F.col("c_acctbal") - 4500) / 1000, "c_custkey": ((F.col("c_custkey") % 11) - 5) / 4.0, "c_nationkey": (F.col("c_nationkey") - 12) / 30.0}
    total = parts["c_acctbal"] + parts["c_custkey"] + parts["c_nationkey"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("contribution")) for n, c in parts.items()]))
    return df, df.select("key", total.alias("prediction"), rows.alias("r")).select("key", "r.*", "prediction")


@query(f"with g as (select feature, avg(abs(contribution)) as m from {_MADE} group by 1) select feature, round(m, 6) as mean_abs, round(100 * m / sum(m) over (), 4) as share_pct, row_number() over (order by m desc, feature)::int as rank, 100 * m / sum(m) over () < 1.5 as is_noise from g")
def contribution_importance(spark, d):
    return select.global_importance(linear(spark, d)[1]).select("feature", F.round("mean_abs", 6).alias("mean_abs"), F.round("share_pct", 4).alias("share_pct"), "rank", "is_noise")


@query(f"with g as (select feature, corr(x, contribution) as r from {_MADE} group by 1) select feature, case when r > 0.05 then 'positive' when r < -0.05 then 'negative' else 'non-linear' end as direction from g")
def contribution_direction(spark, d):
    df, made = linear(spark, d)
    return select.effect_direction(made, df.select("key", *_PARTS), "key", list(_PARTS)).select("feature", "direction")


@query(f"with p as (select distinct key, prediction from {_MADE}), m as (select quantile_disc(prediction, 0.5) as mid from p), c as ((select 'highest' as \"case\", key from p order by prediction desc, key desc limit 1) union all (select 'median', key from p, m order by abs(prediction - mid), key limit 1) union all (select 'lowest', key from p order by prediction, key limit 1)) select * from (select \"case\", key, feature, round(contribution, 6) as contribution, row_number() over (partition by \"case\" order by abs(contribution) desc, feature)::int as place from {_MADE} join c using (key)) where place <= 2")
def contribution_cases(spark, d):
    return select.representative_cases(linear(spark, d)[1], "key", 2).select("case", "key", "feature", F.round("contribution", 6).alias("contribution"), "place")


@query(f"with i as ({_RANKED}), m as (select feature, 1 - importance as mi from i), r as (select i.feature, row_number() over (order by importance desc, i.feature) as r1, row_number() over (order by mi desc, i.feature) as r2 from i join m using (feature)), s as (select feature, 0.65::double * r1 + 0.35::double * r2 as score from r) select feature, round(score, 6) as score, row_number() over (order by score, feature)::int as rank from s")
def rank_consensus(spark, d):
    own = ranked(spark, d)
    made = select.consensus_rank(own.select("feature", "importance"), own.select("feature", (1 - F.col("importance")).alias("mi")))
    return made.select("feature", F.round("score", 6).alias("score"), "rank")


_SEGMENTS = union(f"select '{c}' as feature, l_returnflag as segment, round(avg({c}), 9) as importance from lineitem group by 2 union all select '{c}', 'ALL', round(avg({c}) * {k}, 9) from lineitem" for c, k in (("l_discount", 0.7), ("l_tax", 1.0), ("l_quantity", 0.0)))


@query(f"with s as ({_SEGMENTS}), b as (select feature, importance as base from s where segment = 'ALL'), p as (select s.*, base, row_number() over (partition by segment order by importance desc, feature)::int as place from s join b using (feature) where segment <> 'ALL') select feature, segment, importance, base, place from p where place <= 2 and importance > 1.2 * base")
def segment_insights(spark, d):
    rows = None
    for c, k in (("l_discount", 0.7), ("l_tax", 1.0), ("l_quantity", 0.0)):
        df = read(spark, d, "lineitem")
        own = df.groupBy(F.col("l_returnflag").alias("segment")).agg(F.round(F.avg(c), 9).alias("importance")).unionByName(df.agg(F.round(F.avg(c) * k, 9).alias("importance")).withColumn("segment", F.lit("ALL")))
        own = own.withColumn("feature", F.lit(c))
        rows = own if rows is None else rows.unionByName(own)
    return select.segment_insights(rows).select("feature", "segment", "importance", "base", "place")


@query("select c_nationkey, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as label from (select c_nationkey, (c_nationkey + 1) / 250::double as p from customer group by 1)")
def significance(spark, d):
    p = (F.col("c_nationkey") + 1) / 250
    return read(spark, d, "customer").select("c_nationkey").distinct().select("c_nationkey", stats.significance_label(p).alias("label"))
