"""Queries of the screening, cleaning and synthesis operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import bucket
from ..operators import clean, synth
from .profiling import union
from .registry import query, read

_BUCKET = "(('0x' || substr(md5({0}::varchar || '42'), 1, 8))::bigint % {1})"
LINES = "select *, case when l_partkey % 12 = 0 then null else l_quantity end as qty, case when l_partkey % 25 = 0 then null else l_shipmode end as mode from (select *, 'M' || (l_suppkey % 6)::varchar as l_shipmode from lineitem)"


def lines(spark, d):
    df = read(spark, d, "lineitem").withColumn("l_shipmode", F.concat(F.lit("M"), (F.col("l_suppkey") % 6).cast("string")))
    return df.withColumns({"qty": F.when(F.col("l_partkey") % 12 != 0, F.col("l_quantity")), "mode": F.when(F.col("l_partkey") % 25 != 0, F.col("l_shipmode"))})


_LEAK = ("o_orderpriority", "leak", "o_custkey")


@query("with t as (select *, case when o_orderstatus = 'F' then 'f' when o_orderstatus = 'O' then 'o' else 'p' || (o_orderkey % 2)::varchar end as leak from orders), k as (select count(distinct o_orderstatus) as k from t), v as (" + union(f"select '{c}' as column_name, {c}::varchar as value, count(distinct o_orderstatus) as targets from t where {c} is not null group by 2" for c in _LEAK) + ") select column_name, count(*) as distinct_values, max(targets) as most_targets, max(targets) = 1 and any_value(k) > 1 and count(*) between any_value(k) and 3 * any_value(k) as is_leak from v, k group by 1")
def leak_scan(spark, d):
    leak = F.when(F.col("o_orderstatus") == "F", "f").when(F.col("o_orderstatus") == "O", "o").otherwise(F.concat(F.lit("p"), (F.col("o_orderkey") % 2).cast("string")))
    return clean.leak_scan(read(spark, d, "orders").withColumn("leak", leak), list(_LEAK), "o_orderstatus")


_ORD = {"o_orderkey": (1, 1), "o_custkey": (1, 1), "o_orderstatus": (0, 1), "o_totalprice": (0, 0)}


@query("select column_name, round(ratio, 4) as distinct_ratio, (hinted and ratio >= 0.5) or (whole and ratio = 1) as is_id from (" + union(f"select '{c}' as column_name, count(distinct {c}) / count(*)::double as ratio, {bool(h)} as hinted, {bool(w)} as whole from orders" for c, (h, w) in _ORD.items()) + ")")
def id_scan(spark, d):
    return clean.id_scan(read(spark, d, "orders").select(*_ORD))


@query(f"select o_orderkey, {_BUCKET.format('o_orderkey', 100)} < 80 as is_train from orders")
def hash_split(spark, d):
    return clean.hash_split(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_train")


@query(f"select o_orderkey, o_custkey, {_BUCKET.format('o_custkey', 100)} < 80 as is_train from orders")
def group_split(spark, d):
    return clean.hash_split(read(spark, d, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "is_train")


_PLACE = "row_number() over (partition by o_orderstatus order by md5(o_orderkey::varchar || '42'), o_orderkey)"


@query(f"select o_orderkey, {_PLACE} <= floor(0.8::double * count(*) over (partition by o_orderstatus)) as is_train from orders")
def stratified_split(spark, d):
    return clean.stratified_split(read(spark, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "is_train")


@query(f"select fold, o_orderstatus, count(*) as n from (select o_orderstatus, ({_PLACE} % 5)::int as fold from orders) group by 1, 2")
def kfold_counts(spark, d):
    return clean.kfold(read(spark, d, "orders"), "o_orderkey", 5, "o_orderstatus").groupBy("fold", "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"with t as ({LINES}), m as (select median(qty) as m from t where {_BUCKET.format('l_orderkey', 100)} < 80) select l_orderkey, l_linenumber, coalesce(qty, m) as qty from t, m")
def impute_median(spark, d):
    df = lines(spark, d)
    return clean.Imputer.fit(df.where(bucket("l_orderkey", 100, "42") < 80), ["qty"]).transform(df).select("l_orderkey", "l_linenumber", "qty")


_MODE = "(select mode from t where mode is not null group by mode order by count(*) desc, mode limit 1)"


@query(f"with t as ({LINES}) select l_orderkey, l_linenumber, coalesce(mode, {_MODE}) as mode from t")
def impute_mode(spark, d):
    df = lines(spark, d)
    return clean.Imputer.fit(df, ["mode"]).transform(df).select("l_orderkey", "l_linenumber", "mode")


@query(f"with t as ({LINES}) select column_name, round(r, 4) as missing_ratio, case when r = 0 then 'none' when r < 0.05 then 'low' when r < 0.4 then 'medium' else 'severe' end as tier from (" + union(f"select '{c}' as column_name, (count(*) - count({c})) / count(*)::double as r from t" for c in ("qty", "mode", "l_tax")) + ")")
def missing_tiers(spark, d):
    return clean.Imputer.fit(lines(spark, d), ["qty", "mode", "l_tax"]).log(spark).drop("fill")


@query(f"with t as ({LINES}), m as (select median(qty) as m from t where l_orderkey % 2 = 0) select l_orderkey, l_linenumber, (qty is null)::int as qty_is_missing, coalesce(qty, m) as qty from t, m where l_orderkey % 2 = 1")
def impute_apply(spark, d):
    df = lines(spark, d)
    fitted = clean.Imputer.fit(df.where("l_orderkey % 2 = 0"), ["qty"])
    return fitted.transform(df.where("l_orderkey % 2 = 1")).select("l_orderkey", "l_linenumber", "qty_is_missing", "qty")


#: P(K > x) of Kolmogorov's distribution, of the corrected statistic.
_KS_X = "((sqrt(na * nb / (na + nb)::double) + 0.12 + 0.11 / sqrt(na * nb / (na + nb)::double)) * d)"
_KS_P = "case when x < 1 then 1 - sqrt(2 * pi()) / greatest(x, 1e-9) * (select sum(exp(-power(2 * k - 1, 2) * pi() * pi() / (8 * power(greatest(x, 1e-9), 2)))) from range(1, 21) as r(k)) else 2 * (select sum(case when k % 2 = 1 then 1 else -1 end * exp(-2::double * k * k * x * x)) from range(1, 21) as r(k)) end"


@query(f"with c as (select l_extendedprice as v, count(*) filter (where g = 0) as a, count(*) filter (where g = 1) as b from (select *, (l_returnflag = 'R')::int as g from lineitem) group by 1), r as (select abs(sum(a) over (order by v) / sum(a) over ()::double - sum(b) over (order by v) / sum(b) over ()::double) as gap, sum(a) over () as na, sum(b) over () as nb from c), m as (select max(gap) as d, max(na)::bigint as na, max(nb)::bigint as nb from r), x as (select *, {_KS_X} as x from m), p as (select *, {_KS_P} as p from x) select round(d, 6) as d, na as n_a, nb as n_b, round(p, 6) as p_value, p >= 0.01 as is_same from p")
def ks_two_sample(spark, d):
    df = read(spark, d, "lineitem").withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return clean.ks_two_sample(df, "l_extendedprice", "g").withColumns({c: F.round(c, 6) for c in ("d", "p_value")})


# Columns with more and more nulls; the last has too few values to be tested.
_HOLES = {"qty": ("l_quantity", "l_partkey % 12 = 0"), "tax": ("l_tax", "l_partkey % 200 = 0"), "price": ("l_extendedprice", "l_suppkey % 3 > 0"), "discount": ("l_discount", "l_orderkey % 5000 = 0"), "rare": ("l_tax", "l_orderkey > 2 or l_linenumber > 5"), "whole": ("l_discount", "false")}


@query("with t as (select " + ", ".join(f"case when {h} then null else {c} end as {n}" for n, (c, h) in _HOLES.items()) + " from lineitem), long as (" + union(f"select '{n}' as column_name, {n} as x, coalesce({n}, (select median({n}) from t), 0) as v from t" for n in _HOLES) + f"), c as (select column_name, v, count(x) as a, count(*) as b from long group by 1, 2), r as (select column_name, abs(sum(a) over w / sum(a) over (partition by column_name)::double - sum(b) over w / sum(b) over (partition by column_name)::double) as gap, sum(a) over (partition by column_name) as na, sum(b) over (partition by column_name) as nb from c window w as (partition by column_name order by v)), m as (select column_name, max(gap) as d, max(na)::bigint as na, max(nb)::bigint as nb from r group by 1 having max(na) > 10), x as (select *, {_KS_X} as x from m), p as (select *, {_KS_P} as p from x) select column_name, na as n_valid, nb as n_filled, round(d, 4) as ks_stat, round(greatest(0, least(1, p)), 4) as p_value, p >= 0.01 as is_preserved from p")
def imputation_check(spark, d):
    df = read(spark, d, "lineitem").select(*[F.expr(f"case when {h} then null else {c} end").alias(n) for n, (c, h) in _HOLES.items()])
    return clean.Imputer.fit(df, list(_HOLES)).check(df)


@query(union(f"select '{c}' as column_name, count(distinct {c}) as distinct_values, count(distinct {c}) > 50 as dropped from part" for c in ("p_brand", "p_type", "p_name")))
def cardinality_guard(spark, d):
    return clean.cardinality_guard(read(spark, d, "part"), ["p_brand", "p_type", "p_name"])


def one_hot_frame(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return clean.OneHot.fit(df, ["l_returnflag", "l_linestatus"]).transform(df)


@query("select l_orderkey, l_linenumber, (l_returnflag = 'N')::int::double as l_returnflag_N, (l_returnflag = 'R')::int::double as l_returnflag_R, (l_linestatus = 'O')::int::double as l_linestatus_O from lineitem")
def one_hot(spark, d):
    return one_hot_frame(spark, d)


@query("select l_orderkey, l_linenumber, l_suppkey, round(count(*) over (partition by l_suppkey) / count(*) over ()::double, 6) as l_suppkey_freq from lineitem")
def freq_encode(spark, d):
    return clean.freq_encode(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey").withColumn("l_suppkey_freq", F.round("l_suppkey_freq", 6))


@query("select c_custkey, c_mktsegment, (dense_rank() over (order by c_mktsegment) - 1)::int as c_mktsegment_code from customer")
def factorize(spark, d):
    return clean.factorize(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("select l_orderkey, l_linenumber, round((l_extendedprice - m) / (q3 - q1), 6) as l_extendedprice from lineitem, (select median(l_extendedprice) as m, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem where l_orderkey % 2 = 0)")
def robust_scale(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.RobustScaler.fit(df.where("l_orderkey % 2 = 0"), ["l_extendedprice"]).transform(df).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query(f"with t as ({LINES}), m as (select median(qty) as m, quantile_cont(f, 0.25) as q1, quantile_cont(f, 0.75) as q3, median(f) as fm from (select qty, coalesce(qty, (select median(qty) from t where l_orderkey % 2 = 0)) as f from t where l_orderkey % 2 = 0)) select l_orderkey, l_linenumber, (qty is null)::int as qty_is_missing, round((coalesce(qty, m) - fm) / (q3 - q1), 6) as qty, (coalesce(l_returnflag, 'N') = 'N')::int::double as l_returnflag_N, (l_returnflag = 'R')::int::double as l_returnflag_R from t, m where l_orderkey % 2 = 1")
def pipeline_apply(spark, d):
    df = lines(spark, d).select("l_orderkey", "l_linenumber", "qty", "l_returnflag")
    train = df.where("l_orderkey % 2 = 0")
    imputer = clean.Imputer.fit(train, ["qty", "l_returnflag"])
    filled = imputer.transform(train)
    fitted = clean.FeaturePipeline([], imputer, clean.OneHot.fit(filled, ["l_returnflag"]), clean.RobustScaler.fit(filled, ["qty"]))
    return fitted.transform(df.where("l_orderkey % 2 = 1")).withColumn("qty", F.round("qty", 6))


# -- synthesis --------------------------------------------------------------------------


@query(union(f"select '{c}' as column_name, count(distinct {c}) as distinct_values, count(distinct {c}) > 1 and stddev_samp({c}) > 1e-9 as varies from (select *, 7::double as flat from lineitem)" for c in ("l_quantity", "flat")))
def zero_variance(spark, d):
    return synth.zero_variance(read(spark, d, "lineitem").withColumn("flat", F.lit(7.0)), ["l_quantity", "flat"])


_WIDE = "select l_orderkey, l_linenumber, l_quantity, l_discount, power(l_quantity, 4) as wide from lineitem"


@query(f"select l_orderkey, l_linenumber, round(ln(1 + wide), 6) as log1p_wide from ({_WIDE})")
def log1p_feature(spark, d):
    df = read(spark, d, "lineitem").withColumn("wide", F.pow("l_quantity", F.lit(4.0)))
    return synth.log1p_features(df, ["wide", "l_discount"], 1.0).select("l_orderkey", "l_linenumber", F.round("log1p_wide", 6).alias("log1p_wide"))


@query("select l_orderkey, l_linenumber, " + ", ".join(f"round(case when abs({b}) > 1e-6 then {a} / ({b} + 1e-6) else 0 end, 4) as {a}_per_{b}" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))) + " from lineitem")
def ratio_features(spark, d):
    made = synth.ratio_features(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return made.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in made.columns if "_per_" in c])


@query("with tr as (select * from lineitem where l_suppkey % 3 <> 0), g as (select l_suppkey, avg(l_quantity) as m from tr group by 1) select l_orderkey, l_linenumber, round(l_quantity - coalesce(m, (select avg(l_quantity) from tr)), 4) as l_quantity_dev from lineitem left join g using (l_suppkey)")
def group_deviation(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return synth.group_deviation(df, df.where("l_suppkey % 3 <> 0"), "l_suppkey", ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("l_quantity_dev", 4).alias("l_quantity_dev"))


def _mi(c):
    edges = ", ".join(str(i / 10) for i in range(1, 10))
    return f"select '{c}' as column_name, l_returnflag as y, len(list_filter((select quantile_cont({c}, [{edges}]) from lineitem), lambda e: e < {c})) as b from lineitem"


@query("with x as (" + union(_mi(c) for c in ("l_quantity", "l_extendedprice")) + "), n as (select column_name, b, y, count(*) as n from x group by all), p as (select *, sum(n) over (partition by column_name) as t, sum(n) over (partition by column_name, b) as nb, sum(n) over (partition by column_name, y) as ny from n) select column_name, round(sum(n / t::double * ln(n * t / (nb * ny)::double)), 4) as mi from p group by 1")
def mi_scores(spark, d):
    return synth.mi_scores(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")


def _digamma(x: str) -> str:
    z = f"({x} + 6::double)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8) - " + " - ".join(f"1 / ({x} + {i}::double)" for i in range(6)) + ")"


_MI = ("l_quantity", "l_extendedprice", "l_discount")
_BESIDE = ", ".join(f"abs({f}(x, {j}) over w - x)" for f in ("lag", "lead") for j in (1, 2, 3))


@query(
    "with long as ("
    + union(f"select '{c}' as c, l_returnflag as y, (floor(({c} - (select min({c}) from lineitem)) / (select max({c}) - min({c}) from lineitem) * 68719476735::double)::bigint << 26) + ('0x' || substr(md5(l_orderkey || ',' || l_linenumber || ',{c}'), 1, 8))::bigint % 67108864 as x from lineitem" for c in _MI)
    + f"), near as (select c, y, x, count(*) over (partition by c, y) as size, list_sort(list_filter([{_BESIDE}], lambda d: d is not null)) as beside from long window w as (partition by c, y order by x)), "
    + "r as (select c, x, size, least(3, size - 1) as k, greatest(beside[least(3, size - 1)] - 1, 0) as half from near where size > 1), "
    + "m as (select c, size, k, count(*) over (partition by c order by x range between half preceding and half following) as m from r) "
    + f"select c as column_name, round(greatest({_digamma('count(*)')} + avg({_digamma('k')} - {_digamma('size')} - {_digamma('m')}), 0), 4) as mi from m group by c"
)
def mi_nearest(spark, d):
    return synth.mi_nearest(read(spark, d, "lineitem"), list(_MI), "l_returnflag", ["l_orderkey", "l_linenumber"])



@query(union(f"select '{c}' as column_name, round(avg(length({c})), 4) as mean_length, avg(length({c})) > 10 as is_text from documents" for c in ("text", "lang", "source")))
def text_columns(spark, d):
    return synth.text_columns(read(spark, d, "documents").select("text", "lang", "source"))


_TEXT = "case when length(text) > 0 then round(length(regexp_replace(text, '{}', '', 'g')) / length(text)::double, 6) else 0 end"
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def features(spark, d):
    return synth.text_features(read(spark, d, "documents").select("doc_id", "text"), "text", "à-ÿ")


@query(f"select doc_id, length(text)::int as text_length, len({_WORDS.format('text')})::int as text_words, case when len({_WORDS.format('text')}) > 0 then round(list_sum(list_transform({_WORDS.format('text')}, lambda w: length(w)))::double / len({_WORDS.format('text')}), 6) else 0 end as text_word_length from documents")
def text_lengths(spark, d):
    return features(spark, d).select("doc_id", "text_length", "text_words", F.round("text_word_length", 6).alias("text_word_length"))


@query("select doc_id, " + _TEXT.format(r"[^\p{Nd}]") + " as text_digit_ratio from documents")
def text_digit_ratio(spark, d):
    return features(spark, d).select("doc_id", F.round("text_digit_ratio", 6).alias("text_digit_ratio"))


@query("select doc_id, " + _TEXT.format("[^à-ÿ]") + " as text_script_ratio from documents")
def text_script_ratio(spark, d):
    return features(spark, d).select("doc_id", F.round("text_script_ratio", 6).alias("text_script_ratio"))


@query("select doc_id, contains(text, '?')::int as text_has_question from documents")
def text_qmark(spark, d):
    return features(spark, d).select("doc_id", "text_has_question")


_TURNS = "select a.conv_id, a.turn, a.text as ta, b.text as tb from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1"


def turns(spark, d):
    a, b = (read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias(n)) for n in ("ta", "tb"))
    return synth.pair_features(a.join(b.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"]), "ta", "tb")


@query(f"select conv_id, turn, round(length(ta) / (length(tb) + 1)::double, 6) as length_ratio from ({_TURNS})")
def text_pair_ratio(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.round("length_ratio", 6).alias("length_ratio"))


@query(f"select conv_id, turn, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) else 0 end as jaccard from (select conv_id, turn, list_distinct({_WORDS.format('ta')}) as a, list_distinct({_WORDS.format('tb')}) as b from ({_TURNS}))")
def text_jaccard(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.round("jaccard", 6).alias("jaccard"))


@query("select l_orderkey, l_linenumber, (l_discount > 0)::int as has_fail, greatest(0, 80 - l_quantity) as attendance_gap, (l_tax < 2)::int as low_gpa from lineitem")
def at_risk_features(spark, d):
    return synth.at_risk_features(read(spark, d, "lineitem"), "l_discount", "l_quantity", "l_tax").select("l_orderkey", "l_linenumber", "has_fail", "attendance_gap", "low_gpa")


@query("select l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) as activity_total, (l_discount > 0)::int + (l_tax > 0)::int as course_breadth from lineitem")
def activity_breadth(spark, d):
    return synth.activity_breadth(read(spark, d, "lineitem"), ["l_quantity", "l_tax"], ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", F.round("activity_total", 4).alias("activity_total"), "course_breadth")


@query("select l_orderkey, l_linenumber, round(l_quantity / greatest(l_tax, 0.1::double), 6) as gpa_ratio from lineitem")
def safe_gpa_ratio(spark, d):
    return synth.safe_gpa_ratio(read(spark, d, "lineitem"), "l_quantity", "l_tax").select("l_orderkey", "l_linenumber", F.round("gpa_ratio", 6).alias("gpa_ratio"))


@query("select o_orderkey, round(dr, 2) as value_drop, (dr > 0 and o_totalprice <= 8)::int as crisis, round(case when o_totalprice <> 0 then o_custkey / o_totalprice else 0 end, 8) as part_share from (select *, coalesce(lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) - o_totalprice, 0) as dr from orders)")
def recipe_features(spark, d):
    made = synth.recipe_features(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "o_custkey", "o_totalprice")
    return made.select("o_orderkey", F.round("value_drop", 2).alias("value_drop"), "crisis", F.round("part_share", 8).alias("part_share"))


@query("select o_orderkey, o_totalprice, 0::double as never_there from orders")
def apply_selection(spark, d):
    from ..operators.select import apply_selection as apply

    return apply(read(spark, d, "orders"), ["o_orderkey", "o_totalprice", "never_there"])


