"""Queries of the evaluation and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import bucket
from ..operators import stats
from .profiling import union
from .registry import query, read

#: Labelled scores: the label moves the score, a hash of the id spreads it.
SCORES = "select doc_id, toxic as y, quality, round(0.6::double * (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100) / 100::double + 0.3::double * toxic, 4) as s from labels"


def scores(spark, d):
    return read(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), "quality", F.round(0.6 * bucket("doc_id", 100) / 100.0 + 0.3 * F.col("toxic"), 4).alias("s"))


_PRED = f"select *, (s >= 0.4)::int as p from ({SCORES})"
_MATRIX = f"select y as actual, p as predicted, count(*) as n from ({_PRED}) group by 1, 2"


def matrix(spark, d):
    return stats.confusion_matrix(scores(spark, d).withColumn("p", (F.col("s") >= 0.4).cast("int")), "y", "p")


@query(_MATRIX)
def confusion_matrix(spark, d):
    return matrix(spark, d)


_REPORT = f"with m as ({_MATRIX}), c as (select l as label, coalesce((select sum(n) from m where actual = l), 0)::bigint as support, coalesce((select sum(n) from m where predicted = l), 0)::bigint as predicted, coalesce((select sum(n) from m where actual = l and predicted = l), 0)::bigint as tp from (select unnest([0, 1]) as l)), r as (select *, case when predicted > 0 then tp / predicted::double else 0 end as p, case when support > 0 then tp / support::double else 0 end as r from c) select label, support, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1 from r"


@query(_REPORT)
def class_report(spark, d):
    return stats.class_report(matrix(spark, d))


@query("select " + ", ".join(f"round(sum({c} * support) / sum(support)::double, 4) as {c}" for c in ("precision", "recall", "f1")) + f" from ({_REPORT})")
def weighted_report(spark, d):
    return stats.weighted_report(stats.class_report(matrix(spark, d)))


_BY = f"select s, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from ({SCORES}) group by 1"


@query(f"select round(sum(pos * (coalesce(b, 0) + neg / 2::double)) / (sum(pos) * sum(neg))::double, 4) as auc from (select pos, neg, sum(neg) over (order by s rows between unbounded preceding and 1 preceding) as b from ({_BY}))")
def roc_auc(spark, d):
    return stats.roc_auc(scores(spark, d), "y", "s")


@query(f"select s as threshold, round(sum(neg) over (order by s desc) / sum(neg) over ()::double, 6) as fpr, round(sum(pos) over (order by s desc) / sum(pos) over ()::double, 6) as tpr from ({_BY})")
def roc_curve(spark, d):
    return stats.roc_curve(scores(spark, d), "y", "s").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"with c as (select s, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp, sum(pos) over () as p from ({_BY})), r as (select s, tp / p::double as r, tp / (tp + fp)::double as pr from c) select round(sum((r - coalesce(pr0.r, 0)) * (pr + coalesce(pr0.p, 1)) / 2), 4) as pr_auc from (select *, {{'r': lag(r) over (order by s desc), 'p': lag(pr) over (order by s desc)}} as pr0 from r)")
def pr_auc(spark, d):
    return stats.pr_auc(scores(spark, d), "y", "s")


def _grid(low, step, points):
    return f"select round({low}::double + i * {step}::double, 6) as threshold, count(*) filter (where y = 1 and s >= round({low}::double + i * {step}::double, 6)) as tp, count(*) filter (where y = 0 and s >= round({low}::double + i * {step}::double, 6)) as fp, count(*) filter (where y = 1 and s < round({low}::double + i * {step}::double, 6)) as fn, count(*) filter (where y = 0 and s < round({low}::double + i * {step}::double, 6)) as tn from ({SCORES}), (select unnest(range({points})) as i) group by i"


def _cost(k, low, step, points):
    return f"with g as (select *, {k}::double * fn + fp as cost from ({_grid(low, step, points)})), b as (select cost as base from g order by abs(threshold - 0.5) limit 1) select threshold, cost, tp, fp, fn, tn, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 4) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 4) as recall, round(case when base > 0 then 100 * (base - cost) / base else 0 end, 4) as saved_pct from g, b order by cost, threshold limit 1"


@query(_cost(5, 0.05, 0.01, 91))
def cost_threshold(spark, d):
    return stats.cost_threshold(scores(spark, d), "y", "s")


@query(_cost(3, 0.01, 0.01, 99))
def cost_cutoff(spark, d):
    return stats.cost_threshold(scores(spark, d), "y", "s", 3.0, 1.0, 0.01, 0.01, 99)


_SWEEP = f"with g as (select *, 10::double * fn + fp as cost, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r from ({_grid(0.01, 0.01, 99)})), f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from g) "


@query(_SWEEP + union(f"(select '{n}' as goal, threshold, round(p, 4) as precision, round(r, 4) as recall, round(f1, 4) as f1, cost from f order by {o} limit 1)" for n, o in (("max_f1", "-round(f1, 9), threshold"), ("min_cost", "cost, threshold"), ("balanced", "case when p > 0.1 then round(abs(p - r), 9) else 9 end, threshold"), ("default", "abs(threshold - 0.5)"))))
def threshold_sweep(spark, d):
    return stats.threshold_sweep(scores(spark, d), "y", "s")


_REG = "select l_extendedprice as y, l_quantity * 1400 + 2000 as p from lineitem"


def reg(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1400 + 2000).alias("p"))


@query(f"select round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 4) as r2, round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse from ({_REG})")
def regression_metrics(spark, d):
    return stats.regression_metrics(reg(spark, d), "y", "p")


@query(f"with e as (select y - p as e from ({_REG})), r as (select min(e) as lo, max(e) as hi from e) select least(39, floor((e - lo) * 40 / (hi - lo)))::int as bin, count(*) as n from e, r group by 1")
def residual_hist(spark, d):
    return stats.residual_hist(reg(spark, d), "y", "p")


@query(f"with e as (select min(s) as lo, max(s) as hi from ({SCORES})), g as (select i, lo + i * (hi - lo) / 11 as cut from e, (select unnest(range(1, 11))::int as i)), m as (select i, cut, count(*) filter (where y = 1 and s >= cut) as tp, count(*) filter (where y = 0 and s >= cut) as fp, count(*) filter (where y = 1 and s < cut) as fn, count(*) filter (where y = 0 and s < cut) as tn from ({SCORES}), g group by 1, 2) select i, round(cut, 4) as cut, round(((tp + fn) * case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end + (tn + fp) * case when 2 * tn + fp + fn > 0 then 2 * tn / (2 * tn + fn + fp)::double else 0 end) / (tp + fn + tn + fp), 4) as weighted_f1 from m")
def cf_threshold(spark, d):
    return stats.cf_threshold(scores(spark, d), "y", "s")


_SLICE = "case when n_chars < 500 then 'short' when n_chars < 3000 then 'medium' else 'long' end"


@query(f"select {_SLICE} as slice, count(*) as n, round(avg((p = y)::int::double), 4) as champion, round(avg((y = 0)::int::double), 4) as baseline, round(100 * (avg((p = y)::int::double) - avg((y = 0)::int::double)) / avg((y = 0)::int::double), 4) as lift_pct from ({_PRED}) join documents using (doc_id) group by 1 having count(*) >= 5")
def slice_metrics(spark, d):
    df = scores(spark, d).join(read(spark, d, "documents"), "doc_id").withColumns({"p": (F.col("s") >= 0.4).cast("int"), "b": F.lit(0)})
    return stats.slice_metrics(df, F.expr(_SLICE), "y", "p", "b")


@query()
def bootstrap_ci(spark, d):
    return stats.bootstrap_ci(read(spark, d, "events"), "value", "event_id")


_PAIR = "select l_quantity as a, l_discount * 500 as b from lineitem"


def pair(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))


@query(f"with d as (select round(a - b, 6) as d from ({_PAIR})), c as (select abs(d) as s, count(*) as t, count(*) filter (where d > 0) as up from d where d <> 0 group by 1), r as (select t, (coalesce(sum(t) over (order by s rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2::double) * up as r from c), x as (select sum(t)::bigint as n, sum(r) as w, sum(t::double * t * t - t) as ties from r) select n, round(w, 1) as w_plus, round((w - n::double * (n + 1) / 4) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48), 4) as z, round((w - n::double * (n + 1) / 4) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(n), 4) as effect, n >= 5 as is_sufficient from x")
def wilcoxon(spark, d):
    return stats.wilcoxon(pair(spark, d), "a", "b")


@query(f"select count(*) as n, round(avg(a - b), 4) as mean_difference, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) as t from ({_PAIR})")
def paired_t(spark, d):
    return stats.paired_t(pair(spark, d), "a", "b")


# Sold pieces of each part that came back and that were kept, for sizes of parts.
_RETURNS = "select p_size as g, sum(l_quantity) filter (where l_returnflag = 'R') as a, sum(l_quantity) filter (where l_returnflag = 'A') as b from lineitem join part on l_partkey = p_partkey group by l_partkey, p_size"


def returns(spark, d):
    sold = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", F.col("p_size").alias("g")), F.col("l_partkey") == F.col("p_partkey"))
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return sold.groupBy("l_partkey", "g").agg(of("R").alias("a"), of("A").alias("b")).drop("l_partkey")


def simpson(f: str, low: str, high: str, n: int = 2000) -> str:
    """SQL of an integral of ``f`` (an expression of x) by Simpson's rule."""
    at = f"({low} + i * ({high} - {low}) / {n}::double)"
    return f"(select sum(({f.replace('{x}', at)}) * case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end) * ({high} - {low}) / {3 * n}::double from range({n + 1}) as r(i))"


#: P(Z > z) in SQL, by integration.
_TAIL = "0.5::double - " + simpson("exp(-{x} * {x} / 2) / sqrt(2 * pi())", "0::double", "z")


def _rational(q: str, top: tuple, bottom: tuple) -> str:
    horner = lambda c: " + ".join(["(" * (len(c) - 1) + str(c[0])]) + "".join(f" * {q} + {x})" for x in c[1:])
    return f"({horner(top)}) / ({horner(bottom)})"


# The coefficients of Acklam's approximation of the normal quantile.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661906416, 1)
#: |z| with P(Z > z) = p.
_QUANTILE = f"case when least(p, 1 - p) < 0.02425 then abs({_rational('sqrt(-2 * ln(least(p, 1 - p)))', _C, _D)}) else abs((p - 0.5) * {_rational('((p - 0.5) * (p - 0.5))', _A, _B)}) end"
_LABEL = "case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end"


@query(
    f"""with d as (select g, round(b - a, 6) as d from ({_RETURNS}) where a is not null and b is not null),
pairs as (select g, count(*) as n_pairs, avg(d) as lift from d group by g),
c as (select g, abs(d) as s, count(*) as t, count(*) filter (where d > 0) as up from d where d <> 0 group by g, s),
r as (select *, 2 * coalesce(sum(t) over (partition by g order by s rows between unbounded preceding and 1 preceding), 0) + t + 1 as r from c),
x as (select g, sum(t)::bigint as n, sum(r * up)::bigint as w2, sum(t::double * t * t - t) as ties, sum(r * t)::bigint as total, flatten(list(list_transform(range(t), lambda i: [r::double]))) as ranks from r group by g),
e as (select g, case when n <= 50 then list_sum(list_slice(list_reduce(list_prepend(list_transform(range(total + 1), lambda i: case when i = 0 then 1::double else 0::double end), ranks), lambda ways, k: list_transform(ways, lambda v, i: v + case when i > k[1]::int then ways[i - k[1]::int] else 0 end)), w2 + 1, total + 1)) / power(2, n) end as exact from x),
z as (select x.*, e.exact, (w2 / 2::double - n::double * (n + 1) / 4) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from x join e using (g)),
p as (select *, case when n < 5 then 0.5 when n <= 50 then exact else {_TAIL} end as p from z)
select g, n_pairs, coalesce(n, 0) as n, round(case when n >= 5 then w2 / 2::double else 0 end, 2) as w_plus, round(coalesce(p, 0.5), 6) as p_value,
round(coalesce(case when n < 5 or p <= 0 or p >= 1 then 0 when n <= 50 then {_QUANTILE} else abs(z) end / sqrt(n), 0), 3) as effect_size_r,
case when n >= 5 then {_LABEL} else 'insufficient' end as significance, round(lift, 4) as mean_lift from pairs left join p using (g)"""
)
def wilcoxon_test(spark, d):
    return stats.wilcoxon_test(returns(spark, d), "a", "b", by=("g",))


# Student's t by the substitution t = sqrt(n - 1) * tan(x), under which the density is a power of a cosine.
_T_TAIL = "2 * exp(lgamma(n / 2::double) - lgamma((n - 1) / 2::double)) / sqrt(pi()) * " + simpson("power(cos({x}), n - 2)", "atan(abs(t) / sqrt(n - 1))", "(pi() / 2)")


@query(
    f"""with d as (select g, a::double as x, b::double as y, (b - a)::double as d from ({_RETURNS}) where a is not null and b is not null),
s as (select g, count(*) as n, avg(x) as ma, avg(y) as mb, avg(d) as md, stddev_samp(d) as sd, min(d) as lo, max(d) as hi, count(*) filter (where d > 0) as b_wins from d group by g),
t as (select *, case when n > 1 and lo < hi then md / (sd / sqrt(n)) end as t, round(100 * (mb - ma) / greatest(abs(ma), 1e-4), 2) as lift_pct from s),
p as (select *, case when n < 2 or (lo = hi and lo = 0) then 1 when lo = hi then 0 else {_T_TAIL} end as p from t)
select g, n, round(ma, 4) as mean_a, round(mb, 4) as mean_b, lift_pct, b_wins, round(t, 4) as t, round(p, 6) as p_value, p < 0.05 and lift_pct > 0 as is_significant,
case when p < 0.05 and lift_pct > 0 then 'b is better' when p < 0.05 then 'b is worse' else 'no difference shown' end as verdict from p"""
)
def paired_t_test(spark, d):
    return stats.paired_t_test(returns(spark, d), "a", "b", by=("g",))


@query("select 'toxic' as column_name, count(distinct toxic) as distinct_values, 'binary' as task from labels union all select 'o_orderstatus', count(distinct o_orderstatus), 'multiclass' from orders union all select 'o_totalprice', count(distinct o_totalprice), 'regression' from orders")
def task_type(spark, d):
    from ..operators.models import task_type as detect

    return detect(read(spark, d, "labels"), "toxic").unionByName(detect(read(spark, d, "orders"), "o_orderstatus")).unionByName(detect(read(spark, d, "orders"), "o_totalprice"))


@query("select o_orderstatus as majority, round(count(*) / (select count(*) from orders)::double, 4) as accuracy from orders group by 1 order by count(*) desc, 1 limit 1")
def baseline_global(spark, d):
    from ..operators.models import baseline_global as baseline

    return baseline(read(spark, d, "orders"), "o_orderstatus")


@query("select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 6) as o_totalprice from orders")
def minmax_scale(spark, d):
    from ..operators.select import minmax_scale as scale

    return scale(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 6))
