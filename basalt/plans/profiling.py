"""Queries of the sources, profiles, audits and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import audit, mart, profile
from .registry import query, read

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Missing values by rule: the tables themselves have none.
GAPS = "select *, case when o_orderkey % 10 = 0 then null else o_totalprice end as price, case when o_orderkey % 15 = 0 then null else o_orderpriority end as priority, case when o_orderkey % 20 = 0 then null else o_custkey end as cust from orders"
GAP_COLUMNS = ["o_orderkey", "o_orderstatus", "price", "priority", "cust"]
MASTER = "select c_custkey from customer where c_custkey % 10 <> 0"


def gaps(spark, d):
    gap = lambda m, c: F.when(F.col("o_orderkey") % m != 0, F.col(c))
    return read(spark, d, "orders").withColumns({"price": gap(10, "o_totalprice"), "priority": gap(15, "o_orderpriority"), "cust": gap(20, "o_custkey")})


def master(spark, d):
    return read(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey")


def union(parts):
    return " union all ".join(parts)


# -- sources ----------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_quantity > 45")
def scan_parquet(spark, d):
    return sources.read_source(spark, f"{d}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey group by 1")
def query_over_files(spark, d):
    tables = {n: read(spark, d, n) for n in ("orders", "customer")}
    return sources.query_over_files(spark, tables, "select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey group by c_mktsegment")


TABLES = ("customer", "orders", "lineitem", "events", "documents")


@query(union(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES))
def row_counts(spark, d):
    return sources.row_counts({t: read(spark, d, t) for t in TABLES})


_BUCKET = "(('0x' || substr(md5({}), 1, 8))::bigint % {})"


@query(f"select o_orderkey, o_totalprice from orders where {_BUCKET.format("o_orderkey::varchar || '42'", 1000)} < 200")
def hash_sample(spark, d):
    return sources.hash_sample(read(spark, d, "orders"), "o_orderkey", 200).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders order by md5(o_orderkey::varchar), o_orderkey limit 100")
def exact_sample(spark, d):
    return sources.exact_sample(read(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("select doc_id, substr(text, 1, 200) as text, lang from documents")
def truncate_text(spark, d):
    return sources.truncate_text(read(spark, d, "documents").select("doc_id", "text", "lang"))


_DIGEST = "select ('0x' || substr(md5(concat_ws('|', {})), 1, 15))::bigint as d from {}"


def _parts(*columns):
    """Columns as the row digest writes them: each after its length."""
    return ", ".join(f"coalesce(length({c})::varchar || ':' || {c}, '-')" for c in (f"{c}::varchar" for c in columns))


_DIGESTED = "select count(*) as n_rows, bit_xor(d) as xor_digest, sum(d % 1000000007)::bigint as sum_digest from ({})"


@query(_DIGESTED.format(_DIGEST.format(_parts("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer")))
def content_digest(spark, d):
    return sources.content_digest(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query(f"select substr(md5(concat_ws('|', 'event_id:bigint,user_id:bigint,event_type:string', n_rows::varchar, xor_digest::varchar, sum_digest::varchar)), 1, 16) as fingerprint, n_rows from ({_DIGESTED.format(_DIGEST.format(_parts("event_id", "user_id", "event_type"), "events"))})")
def fingerprint(spark, d):
    return sources.fingerprint(read(spark, d, "events").select("event_id", "user_id", "event_type"))


# -- profiles ---------------------------------------------------------------------------

_PII = [(c, n, p, i) for c in ("text", "source") for i, (n, p) in enumerate(profile.PII_PATTERNS)]


@query("select column_name, pattern, matches, row_number() over (partition by column_name order by place) = 1 as leading from (" + union(f"select '{c}' as column_name, '{n}' as pattern, {i} as place, count(*) filter (where regexp_matches({c}, '{p}')) as matches from documents" for c, n, p, i in _PII) + ") where matches > 0")
def pii_scan(spark, d):
    return profile.pii_scan(read(spark, d, "documents"), ["text", "source"])


_MASK = "text"
for _n, _p in profile.PII_PATTERNS:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '***', 'g')"


@query(f"select doc_id, md5({_MASK}) as masked from documents")
def pii_mask(spark, d):
    return profile.pii_mask(read(spark, d, "documents"), "text").select("doc_id", F.md5("text").alias("masked"))


_FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber", "qty"]
_FLAG_SQL = "select l_returnflag, l_linestatus, l_linenumber, case when l_orderkey % 7 = 0 then null else l_quantity end as qty from lineitem"


def flag_rows(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("qty"))


_OVERVIEW = f"""
with t as ({_FLAG_SQL}), a as (select count(*) as n_rows, count(*) filter (where qty is null) as missing_cells from t),
b as (select coalesce(sum(c - 1), 0)::bigint as duplicate_rows from (select count(*) as c from t group by l_returnflag, l_linestatus, l_linenumber, qty))
select n_rows, 4::int as n_cols, n_rows * 4 as n_cells, missing_cells, round(100::double * missing_cells / (n_rows * 4), 4) as missing_pct,
  duplicate_rows, round(100::double * duplicate_rows / n_rows, 4) as duplicate_pct from a, b"""


@query(_OVERVIEW)
def overview(spark, d):
    return profile.overview(flag_rows(spark, d))


_HEALTH = f"select round(greatest(100 - least(40.0::double, 2 * missing_pct) - least(20.0::double, 4 * duplicate_pct) - 10.0::double, 0::double), 4) as health_score from ({_OVERVIEW})"


@query(_HEALTH)
def health_score(spark, d):
    return profile.health_score(profile.overview(flag_rows(spark, d)), 2)


@query(f"select health_score, case when health_score >= 85 then 'A' when health_score >= 70 then 'B' else 'C' end as grade from ({_HEALTH})")
def health_grade(spark, d):
    return profile.health_grade(profile.health_score(profile.overview(flag_rows(spark, d)), 2))


_KINDS = {"o_orderkey": "bigint", "o_orderstatus": "string", "price": "double", "priority": "string", "cust": "bigint"}
_PROFILE = f"with t as ({GAPS}) " + union(f"select '{c}' as column_name, '{k}' as dtype, count(*) - count({c}) as missing, round(100::double * (count(*) - count({c})) / count(*), 4) as missing_pct, count(distinct {c}) as distinct_values from t" for c, k in _KINDS.items())


@query(_PROFILE)
def column_profile(spark, d):
    return profile.column_profile(gaps(spark, d).select(*GAP_COLUMNS))


@query(f"select column_name, missing, missing_pct, case when dtype = 'string' then 'mode' else 'median' end as fill from ({_PROFILE}) where missing > 0")
def missing_summary(spark, d):
    return profile.missing_summary(gaps(spark, d).select(*GAP_COLUMNS))


def _q(c, p):
    return f"quantile_cont({c}, {p})"


@query(union(f"select '{c}' as column_name, " + ", ".join(f"round({_q(c, p)}, 4) as {n}" for p, n in ((0, "min_value"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max_value"))) + f", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std from lineitem" for c in NUM))
def numeric_summary(spark, d):
    return profile.numeric_summary(read(spark, d, "lineitem"), NUM)


@query(union(f"select '{c}' as column_name, count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers, round(100::double * count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 4) as outlier_pct from events, (select {_q(c, 0.25)} as q1, {_q(c, 0.75)} as q3 from events)" for c in ("value",)))
def iqr_outliers(spark, d):
    return profile.iqr_outliers(read(spark, d, "events"), ["value"])


@query("select column_name, round(s, 4) as skew, case when abs(s) < 0.5 then 'symmetric' when s > 0.5 then 'right' else 'left' end as skew_label from (" + union(f"select '{c}' as column_name, avg(power({c} - m, 3)) / power(var_pop({c}), 1.5) as s from {t}, (select avg({c}) as m from {t})" for c, t in (("l_extendedprice", "lineitem"), ("l_quantity", "lineitem"))) + ")")
def skewness(spark, d):
    return profile.skewness(read(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])


@query(f"with t as ({GAPS}), l as (" + union(f"select '{c}' as column_name, {c} as value from t" for c in ("o_orderstatus", "priority")) + "), c as (select column_name, value, count(*) as n from l group by 1, 2) select * from (select column_name, value, n, round(100::double * n / (select count(*) from t), 4) as pct, row_number() over (partition by column_name order by n desc, value)::int as place from c where value is not null) where place <= 5")
def top_values(spark, d):
    return profile.top_values(gaps(spark, d), ["o_orderstatus", "priority"])


# Net price and charge follow the extended price, so that there are pairs to find.
_PRICED = "(select *, l_extendedprice * (1 - l_discount) as net, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lineitem)"
_PAIRED = [*NUM, "net", "charge"]
_PAIRS = [(a, b) for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]]


@query("select * from (" + union(f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 4) as r from {_PRICED}" for a, b in _PAIRS) + ") where abs(r) >= 0.6")
def corr_pairs(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return profile.corr_pairs(read(spark, d, "lineitem").withColumns({"net": net, "charge": net * (1 + F.col("l_tax"))}), _PAIRED)


@query(f"with t as (select *, case when o_orderkey % 20 < 3 then null else o_orderkey end as other from ({GAPS})), f as (select (price is null)::int::double as price, (cust is null)::int::double as cust, (other is null)::int::double as other from t) select * from (" + union(f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 4) as r from f" for a, b in (("price", "cust"), ("price", "other"), ("cust", "other"))) + ") where abs(r) >= 0.4")
def nullity_corr(spark, d):
    return profile.nullity_corr(gaps(spark, d).withColumn("other", F.when(F.col("o_orderkey") % 20 >= 3, F.col("o_orderkey"))), ["price", "cust", "other"])


@query("""
with a as (select count(*) as n, sum((quality = 0)::int + (toxic = 0)::int) as z from labels),
b as (select min(c) as least, sum(c) as every from (select count(*) as c from labels group by toxic))
select n as n_rows, 3::int as n_cols, round(n / 3::double, 4) as rows_per_col, round(100::double * (z + (select count(*) from labels where doc_id = 0)) / (n * 3), 4) as sparse_pct,
  round(100::double * least / every, 4) as minority_pct, 100::double * least / every < 10 as severe,
  case when n < 5000 then 'small' when n < 50000 then 'medium' else 'large' end as phase from a, b""")
def data_dna(spark, d):
    return profile.data_dna(read(spark, d, "labels").select("doc_id", "quality", "toxic"), "toxic")


@query("""
with c as (select quality::varchar as label, count(*) as n from labels where quality is not null group by 1),
s as (select *, 100::double * min(n) over () / sum(n) over () as share, sum(n) over () as every, count(*) over () as k from c)
select label, n, round(every / (k * n)::double, 4) as weight, round(share, 4) as minority_pct,
  case when share >= 40 then 'BALANCED' when share >= 20 then 'MODERATE_IMBALANCE' when share >= 5 then 'SEVERE_IMBALANCE' else 'EXTREME_IMBALANCE' end as severity from s""")
def class_balance(spark, d):
    return profile.class_balance(read(spark, d, "labels"), "quality")


# -- audits -----------------------------------------------------------------------------


@query(f"""
with t as (select trim(cust::varchar) as c from ({GAPS})), k as (select trim(c_custkey::varchar) as k from ({MASTER})),
j as (select c, k from t left join k on c = k)
select count(*) as n_rows, count(*) filter (where c is null) as null_codes, count(*) filter (where k is null) as mismatch,
  round(count(*) filter (where k is null) / count(*)::double, 4) as mismatch_rate,
  (select string_agg(c, ',' order by c) from (select distinct c from j where k is null and c is not null order by c limit 5)) as examples from j""")
def code_integrity(spark, d):
    return audit.code_integrity(gaps(spark, d), "cust", master(spark, d), "c_custkey")


@query(f"select count(*) as n_rows, count(price) as valid, count(*) - count(price) as nulls, round((count(*) - count(price)) / count(*)::double, 4) as null_rate, (count(*) - count(price)) / count(*)::double <= 0.25 and count(price) >= 30 as passes from ({GAPS})")
def target_completeness(spark, d):
    return audit.target_completeness(gaps(spark, d), "price")


_CLASSES = "with c as (select s_nationkey::varchar as c, count(*) as n from supplier where s_nationkey is not null group by 1) select count(*) as classes, coalesce(min(n), 0) as least, coalesce(string_agg(c, ',' order by c) filter (where n < 10), '') as thin_classes, case when count(*) < 2 or coalesce(min(n), 0) < 3 then 'FAIL' when min(n) < 10 then 'WARN' else 'PASS' end as status from c"


@query(_CLASSES)
def class_sufficiency(spark, d):
    return audit.class_sufficiency(read(spark, d, "supplier"), "s_nationkey")


_VERDICT = f"""
with t as ({GAPS}), a as (select count(*) as n_rows, (count(*) - count(priority)) / count(*)::double as nr, count(priority) as valid from t),
c as (select count(*) as classes, min(n) as least from (select priority, count(*) as n from t where priority is not null group by 1)),
m as (select round(count(*) filter (where k is null) / count(*)::double, 4) as mismatch_rate from t left join (select c_custkey as k from ({MASTER})) on cust = k)
select n_rows, round(nr, 4) as null_rate, classes, least, mismatch_rate,
  case when n_rows = 0 or not (nr <= 0.25 and valid >= 30) or classes < 2 or least < 3 or mismatch_rate > 0.2 then 'NO_GO' when least < 10 or mismatch_rate > 0 or nr > 0 then 'WARNING' else 'GO' end as verdict
from a, c, m"""


def verdict(spark, d):
    return audit.feasibility(gaps(spark, d), "priority", "cust", master(spark, d), "c_custkey", most_mismatch=0.2)


@query(_VERDICT)
def feasibility_verdict(spark, d):
    return verdict(spark, d)


@query(f"""with v as ({_VERDICT})
select 'mismatch_rate' as metric, mismatch_rate as measured, 0.1::double as threshold, mismatch_rate <= 0.1 as passes from v union all
select 'null_rate', null_rate, 0.25::double, null_rate <= 0.25 from v union all select 'classes', classes::double, 2::double, classes >= 2 from v union all
select 'least_class', least::double, 10::double, least >= 10 from v""")
def audit_table(spark, d):
    return audit.audit_table(verdict(spark, d))


@query(f"select coalesce(cust::varchar, 'NULL') as code, count(*) as n from ({GAPS}) where cust is null or cust not in ({MASTER}) group by 1")
def code_mismatch_breakdown(spark, d):
    return audit.code_mismatch_breakdown(gaps(spark, d), "cust", master(spark, d), "c_custkey").withColumn("code", F.coalesce(F.col("code").cast("string"), F.lit("NULL")))


@query(f"select coalesce(priority, 'NULL_LABEL') as label, count(*) as n, round(100::double * count(*) / sum(count(*)) over (), 2) as pct from ({GAPS}) group by 1")
def label_distribution(spark, d):
    return audit.label_distribution(gaps(spark, d), "priority")


@query(f"select count(*) as n_rows, count(*) - count(cust) as nulls, round(100::double * (count(*) - count(cust)) / count(*), 4) as null_pct, count(*) filter (where cust is not null and k is null) as unmapped from ({GAPS}) left join (select c_custkey as k from ({MASTER})) on cust = k")
def audit_job(spark, d):
    return audit.audit_master(gaps(spark, d), "cust", master(spark, d), "c_custkey")


@query("select o_custkey, year(o_orderdate)::int as term, count(*) as enrolled, count(*) filter (where p_partkey is null) as orphans from lineitem join orders on l_orderkey = o_orderkey left join (select p_partkey from part where p_partkey % 20 <> 0) on l_partkey = p_partkey group by 1, 2 having orphans > 0")
def audit_course(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("term", F.year("o_orderdate"))
    return audit.audit_orphans(rows, ["o_custkey", "term"], "l_partkey", read(spark, d, "part").where("p_partkey % 20 <> 0"), "p_partkey")


def bought(spark, d):
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("tag", F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")))


_BOUGHT = "(select *, case when p_partkey % 9 = 0 then null else p_type end as tag from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"


@query(f"select p_partkey, count(distinct o_custkey) as members, count(*) filter (where tag is null) as missing_tags from {_BOUGHT} group by 1 having members < 30")
def audit_extracurricular(spark, d):
    return audit.audit_groups(bought(spark, d), ["p_partkey"], "o_custkey", tag="tag", fewer_than=30)


@query(f"select o_orderkey, cust from ({GAPS}) where cust is not null and cust not in ({MASTER})")
def audit_transfer(spark, d):
    return audit.audit_unmatched(gaps(spark, d), "cust", master(spark, d), "c_custkey").select("o_orderkey", "cust")


@query("select count(*) as n_rows, count(*) filter (where toxic = 1) as positives, round(100::double * count(*) filter (where toxic = 1) / count(*), 4) as positive_pct, count(*) filter (where doc_id % 6 = 0) as missing from labels")
def audit_at_risk(spark, d):
    return audit.audit_flag(read(spark, d, "labels").withColumn("attendance", F.when(F.col("doc_id") % 6 != 0, F.col("quality"))), "toxic", "attendance")


@query("select n_name, count(distinct s_suppkey) as members from nation left join supplier on s_nationkey = n_nationkey group by 1 having members < 5")
def audit_module_track(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return audit.audit_groups(rows, ["n_name"], "s_suppkey", fewer_than=5)


@query("select p_brand, count(distinct p_type) as members from part group by 1")
def audit_micro_degree(spark, d):
    return audit.audit_groups(read(spark, d, "part"), ["p_brand"], "p_type")


@query("select s_name, n_name, count(distinct l_orderkey) as members from supplier left join nation on s_nationkey = n_nationkey left join lineitem on l_suppkey = s_suppkey group by 1, 2 having members >= 1")
def audit_hiring(spark, d):
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(read(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return audit.audit_groups(rows, ["s_name", "n_name"], "l_orderkey", at_least=1)


@query("select count(*) as n_rows, round(avg(length(text)), 4) as mean_length, count(*) filter (where text is null or length(text) < 50) as too_short, round(100::double * count(*) filter (where text is null or length(text) < 50) / count(*), 4) as short_pct from documents")
def audit_review_text(spark, d):
    return audit.audit_text(read(spark, d, "documents"), "text")


@query("select o_orderstatus as label, count(*) as n, round(100::double * count(*) / (select count(*) from orders), 2) as pct from orders group by 1")
def audit_generic_class(spark, d):
    return audit.label_distribution(read(spark, d, "orders"), "o_orderstatus")


@query("select l_partkey, count(distinct o_custkey) as members from lineitem join orders on l_orderkey = o_orderkey group by 1 having members < 20")
def audit_generic_rec(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return audit.audit_groups(rows, ["l_partkey"], "o_custkey", fewer_than=20)


@query(f"select count(*) as n_rows, count(*) - count(price) as missing, round(100::double * (count(*) - count(price)) / count(*), 4) as missing_pct from ({GAPS})")
def audit_default(spark, d):
    return audit.audit_default(gaps(spark, d), "price")


# -- marts ------------------------------------------------------------------------------


@query("select parent_rows, parent_keys, orphan_rows, parent_rows = parent_keys and orphan_rows = 0 as is_relation from (select count(*) as parent_rows, count(distinct c_custkey) as parent_keys from customer), (select count(*) as orphan_rows from orders where o_custkey not in (select c_custkey from customer))")
def key_containment(spark, d):
    return mart.key_containment(read(spark, d, "customer"), "c_custkey", read(spark, d, "orders"), "o_custkey")


_AGG = "count(*) as {p}_count, round(sum({n}), 2) as {p}_sum, round(avg({n}), 6) as {p}_mean, max({n}) as {p}_max, count(distinct {c}) as {p}_nunique"


def _rounded(df, p, n, c):
    return df.select("*", F.round(f"{p}_{n}_sum", 2).alias(f"{p}_sum"), F.round(f"{p}_{n}_mean", 6).alias(f"{p}_mean"), F.col(f"{p}_{n}_max").alias(f"{p}_max"), F.col(f"{p}_{c}_nunique").alias(f"{p}_nunique")).drop(f"{p}_{n}_sum", f"{p}_{n}_mean", f"{p}_{n}_max", f"{p}_{c}_nunique")


@query(f"select o_custkey, {_AGG.format(p='ord', n='o_totalprice', c='o_orderstatus')} from orders group by 1")
def child_agg(spark, d):
    made = mart.child_agg(read(spark, d, "orders"), "o_custkey", "ord", ["o_totalprice"], ["o_orderstatus"]).withColumnRenamed("__key", "o_custkey")
    return _rounded(made, "ord", "o_totalprice", "o_orderstatus")


_ZERO = "coalesce({p}_count, 0) as {p}_count, coalesce({p}_sum, 0) as {p}_sum, coalesce({p}_mean, 0) as {p}_mean, coalesce({p}_max, 0) as {p}_max, coalesce({p}_nunique, 0) as {p}_nunique"


@query(f"select c_custkey, c_mktsegment, {_ZERO.format(p='ord')} from customer left join (select o_custkey, {_AGG.format(p='ord', n='o_totalprice', c='o_orderstatus')} from orders group by 1) on c_custkey = o_custkey")
def feature_mart(spark, d):
    made = mart.feature_mart(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", [(read(spark, d, "orders"), "o_custkey", "ord", ["o_totalprice"], ["o_orderstatus"])])
    return _rounded(made, "ord", "o_totalprice", "o_orderstatus")


@query(f"select c_custkey, {_ZERO.format(p='ord')}, {_ZERO.format(p='ev').replace('coalesce(ev_mean, 0) as ev_mean, ', '')} from customer left join (select o_custkey, {_AGG.format(p='ord', n='o_totalprice', c='o_orderstatus')} from orders group by 1) on c_custkey = o_custkey left join (select user_id, {_AGG.format(p='ev', n='value', c='event_type')} from events group by 1) on c_custkey = user_id")
def multi_child_mart(spark, d):
    children = [(read(spark, d, "orders"), "o_custkey", "ord", ["o_totalprice"], ["o_orderstatus"]), (read(spark, d, "events"), "user_id", "ev", ["value"], ["event_type"])]
    made = mart.feature_mart(read(spark, d, "customer").select("c_custkey"), "c_custkey", children)
    return _rounded(_rounded(made, "ord", "o_totalprice", "o_orderstatus"), "ev", "value", "event_type").drop("ev_mean")
