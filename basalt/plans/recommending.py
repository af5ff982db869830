"""Queries of the recommendation and rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import split_items as split
from ..operators import recommend
from .registry import query, read

ITEMS = "select o_custkey as \"user\", c_mktsegment as target, p_brand as item, o_orderpriority as prio, c_nationkey as nat, year(o_orderdate) as yr from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey"


def items(spark, d):
    df = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    df = df.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.select(F.col("o_custkey").alias("user"), F.col("c_mktsegment").alias("target"), F.col("p_brand").alias("item"), F.col("o_orderpriority").alias("prio"), F.col("c_nationkey").alias("nat"), F.year("o_orderdate").alias("yr"))


def profile(spark, d, item="item"):
    return recommend.pathway_profile(items(spark, d).select("target", F.col("user").alias("entity"), F.col(item).alias("item")))


def _prof(item="item"):
    return f"select target, item, n, size, n / size::double as coverage from (select target, {item} as item, count(distinct \"user\") as n from i group by 1, 2) join (select target, count(distinct \"user\") as size from i group by 1) using (target)"


def _tops(item, k):
    return f"select * from (select *, row_number() over (partition by target order by n desc, item) as place from ({_prof(item)})) where place <= {k}"


WITH = f"with i as ({ITEMS}) "


@query("select p_partkey, list_filter(list_transform(string_split(s, sep), lambda x: trim(x)), lambda x: x <> '') as items from (select p_partkey, s, case when contains(s, ',') then ',' when contains(s, ';') then ';' when contains(s, '|') then '|' when contains(s, '/') then '/' else chr(1) end as sep from (select p_partkey, replace(p_name || ' ' || p_brand || ' x', ' ', case p_partkey % 4 when 0 then ', ' when 1 then ';' when 2 then ' | ' else '/' end) as s from part))")
def split_items(spark, d):
    sep = F.when(F.col("p_partkey") % 4 == 0, ", ").when(F.col("p_partkey") % 4 == 1, ";").when(F.col("p_partkey") % 4 == 2, " | ").otherwise("/")
    return read(spark, d, "part").select("p_partkey", split(F.replace(F.concat_ws(" ", "p_name", "p_brand", F.lit("x")), F.lit(" "), sep)).alias("items"))


@query(WITH + f"select target, item, n, size, round(coverage, 6) as coverage from ({_prof()})")
def pathway_profile(spark, d):
    return profile(spark, d).withColumn("coverage", F.round("coverage", 6))


@query(WITH + 'select "user", count(distinct item) as n_items, count(distinct item) < 15 as is_cold, greatest(15 - count(distinct item), 0) as shortfall from i group by 1')
def cold_start(spark, d):
    return recommend.cold_start(items(spark, d), 15)


@query(WITH + f', cold as (select "user" from i group by 1 having count(distinct item) < 15), o as (select target, item from ({_tops("item", 2)}) join (select target from (select distinct target from i) order by 1 limit 3) using (target)) select "user", item, target from cold, o where ("user", item) not in (select "user", item from i)')
def guidance_items(spark, d):
    own = items(spark, d)
    return recommend.guidance_items(recommend.cold_start(own, 15).where("is_cold"), own, profile(spark, d))


@query(WITH + f""", t as ({_tops("item", 5)}), s as ({_tops("prio", 3)}), g as (select distinct "user", nat < 12 as grp from i), w as (select target, sum(coverage) as w from t group by 1), k as (select target, count(*) as k from s group by 1),
h as (select "user", t.target, sum(coverage) as hit from (select distinct "user", item from i) join t using (item) group by 1, 2),
h2 as (select "user", s.target, count(*) as second from (select distinct "user", prio as item from i) join s using (item) group by 1, 2)
select "user", target, round(0.6::double * coalesce(hit, 0) / w + 0.25::double * coalesce(second, 0) / k + 0.15::double * case when grp then 1 else 0.5::double end, 6) as score
from g cross join w join k using (target) left join h using ("user", target) left join h2 using ("user", target)""")
def pathway_match(spark, d):
    own = items(spark, d)
    groups = own.select("user", (F.col("nat") < 12).alias("group")).distinct()
    made = recommend.pathway_match(own, own.select("user", F.col("prio").alias("item")), groups, profile(spark, d), profile(spark, d, "prio"))
    return made.withColumn("score", F.round("score", 6))


@query(WITH + f', t as ({_tops("item", 5)}), m as (select g."user", g.target, t.item, t.place from (select distinct "user", target from i) g join t using (target) where (g."user", t.item) not in (select "user", item from i)) select * from (select "user", target, item, row_number() over (partition by "user", target order by place)::int as step from m) where step <= 2')
def next_nodes(spark, d):
    own = items(spark, d)
    return recommend.next_nodes(own, own.select("user", "target").distinct(), profile(spark, d))


@query("with y as (select o_orderkey, year(o_orderdate)::int as yr from orders), m as (select max(yr) as top from y) select o_orderkey, yr from y, m where yr >= 2022 - 1 or (select count(*) from y where yr >= 2022 - 1) = 0")
def recency_filter(spark, d):
    return recommend.recency_filter(read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr")), "yr", 2022, 1)


def weights(spark, d):
    docs = read(spark, d, "documents")
    counts = recommend.token_counts(docs, "doc_id", "text").persist()  # texts are split once
    return counts, recommend.idf(counts, docs.agg(F.count("*").alias("docs"))).persist()


_TOK = "select {k} as id, unnest(regexp_extract_all(lower(text), '[\\w-]+')) as token from {t}"
_TFIDF = "d as (" + _TOK.format(k="doc_id", t="documents") + "), c as (select id, token, count(*) as tf from d group by 1, 2), w as (select token, ln((1 + (select count(*) from documents)) / (1 + count(*))::double) + 1 as idf from c group by 1), r as (select id, token, tf * idf as w from c join w using (token)), v as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as weight from r)"


@query(f"with {_TFIDF} select id, token, round(weight, 6) as weight from v")
def tfidf(spark, d):
    return recommend.tfidf(*weights(spark, d)).withColumn("weight", F.round("weight", 6))


def neighbours(spark, d):
    counts, idf = weights(spark, d)
    own = recommend.token_counts(read(spark, d, "benchmark"), "item_id", "text").persist()
    asked = recommend.tfidf(own, recommend.weights_of(idf, own))
    return recommend.cosine_topk(asked, recommend.tfidf(counts, idf, tokens=own))


_NEAR = f"{_TFIDF}, q as (" + _TOK.format(k="item_id", t="benchmark") + "), qr as (select q.id, token, count(*) * any_value(idf) as w from q join w using (token) group by 1, 2), qv as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as weight from qr), s as (select qv.id as query, v.id, round(sum(qv.weight * v.weight), 9) as sim from qv join v using (token) group by 1, 2), n as (select * from (select *, row_number() over (partition by query order by sim desc, id)::int as place from s) where place <= 5)"


@query(f"with {_NEAR} select query, id, round(sim, 6) as sim, place from n")
def cosine_topk(spark, d):
    return neighbours(spark, d).withColumn("sim", F.round("sim", 6))


@query(f"with {_NEAR}, o as (select query as \"user\", source as outcome, sum(sim) as t, count(*) as n, avg(sim) as m from n join documents on id = doc_id where source <> 'src0' group by 1, 2) select \"user\", outcome, n, round(least(0.4::double * t / greatest(sum(t) over (partition by \"user\"), 1) + 0.6::double * m, 1), 6) as score from o")
def weighted_vote(spark, d):
    near = neighbours(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("source") != "src0", F.col("source")).otherwise("UNKNOWN").alias("outcome")), "id")
    return recommend.weighted_vote(near.withColumnRenamed("query", "user")).select("user", "outcome", "n", F.round("score", 6).alias("score"))


_PAL = "select distinct a.\"user\" as \"user\", b.\"user\" as id from (select distinct \"user\", nat, prio from i where yr % 2 = 0) a join (select distinct \"user\", nat, prio from i where yr % 2 = 1) b on a.nat = b.nat and a.prio = b.prio and a.\"user\" <> b.\"user\""


@query(WITH + f', p as ({_PAL}), c as (select p."user", item, count(*) as holders from p join (select distinct "user" as id, item from i) using (id) where (p."user", item) not in (select "user", item from i) group by 1, 2) select * from (select *, row_number() over (partition by "user" order by holders desc, item)::int as place from c) where place <= 2')
def neighbour_items(spark, d):
    own = items(spark, d)
    keyed = lambda years, name: own.where(years).select(F.col("user").alias(name), F.concat_ws("|", "nat", "prio").alias("key"))
    return recommend.shared_key_items(keyed("yr % 2 = 0", "user"), keyed("yr % 2 = 1", "id"), own.select(F.col("user").alias("id"), "item"), own)


@query(WITH + 'select * from (select nat as "group", item, count(*) as n, row_number() over (partition by nat order by count(*) desc, item)::int as place from i group by 1, 2) where place <= 3')
def popular_items(spark, d):
    return recommend.popular_items(items(spark, d), "nat", "item")


def signals(spark, d):
    b = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_linenumber").alias("item"), "l_quantity", "l_discount", "l_tax", "l_returnflag")
    one = lambda c, where: b.where(where).groupBy("user", "item").agg(F.round(F.avg(c), 6).alias("value"))
    return {"ml": one(F.col("l_quantity") / 50, "l_returnflag = 'A'"), "tree": one(F.col("l_discount") * 5, "l_returnflag = 'N'"), "persona": one(F.col("l_tax") * 5, "l_returnflag = 'R'"), "popularity": one(F.col("l_quantity") / 60, "user % 3 = 0")}


def _sig(name, expr, where):
    return f"{name}_s as (select l_suppkey as \"user\", l_linenumber as item, round(avg({expr}), 6) as {name} from lineitem where {where} group by 1, 2)"


_HYB = "with " + ", ".join((_sig("ml", "l_quantity / 50", "l_returnflag = 'A'"), _sig("tree", "l_discount * 5", "l_returnflag = 'N'"), _sig("persona", "l_tax * 5", "l_returnflag = 'R'"), _sig("popularity", "l_quantity / 60", "l_suppkey % 3 = 0"))) + ", j as (select \"user\", item, coalesce(ml, 0) as ml, coalesce(tree, 0) as tree, coalesce(persona, 0) as persona, coalesce(popularity, 0.5) as popularity from ml_s full join tree_s using (\"user\", item) full join persona_s using (\"user\", item) full join popularity_s using (\"user\", item)), s as (select *, 0.35::double * ml + 0.30::double * tree + 0.20::double * persona + 0.15::double * popularity as score from j), k as (select * from (select *, row_number() over (partition by \"user\" order by round(score, 9) desc, item)::int as rank from s) where rank <= 5) "


@query(_HYB + 'select "user", item, rank, round(score, 8) as score from k')
def hybrid_score(spark, d):
    return recommend.hybrid_score(signals(spark, d)).select("user", "item", "rank", F.round("score", 8).alias("score"))


@query(_HYB + 'select "user", item, ' + ", ".join(f"round(case when score > 0 then 100 * {w}::double * {n} / score else 25 end, 3) as {n}_pct" for n, w in recommend.WEIGHTS.items()) + " from k")
def hybrid_attribution(spark, d):
    return recommend.hybrid_score(signals(spark, d)).select("user", "item", *[F.round(f"{n}_pct", 3).alias(f"{n}_pct") for n in recommend.WEIGHTS])


# Items are brands; brand n needs brand n - 1 of the same maker; the last digit gives the type.
_BRANDS = "(select distinct p_brand as item from part)"
_PRE = f"(select item, 'Brand#' || (substr(item, 7)::int - 1)::varchar as needs from {_BRANDS} where substr(item, 7)::int % 10 > 1)"
_DONE = '(select distinct "user", item from i where yr % 2 = 0)'
_CAND = '(select distinct "user", item from i where yr % 2 = 1)'


def brand_tables(spark, d):
    brands = read(spark, d, "part").select(F.col("p_brand").alias("item")).distinct()
    n = F.substring("item", 7, 9).cast("int")
    pre = brands.where(n % 10 > 1).select("item", F.concat(F.lit("Brand#"), (n - 1).cast("string")).alias("needs"))
    own = items(spark, d)
    return brands, pre, own.where("yr % 2 = 0").select("user", "item").distinct(), own.where("yr % 2 = 1").select("user", "item").distinct()


@query(WITH + f', l as (select c."user", c.item, p.needs from {_CAND} c join {_PRE} p using (item) where (c."user", p.needs) not in (select "user", item from {_DONE})), m as (select "user", item, string_agg(distinct needs, \',\' order by needs) as missing from l group by 1, 2) select "user", item, m.missing is null as eligible, coalesce(m.missing, \'\') as missing from {_CAND} left join m using ("user", item)')
def prereq_check(spark, d):
    _, pre, done, cand = brand_tables(spark, d)
    return recommend.prereq_check(cand, pre, done)


@query(WITH + f', o as (select "user", item, substr(item, 7)::int % 2 = 0 as is_mandatory, length(item) + substr(item, 7)::int as rank from {_CAND}), w as (select *, row_number() over (partition by "user", is_mandatory order by rank, item) as w from o) select "user", item, is_mandatory, place from (select *, row_number() over (partition by "user" order by is_mandatory desc, rank, item)::int as place from w where not is_mandatory or w <= 2) where place <= 5')
def mandatory_first(spark, d):
    cand = brand_tables(spark, d)[3]
    n = F.substring("item", 7, 9).cast("int")
    return recommend.mandatory_first(cand.select("user", "item", (n % 2 == 0).alias("is_mandatory"), (F.length("item") + n).alias("rank")))


@query(WITH + f', e as (select "user", item, 1 as done from {_DONE} union all select "user", item, 0 from {_CAND}), t as (select "user", case when substr(item, 7)::int % 2 = 0 then \'core\' else \'elective\' end as type, (substr(item, 7)::int % 3 + 1) as credits, done from e), g as (select "user", type, sum(case when done = 1 then credits else 0 end)::bigint as completed, sum(case when done = 0 then credits else 0 end)::bigint as planned from t group by 1, 2) select "user", type, completed, planned, completed + planned as projected, round(least(100, 100 * (completed + planned) / (case when type = \'core\' then 12 else 9 end)::double), 2) as pct, completed + planned >= case when type = \'core\' then 12 else 9 end as is_safe from g')
def credit_simulation(spark, d):
    brands, _, done, cand = brand_tables(spark, d)
    n = F.substring("item", 7, 9).cast("int")
    types = brands.select("item", F.when(n % 2 == 0, "core").otherwise("elective").alias("type"), (n % 3 + 1).alias("credits"))
    return recommend.credit_simulation(done, cand, types, spark.createDataFrame([("core", 12), ("elective", 9)], "type string, needed int"))


@query("select l_orderkey, l_linenumber, case when l_quantity < 5 then 'stock' when l_discount > 0.07 then 'discount' else 'ok' end as shop, case when l_tax > 0.05 then 'debt ratio' when l_quantity * 30 < 600 then 'credit score' else 'ok' end as bank from lineitem")
def guardrails(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("stock_count"), F.when(F.col("l_discount") > 0.07, 0.31).otherwise(0.1).alias("discount_rate"), F.when(F.col("l_tax") > 0.05, 0.41).otherwise(0.1).alias("dsr_ratio"), (F.col("l_quantity") * 30).alias("credit_score"))
    shop = recommend.guardrails(df, "ecommerce").drop("allowed").withColumnRenamed("reason", "shop")
    return recommend.guardrails(shop, "fintech").select("l_orderkey", "l_linenumber", "shop", F.col("reason").alias("bank"))


_RISK = "(select l_orderkey, l_linenumber, l_quantity / 50 as risk from lineitem)"


def risks(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("risk"))


@query(f"select l_orderkey, l_linenumber, case when risk >= 0.7 then 'HIGH' when risk >= 0.4 then 'MEDIUM' else 'LOW' end as tier, case when risk >= 0.7 then 'call' when risk >= 0.4 then 'mail' else 'watch' end as action from {_RISK}")
def prescription_tier(spark, d):
    actions = spark.createDataFrame([("HIGH", "call"), ("MEDIUM", "mail"), ("LOW", "watch")], "tier string, action string")
    return recommend.prescription_tier(risks(spark, d), "risk", actions).select("l_orderkey", "l_linenumber", "tier", "action")


@query(f"select l_orderkey, l_linenumber, case when risk >= 0.65 then 'URGENT' when risk >= 0.25 then 'CARE' else 'STABLE' end as care, case when l_linenumber % 3 = 0 then 'none' else 'line' || l_linenumber::varchar end as primary_factor from {_RISK}")
def care_prescription(spark, d):
    df = risks(spark, d).withColumn("f", F.when(F.col("l_linenumber") % 3 != 0, F.array(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")))).otherwise(F.array().cast("array<string>")))
    return recommend.care_prescription(df, "risk", "f").select("l_orderkey", "l_linenumber", "care", "primary_factor")


@query("select p_brand, p_type, 'default' as rule from (select distinct p_brand, p_type from part where p_size <= 25) where (p_brand, p_type) not in (select p_brand, p_type from part where p_size > 25) union all select distinct p_brand, p_type, 'override' from part where p_size > 25")
def rule_override(spark, d):
    part = read(spark, d, "part")
    rules = lambda where, name: part.where(where).select("p_brand", "p_type").distinct().withColumn("rule", F.lit(name))
    return recommend.rule_override(rules("p_size <= 25", "default"), rules("p_size > 25", "override"), ["p_brand", "p_type"])


@query("select doc_id, quality, p.pred, quality = p.pred as is_match from labels join (select doc_id, (n_chars > 100)::int as pred from documents) p using (doc_id)")
def label_vs_prediction(spark, d):
    pred = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 100).cast("int").alias("pred"))
    return recommend.label_vs_prediction(read(spark, d, "labels").select("doc_id", "quality"), pred, "doc_id", "quality", "pred")
