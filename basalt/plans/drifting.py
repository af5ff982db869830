"""Queries of scoring, drift and alert operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import exact_quantiles
from ..operators import drift
from ..sources import read_stream, work_folder
from ..streaming import LatestDrift, latest
from .registry import query, read

_RISK = "(select event_id, least(1, round(value / (select quantile_cont(value, 0.9) from events), 4)) as risk, value from events)"


def risks(spark, d):
    df = read(spark, d, "events")
    return df.withColumn("q", F.lit(exact_quantiles(df, ["value"], [0.9])["value"][0])).select("event_id", F.least(F.lit(1.0), F.round(F.col("value") / F.col("q"), 4)).alias("risk"), "value")


_TIER = "case when risk >= 0.7 then 'HIGH' when risk >= 0.4 then 'MEDIUM' else 'NORMAL' end"


@query(f"select event_id, {_TIER} as tier from {_RISK}")
def risk_tier(spark, d):
    return drift.risk_tier(risks(spark, d), "risk").select("event_id", "tier")


@query(f"select {_TIER} as tier, count(*) as n from {_RISK} group by 1")
def tier_counts(spark, d):
    return drift.tier_counts(drift.risk_tier(risks(spark, d), "risk"))


@query(f"select event_id, row_number() over (order by risk desc, event_id) as risk_rank, round(100::double * row_number() over (order by risk desc, event_id) / count(*) over (), 4) as percentile from {_RISK}")
def risk_rank(spark, d):
    return drift.risk_rank(risks(spark, d), "risk", "event_id").select("event_id", "risk_rank", "percentile")


# Baseline: the first half of the events by time; current: the rest, with values stretched.
_HALF = "(select quantile_cont(epoch_us(ts), 0.5) from events)"
_B, _C = f"(select * from events where epoch_us(ts) <= {_HALF})", f"(select * replace (value * 1.3 as value) from events where epoch_us(ts) > {_HALF})"
_EDGES = ", ".join(str(i / 8) for i in range(1, 8))
_E = f"(select list_distinct(quantile_cont(value, [{_EDGES}])) from {_B})"


def halves(spark, d):
    df = read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    df = df.withColumn("half", F.lit(exact_quantiles(df, ["us"], [0.5])["us"][0]))
    return df.where("us <= half").drop("us", "half"), df.where("us > half").drop("us", "half").withColumn("value", F.col("value") * 1.3)


def _bins(t):
    return f"(select len(list_filter({_E}, lambda e: e < value))::int as bin, count(*) as n from {t} group by 1)"


def _grid(t):
    return f"(select g.bin, coalesce(n, 0) as n from (select unnest(range(8))::int as bin) g left join {_bins(t)} using (bin))"


@query(f"select 'value' as feature, bin, n, round((n + 0.5::double) / (sum(n) over () + 4), 6) as share from {_grid(_B)}")
def drift_baseline(spark, d):
    base, _ = halves(spark, d)
    return drift.smoothed(drift.numeric_bins(base, ["value"], drift.numeric_edges(base, ["value"]))).withColumn("share", F.round("share", 6))


def _cat(t):
    return f"(select event_type as bin, count(*) as n from {t} group by 1)"


@query(f"select 'event_type' as feature, bin, n, round((n + 0.5::double) / (sum(n) over () + 0.5::double * count(*) over ()), 6) as share from {_cat(_B)}")
def drift_baseline_cat(spark, d):
    base, _ = halves(spark, d)
    return drift.smoothed(drift.category_counts(base, ["event_type"])).withColumn("share", F.round("share", 6))


def _psi(name, a, b):
    return f"select '{name}' as feature, round(sum((q - p) * ln(q / p)), 4) as psi from (select (coalesce(a.n, 0) + 0.5::double) / (sum(coalesce(a.n, 0)) over () + 0.5::double * count(*) over ()) as p, (coalesce(b.n, 0) + 0.5::double) / (sum(coalesce(b.n, 0)) over () + 0.5::double * count(*) over ()) as q from {a} a full join {b} b using (bin))"


def numeric(spark, d):
    base, now = halves(spark, d)
    edges = drift.numeric_edges(base, ["value"])
    return drift.psi(drift.numeric_bins(base, ["value"], edges), drift.numeric_bins(now, ["value"], edges))


def categorical(spark, d, base=None, now=None):
    a, b = halves(spark, d)
    return drift.psi(drift.category_counts(a, ["event_type"]), drift.category_counts((b if now is None else now).where("event_type <> 'purchase'"), ["event_type"]))


_NUM = _psi("value", _grid(_B), _grid(_C))
_CATS = _psi("event_type", _cat(_B), _cat(f"(select * from {_C} where event_type <> 'purchase')"))


@query(_NUM)
def psi_numeric(spark, d):
    return numeric(spark, d)


@query(_CATS)
def psi_categorical(spark, d):
    return categorical(spark, d)


@query(f"with s as ({_NUM} union all {_CATS}) select round(avg(psi), 4) as mean_psi, max(psi) as max_psi, count(*) as features, (select count(*) from {_C}) as n_current, case when max(psi) < 0.1 then 'STABLE' when max(psi) < 0.25 then 'MODERATE' else 'SEVERE' end as verdict from s")
def drift_report(spark, d):
    return drift.drift_report(numeric(spark, d).unionByName(categorical(spark, d)), halves(spark, d)[1].agg(F.count("*").alias("n")))


@query(f"with s as ({_NUM} union all {_CATS}) select feature, psi, case when psi < 0.1 then 'STABLE' when psi < 0.25 then 'MODERATE' else 'SEVERE' end as level from s")
def drift_levels(spark, d):
    return drift.drift_levels(numeric(spark, d).unionByName(categorical(spark, d)))


@query(_psi("value", _grid(_B), _grid("(select * from events order by ts desc, event_id desc limit 1000)")))
def drift_last_n(spark, d):
    base, _ = halves(spark, d)
    edges = drift.numeric_edges(base, ["value"])
    now = drift.last_n(read(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 1000)
    return drift.psi(drift.numeric_bins(base, ["value"], edges), drift.numeric_bins(now, ["value"], edges))


@query(f"select feature, psi, 1000::bigint as n from ({_psi('value', _grid(_B), _grid('(select * from events order by ts desc, event_id desc limit 1000)'))})")
def drift_latest_stream(spark, d):
    """The same from a stream of the events, in as many micro-batches as there are files."""
    base, _ = halves(spark, d)
    edges = drift.numeric_edges(base, ["value"])
    events = read(spark, d, "events")
    monitor = LatestDrift(spark, work_folder(spark, "drift"), ["ts", "event_id"], ["value"], edges, drift.numeric_bins(base, ["value"], edges))
    stream = read_stream(spark, f"{d}/events.parquet", events.schema, maxFilesPerTrigger=1)
    monitor.start(stream.select("ts", "event_id", "value")).awaitTermination()
    return monitor.last()


# Of each kind of event its latest 50, by the hour of the day that they stand for.
_KINDS = "(select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as place from events)"


@query(f"with k as (select * from {_KINDS} where place <= 50), g as (select t.event_type, b.bin, b.n as a from (select distinct event_type from k) t, {_grid(_B)} b), c as (select event_type, len(list_filter({_E}, lambda e: e < value))::int as bin, count(*) as b from k group by 1, 2), s as (select event_type, coalesce(b, 0) as b, (coalesce(b, 0) + 0.5::double) / (sum(coalesce(b, 0)) over (partition by event_type) + 4) as now, (a + 0.5::double) / (sum(a) over (partition by event_type) + 4) as base from g left join c using (event_type, bin)) select event_type, 'value' as feature, round(sum((now - base) * ln(now / base)), 4) as psi, sum(b)::bigint as n from s group by 1")
def drift_latest_by_type(spark, d):
    base, _ = halves(spark, d)
    edges = drift.numeric_edges(base, ["value"])
    monitor = LatestDrift(spark, "", ["ts", "event_id"], ["value"], edges, drift.numeric_bins(base, ["value"], edges), 50, "event_type")
    return monitor.scores(latest(read(spark, d, "events"), ["ts", "event_id"], 50, "event_type"))



@query(f"with s as ({_NUM} union all {_CATS}), t as (select string_agg(feature, ',' order by psi desc, feature) as drifted_features from s) select event_id, risk, case when risk >= 0.7 then 'URGENT' else 'CAUTION' end as level, drifted_features from {_RISK}, t where risk >= 0.4")
def alerts(spark, d):
    return drift.alerts(risks(spark, d), "risk", "event_id", numeric(spark, d).unionByName(categorical(spark, d)))


@query(f"select event_id, risk as probability, {_TIER} as tier, case when risk >= 0.65 then 'URGENT' when risk >= 0.25 then 'CARE' else 'STABLE' end as care, 'value, ' || event_type as top_factors from {_RISK} join (select event_id, event_type from events) using (event_id)")
def care_list(spark, d):
    df = risks(spark, d).join(read(spark, d, "events").select("event_id", "event_type"), "event_id").withColumn("f", F.array(F.lit("value"), F.col("event_type"), F.lit("other")))
    return drift.care_list(df, "event_id", "risk", "f")
