"""Feasibility audits: code integrity, target completeness, class sufficiency, verdicts, preset audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pct(n, total):
    return F.round(100 * n / F.greatest(total, F.lit(1)), 4)


def code_integrity(df: DataFrame, code: str, master: DataFrame, master_code: str, examples: int = 5) -> DataFrame:
    """Rows whose trimmed code is null or not in the master, with the first few such codes."""
    own = F.trim(F.col(code).cast("string"))
    known = master.select(F.trim(F.col(master_code).cast("string")).alias("k")).distinct()
    joined = df.select(own.alias("c")).groupBy("c").count().join(known, F.col("c") == F.col("k"), "left")
    bad = joined.groupBy(F.col("k").isNull().alias("bad")).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("c").isNull(), F.col("count")).otherwise(0)).alias("nulls"))
    totals = bad.agg(F.sum("n").alias("n_rows"), F.sum("nulls").alias("null_codes"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("mismatch"))
    first = joined.where("k is null and c is not null").select("c").orderBy("c").limit(examples).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("examples"))
    return totals.join(first, how="cross").select("n_rows", "null_codes", "mismatch", F.round(F.col("mismatch") / F.col("n_rows"), 4).alias("mismatch_rate"), F.when(F.col("mismatch") > 0, F.col("examples")).alias("examples"))  # one row each


def target_completeness(df: DataFrame, target: str, most_null: float = 0.25, least_valid: int = 30) -> DataFrame:
    row = df.agg(F.count("*").alias("n_rows"), F.count(target).alias("valid"))
    null = F.col("n_rows") - F.col("valid")
    rate = null / F.greatest("n_rows", F.lit(1))
    return row.select("n_rows", "valid", null.alias("nulls"), F.round(rate, 4).alias("null_rate"), ((rate <= most_null) & (F.col("valid") >= least_valid)).alias("passes"))


#: Thin classes that are named, in their order.
MOST_NAMED = 1000


def class_sufficiency(df: DataFrame, target: str, fail: int = 3, warn: int = 10) -> DataFrame:
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("c")).agg(F.count("*").alias("n"))
    row = counted.agg(F.count("*").alias("classes"), F.coalesce(F.min("n"), F.lit(0)).alias("least"))
    first = counted.where(F.col("n") < warn).orderBy("c").limit(MOST_NAMED).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("thin_classes"))
    row = row.join(first, how="cross")  # a row each
    return row.withColumn("status", F.when((F.col("classes") < 2) | (F.col("least") < fail), "FAIL").when(F.col("least") < warn, "WARN").otherwise("PASS"))


def feasibility(df: DataFrame, target: str, code: str | None = None, master: DataFrame | None = None, master_code: str | None = None, most_mismatch: float = 0.1) -> DataFrame:
    """The metrics of all three audits in one row, and NO_GO, WARNING or GO."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([("NO_GO", "missing target column")], "verdict string, reason string")
    out = target_completeness(df, target).select("n_rows", "null_rate", "passes").join(class_sufficiency(df, target).select("classes", "least", "status"), how="cross")
    rate = code_integrity(df, code, master, master_code).select("mismatch_rate") if code else df.sparkSession.range(1).select(F.lit(0.0).alias("mismatch_rate"))
    out = out.join(rate, how="cross")
    bad = (F.col("n_rows") == 0) | ~F.col("passes") | (F.col("status") == "FAIL") | (F.col("mismatch_rate") > most_mismatch)
    warn = (F.col("status") == "WARN") | (F.col("mismatch_rate") > 0) | (F.col("null_rate") > 0)
    return out.select("n_rows", "null_rate", "classes", "least", F.coalesce("mismatch_rate", F.lit(0.0)).alias("mismatch_rate"), F.when(bad, "NO_GO").when(warn, "WARNING").otherwise("GO").alias("verdict"))


def audit_table(metrics: DataFrame) -> DataFrame:
    """The verdict's metrics as four rows."""
    rows = [("mismatch_rate", F.col("mismatch_rate"), 0.1, F.col("mismatch_rate") <= 0.1), ("null_rate", F.col("null_rate"), 0.25, F.col("null_rate") <= 0.25), ("classes", F.col("classes").cast("double"), 2.0, F.col("classes") >= 2), ("least_class", F.col("least").cast("double"), 10.0, F.col("least") >= 10)]
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("measured"), F.lit(t).alias("threshold"), ok.alias("passes")) for n, v, t, ok in rows])).alias("r")).select("r.*")


def code_mismatch_breakdown(df: DataFrame, code: str, master: DataFrame, master_code: str) -> DataFrame:
    """Rows of each trimmed code that is not in the master; null is such a code."""
    known = master.select(F.trim(F.col(master_code).cast("string")).alias("k")).distinct()
    return df.groupBy(F.trim(F.col(code).cast("string")).alias("code")).agg(F.count("*").alias("n")).join(known, F.col("code") == F.col("k"), "left_anti")


def label_distribution(df: DataFrame, target: str) -> DataFrame:
    counted = df.groupBy(F.coalesce(F.col(target).cast("string"), F.lit("NULL_LABEL")).alias("label")).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


# -- preset audits ----------------------------------------------------------------------


def audit_master(df: DataFrame, code: str, master: DataFrame, master_code: str) -> DataFrame:
    """Rows, null codes and codes without a master row."""
    joined = df.select(F.col(code).alias("c")).join(master.select(F.col(master_code).alias("k")).distinct(), F.col("c") == F.col("k"), "left")
    null, lost = F.count_if(F.col("c").isNull()), F.count_if(F.col("c").isNotNull() & F.col("k").isNull())
    return joined.agg(F.count("*").alias("n_rows"), null.alias("nulls"), _pct(null, F.count("*")).alias("null_pct"), lost.alias("unmapped"))


def audit_orphans(df: DataFrame, keys: list[str], code: str, master: DataFrame, master_code: str) -> DataFrame:
    """For each key: rows and orphan codes, where there are any."""
    joined = df.join(master.select(F.col(master_code).alias("k")).distinct(), F.col(code) == F.col("k"), "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("enrolled"), F.count_if(F.col("k").isNull()).alias("orphans")).where("orphans > 0")


def audit_groups(df: DataFrame, keys: list[str], member: str, tag: str | None = None, fewer_than: int | None = None, at_least: int | None = None) -> DataFrame:
    """Distinct members of each group and missing tags; groups below or from a size on."""
    aggs = [F.countDistinct(member).alias("members")] + ([F.count_if(F.col(tag).isNull()).alias("missing_tags")] if tag else [])
    out = df.groupBy(*keys).agg(*aggs)
    out = out.where(F.col("members") < fewer_than) if fewer_than is not None else out
    return out.where(F.col("members") >= at_least) if at_least is not None else out


def audit_unmatched(df: DataFrame, code: str, master: DataFrame, master_code: str) -> DataFrame:
    return df.where(F.col(code).isNotNull()).join(master.select(F.col(master_code).alias("k")).distinct(), F.col(code) == F.col("k"), "left_anti")


def audit_flag(df: DataFrame, flag: str, needed: str) -> DataFrame:
    yes = F.count_if(F.col(flag) == 1)
    return df.agg(F.count("*").alias("n_rows"), yes.alias("positives"), _pct(yes, F.count("*")).alias("positive_pct"), F.count_if(F.col(needed).isNull()).alias("missing"))


def audit_text(df: DataFrame, text: str, least: int = 50) -> DataFrame:
    short = F.count_if(F.col(text).isNull() | (F.length(text) < least))
    return df.agg(F.count("*").alias("n_rows"), F.round(F.avg(F.length(text)), 4).alias("mean_length"), short.alias("too_short"), _pct(short, F.count("*")).alias("short_pct"))


def audit_default(df: DataFrame, target: str) -> DataFrame:
    null = F.count_if(F.col(target).isNull())
    return df.agg(F.count("*").alias("n_rows"), null.alias("missing"), _pct(null, F.count("*")).alias("missing_pct"))


@dataclass(frozen=True)
class Preset:
    name: str
    category: str
    task: str
    target: str
    most_mismatch: float = 0.1


#: The task presets: nine for education, two general ones.
PRESETS = [
    Preset("job", "education", "recommendation", "target_job_code"),
    Preset("course", "education", "recommendation", "course_code"),
    Preset("extracurricular", "education", "recommendation", "program_code"),
    Preset("transfer", "education", "multiclass", "transfer_code"),
    Preset("at_risk", "education", "binary", "is_academic_probation"),
    Preset("module_track", "education", "recommendation", "module_code"),
    Preset("micro_degree", "education", "recommendation", "degree_code"),
    Preset("hiring_company", "education", "recommendation", "company_code"),
    Preset("review_text", "education", "multiclass", "sentiment"),
    Preset("classification", "generic", "multiclass", "target"),
    Preset("recommendation", "generic", "recommendation", "item_id"),
]


def preset_catalog(spark, category: str | None = None) -> DataFrame:
    rows = [(p.name, p.category, p.task, p.target, p.most_mismatch) for p in PRESETS if category in (None, p.category)]
    return spark.createDataFrame(rows, "preset string, category string, task string, target string, most_mismatch double")


def model_gate(runs: DataFrame) -> DataFrame:
    """Go or no-go for runs (task, score, lift_global, lift_segment, overfit_gap, sparsity), with triggers."""
    floor = F.when(F.col("task") == "regression", 0.10).otherwise(0.58)
    checks = [("MARGINAL_LIFT", (F.col("lift_global") < 5) & (F.col("lift_segment") < 5)), ("HIGH_OVERFITTING", F.col("overfit_gap") > 0.15), ("SIGNAL_DEFICIENCY", F.col("score") < floor), ("HIGH_SPARSITY", F.col("sparsity") > 35)]
    triggers = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda t: t.isNotNull())
    hard = F.array_contains(triggers, "SIGNAL_DEFICIENCY") | (F.size(triggers) >= 2)
    return runs.withColumn("triggers", triggers).withColumn("verdict", F.when(hard, "NO_GO_PIVOT").when(F.size(triggers) > 0, "CONDITIONAL_GO").otherwise("GO"))
