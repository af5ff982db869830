"""Profiling and data quality: all columns in one pass wherever that is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import missing, numeric_columns
from ..functions.ordered import exact_quantiles

# Patterns of personal data, in order of precedence, and the names that hint at them.
PII_PATTERNS = [
    ("KOREAN_RRN", r"\b\d{6}-[1-4]\d{6}\b"),
    ("EMAIL", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("PHONE", r"\b01[016789]-?\d{3,4}-?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
]
PII_NAMES = ("resident", "ssn", "password", "passwd", "pwd", "card", "secret", "token", "rrn", "name")


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text) of several columns, without a job for each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def stack(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """One result row for each dict of expressions over a one-row DataFrame."""
    return df.select(F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])).alias("r")).select("r.*")


def pii_scan(df: DataFrame, columns: list[str], patterns=PII_PATTERNS) -> DataFrame:
    """Rows that match each pattern in each column; ``leading`` marks a column's first pattern that occurs."""
    counted = df.agg(*[F.count_if(F.col(c).rlike(p)).alias(f"{c}__{n}") for c in columns for n, p in patterns])
    rows = [{"column_name": F.lit(c), "pattern": F.lit(n), "place": F.lit(i), "matches": F.col(f"{c}__{n}")} for c in columns for i, (n, _) in enumerate(patterns)]
    found = stack(counted, rows).where("matches > 0")
    return found.withColumn("leading", F.row_number().over(Window.partitionBy("column_name").orderBy("place")) == 1).drop("place")


def pii_by_name(df: DataFrame, names=PII_NAMES) -> list[str]:
    return [c for c in df.columns if any(n in c.lower() for n in names)]


def pii_mask(df: DataFrame, column: str, patterns=PII_PATTERNS, mask: str = "***") -> DataFrame:
    out = F.col(column)
    for _, p in patterns:
        out = F.regexp_replace(out, p, mask)
    return df.withColumn(column, out)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells and duplicate rows (nulls equal), with percentages."""
    nulls = sum((missing(c, df).cast("int") for c in df.columns), F.lit(0))
    whole = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing_cells"))
    copies = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    n = len(df.columns)
    out = whole.join(copies, how="cross")  # one row each
    cells = F.greatest(F.col("n_rows") * n, F.lit(1))
    return out.select("n_rows", F.lit(n).alias("n_cols"), (F.col("n_rows") * n).alias("n_cells"), "missing_cells", F.round(100 * F.col("missing_cells") / cells, 4).alias("missing_pct"), "duplicate_rows", F.round(100 * F.col("duplicate_rows") / F.greatest("n_rows", F.lit(1)), 4).alias("duplicate_pct"))


def health_score(view: DataFrame, n_pii: int) -> DataFrame:
    score = 100 - F.least(F.lit(40.0), 2 * F.col("missing_pct")) - F.least(F.lit(20.0), 4 * F.col("duplicate_pct")) - F.least(F.lit(20.0), F.lit(5.0 * n_pii))
    return view.select(F.round(F.greatest(score, F.lit(0.0)), 4).alias("health_score"))


def health_grade(scores: DataFrame, score: str = "health_score") -> DataFrame:
    s = F.col(score)
    return scores.withColumn("grade", F.when(s >= 85, "A").when(s >= 70, "B").otherwise("C"))


def skew_grade(skew: Column) -> Column:
    return F.when(F.abs(skew) <= 0.5, "symmetric").when(F.abs(skew) <= 1.5, "mildly skewed").otherwise("strongly skewed")


def ks_grade(p: Column) -> Column:
    return F.when(p >= 0.05, "preserved").when(p >= 0.01, "slightly shifted").otherwise("distorted")


def overfit_grade(gap: Column) -> Column:
    return F.when(gap <= 0.05, "best").when(gap <= 0.12, "adequate").otherwise("overfitted")


def column_profile(df: DataFrame) -> DataFrame:
    """Missing and distinct values of every column."""
    agg = df.agg(F.count("*").alias("n"), *[F.count_if(missing(c, df)).alias(f"{c}__m") for c in df.columns], *[F.countDistinct(c).alias(f"{c}__d") for c in df.columns])
    return stack(agg, [{"column_name": F.lit(c), "dtype": F.lit(k), "missing": F.col(f"{c}__m"), "missing_pct": F.round(100 * F.col(f"{c}__m") / F.greatest("n", F.lit(1)), 4), "distinct_values": F.col(f"{c}__d")} for c, k in df.dtypes])


def numeric_summary(df: DataFrame, columns: list[str], relative_error: float | None = None) -> DataFrame:
    """Five numbers, mean and sample deviation; exact percentiles unless an error is given."""
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    if relative_error is None:
        exact = exact_quantiles(df, columns, at)
        q = lambda c: F.lit(exact[c]) if exact[c] else F.lit(None).cast("array<double>")
    else:
        q = lambda c: F.percentile_approx(c, at, int(1 / relative_error))
    agg = df.agg(*[q(c).alias(f"{c}__q") for c in columns], *[F.avg(c).alias(f"{c}__a") for c in columns], *[F.stddev_samp(c).alias(f"{c}__s") for c in columns])
    names = ("min_value", "q1", "median", "q3", "max_value")
    return stack(agg, [{"column_name": F.lit(c), **{n: F.round(F.col(f"{c}__q")[i].cast("double"), 4) for i, n in enumerate(names)}, "mean": F.round(F.col(f"{c}__a"), 4), "std": F.round(F.col(f"{c}__s"), 4)} for c in columns])


def iqr_fences(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    row = exact_quantiles(df, columns, [0.25, 0.75])
    return {c: (row[c][0] - k * (row[c][1] - row[c][0]), row[c][1] + k * (row[c][1] - row[c][0])) for c in columns if row[c] is not None}


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    fences = iqr_fences(df, columns, k)
    agg = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in fences.items()], *[F.count(c).alias(f"{c}__n") for c in fences])
    return stack(agg, [{"column_name": F.lit(c), "outliers": F.col(c), "outlier_pct": F.round(100 * F.col(c) / F.greatest(F.col(f"{c}__n"), F.lit(1)), 4)} for c in fences])


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    agg = df.agg(*[F.skewness(c).alias(c) for c in columns])
    label = lambda s: F.when(F.abs(s) < 0.5, "symmetric").when(s > 0.5, "right").otherwise("left")
    return stack(agg, [{"column_name": F.lit(c), "skew": F.round(F.col(c), 4), "skew_label": label(F.col(c))} for c in columns])


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column (ties by value; null is no value) and their share of all rows."""
    counted = long_form(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    total = counted.groupBy("column_name").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    top = counted.where("value is not null").withColumn("place", place).where(F.col("place") <= k)
    return top.join(F.broadcast(total), "column_name").select("column_name", "value", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"), "place")  # a row for each column


def corr_pairs(df: DataFrame, columns: list[str], least: float = 0.6) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return stack(agg, [{"column_a": F.lit(a), "column_b": F.lit(b), "r": F.round(F.col(f"{a}__{b}"), 4)} for a, b in pairs]).where(F.abs("r") >= least)


def nullity_corr(df: DataFrame, columns: list[str], least: float = 0.4) -> DataFrame:
    flags = df.select(*[missing(c, df).cast("double").alias(c) for c in columns])
    return corr_pairs(flags, columns, least)


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values and the fill that suits their type."""
    numbers = numeric_columns(df)
    return column_profile(df).where("missing > 0").select("column_name", "missing", "missing_pct", F.when(F.col("column_name").isin(numbers), "median").otherwise("mode").alias("fill"))


def data_dna(df: DataFrame, target: str) -> DataFrame:
    """Shape, sparsity and balance of a table in one row."""
    empty = sum((F.coalesce((F.col(c).isNull() | (F.col(c).cast("double") == 0)).cast("int"), F.lit(0)) for c in numeric_columns(df)), F.lit(0))
    n_num = len(numeric_columns(df))
    whole = df.agg(F.count("*").alias("n_rows"), (100 * F.sum(empty) / (F.count("*") * max(1, n_num))).alias("z"))
    classes = df.groupBy(target).count().agg(F.min("count").alias("least"), F.sum("count").alias("every"))
    share = 100 * F.col("least") / F.col("every")
    phase = F.when(F.col("n_rows") < 5000, "small").when(F.col("n_rows") < 50_000, "medium").otherwise("large")
    return whole.join(classes, how="cross").select("n_rows", F.lit(len(df.columns)).alias("n_cols"), F.round(F.col("n_rows") / len(df.columns), 4).alias("rows_per_col"), F.round("z", 4).alias("sparse_pct"), F.round(share, 4).alias("minority_pct"), (share < 10).alias("severe"), phase.alias("phase"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count, share, balanced weight and severity of every class."""
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # over one row for each class
    share = 100 * F.min("n").over(every) / F.sum("n").over(every)
    level = F.when(share >= 40, "BALANCED").when(share >= 20, "MODERATE_IMBALANCE").when(share >= 5, "SEVERE_IMBALANCE").otherwise("EXTREME_IMBALANCE")
    return counted.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 4).alias("weight"), F.round(share, 4).alias("minority_pct"), level.alias("severity"))
