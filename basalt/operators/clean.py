"""Column screening, splitting, imputation, encoding and scaling.

Everything that is fitted is a small dataclass of numbers from the training
rows; applying it is one ``select``, the same for batch and stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import kolmogorov_tail
from ..functions.expressions import bucket, numeric_columns
from ..functions.ordered import exact_quantiles, running_sums
from .profile import long_form, stack


def leak_scan(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Columns of k to 3k values (k: classes, at least 2) whose every value has one target: likely leaks."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p"), F.col(target).alias("y")).select("p.*", "y")
    per_value = long.where("value is not null").groupBy("column_name", "value").agg(F.countDistinct("y").alias("targets"))
    classes = df.agg(F.countDistinct(target).alias("k"))
    out = per_value.groupBy("column_name").agg(F.count("*").alias("distinct_values"), F.max("targets").alias("most_targets")).join(classes, how="cross")
    leak = (F.col("most_targets") == 1) & (F.col("k") > 1) & F.col("distinct_values").between(F.col("k"), 3 * F.col("k"))
    return out.select("column_name", "distinct_values", "most_targets", leak.alias("is_leak"))


# Parts of names that hint at identifiers.
ID_HINTS = ("id", "code", "name", "sn", "num", "token", "key")


def id_scan(df: DataFrame) -> DataFrame:
    """Columns that identify rows: by name and many values, or all values distinct and not floating."""
    agg = df.agg(F.count("*").alias("n"), *[F.countDistinct(f.name).alias(f.name) for f in df.schema])
    rows = []
    for f in df.schema:
        hinted = any(h in f.name.lower() for h in ID_HINTS)
        floating = isinstance(f.dataType, T.DoubleType | T.FloatType | T.DecimalType)
        ratio = F.col(f.name) / F.greatest("n", F.lit(1))
        rows.append({"column_name": F.lit(f.name), "distinct_ratio": F.round(ratio, 4), "is_id": (F.lit(hinted) & (ratio >= 0.5)) | (F.lit(not floating) & (F.col(f.name) == F.col("n")))})
    return stack(agg, rows)


def column_roles(df: DataFrame, target: str, pii: list[str] = ()) -> DataFrame:
    """The role of every column and why; one reason each."""
    ids = {r.column_name for r in id_scan(df).where("is_id").collect()}
    kinds = {f.name: f.dataType for f in df.schema}
    role = lambda c: ("target", "given") if c == target else ("pii", "personal data") if c in pii else ("datetime", "not a feature") if isinstance(kinds[c], T.TimestampType | T.DateType) else ("id", "identifies rows") if c in ids else ("numeric", "number") if c in numeric_columns(df) else ("categorical", "text")
    return df.sparkSession.createDataFrame([(c, *role(c)) for c in df.columns], "column_name string, role string, reason string")


# -- splits -----------------------------------------------------------------------------


def hash_split(df: DataFrame, key: str, percent: int = 80, seed: str = "42") -> DataFrame:
    """``is_train`` by the hash of a row key, or of a group key so that groups stay whole."""
    return df.withColumn("is_train", bucket(key, 100, seed) < percent)


def _placed(df: DataFrame, key: str, by: str, seed: str) -> DataFrame:
    """``df`` with __place, a row's place in its class by the hash of its key, and __total, the class's rows.

    Rows are numbered inside blocks of the hash's first digits; the rows of the
    blocks before come from counts by class and block, so a class of any size is
    dealt to many tasks.
    """
    digits = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    rows = df.withColumns({"__hash": digits, "__block": F.substring(digits, 1, 4)})
    sizes = rows.groupBy(F.col(by).alias("__by"), F.col("__block").alias("__b")).agg(F.count("*").alias("c"))
    of_class = Window.partitionBy("__by")  # at most 65,536 blocks
    before = F.coalesce(F.sum("c").over(of_class.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__by", "__b", before.alias("__before"), F.sum("c").over(of_class).alias("__total"))
    inner = F.row_number().over(Window.partitionBy(by, "__block").orderBy("__hash", key))
    out = rows.withColumn("__inner", inner).join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__b")))
    return out.select(*df.columns, (F.col("__before") + F.col("__inner")).alias("__place"), "__total")


def stratified_split(df: DataFrame, key: str, target: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    return _placed(df, key, target, seed).withColumn("is_train", F.col("__place") <= F.floor(share * F.col("__total"))).drop("__place", "__total")


def kfold(df: DataFrame, key: str, k: int, by: str | None = None, seed: str = "42") -> DataFrame:
    """A ``fold`` for each row; without strata straight from the hash, which needs no sort."""
    if by is None:
        return df.withColumn("fold", bucket(key, k, seed).cast("int"))
    return _placed(df, key, by, seed).withColumn("fold", (F.col("__place") % k).cast("int")).drop("__place", "__total")


# -- missing values ---------------------------------------------------------------------


@dataclass
class Imputer:
    """Fills fitted on training rows, missing tiers and indicator columns."""

    fills: dict[str, object] = field(default_factory=dict)
    ratios: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> Imputer:
        numbers = set(numeric_columns(train))
        row = train.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__m") for c in columns]).first()
        middle = exact_quantiles(train, [c for c in columns if c in numbers], [0.5])
        found = {c: v[0] for c, v in middle.items() if v}
        if texts := [c for c in columns if c not in numbers]:  # the most frequent value, the smallest on ties
            counted = long_form(train, texts).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
            found |= {r.column_name: r.value for r in counted.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")).collect()}
        fills = {c: found.get(c, 0.0 if c in numbers else "Missing") for c in columns}
        return cls(fills, {c: row[f"{c}__m"] / max(1, row["__n"]) for c in columns})

    def tier(self, c: str) -> str:
        r = self.ratios[c]
        return "none" if r == 0 else "low" if r < 0.05 else "medium" if r < 0.4 else "severe"

    def transform(self, df: DataFrame) -> DataFrame:
        flags = {f"{c}_is_missing": F.col(c).isNull().cast("int") for c in self.fills if self.tier(c) in ("medium", "severe")}
        out = df.withColumns(flags) if flags else df
        return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills.items()})

    def check(self, df: DataFrame, least: int = 10, level: float = 0.01) -> DataFrame:
        """Whether filling keeps the distribution of each number with more than ``least`` values: these against all values after filling, all columns in one pass."""
        numbers = [c for c in numeric_columns(df) if c in self.fills]
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"), F.lit(self.fills[c]).cast("double").alias("fill")) for c in numbers])).alias("p")).select("p.*")
        counted = long.groupBy("column_name", F.coalesce("x", "fill").alias("v")).agg(F.count("x").alias("a"), F.count("*").alias("b"))
        out = ks_by(counted, ("column_name",), level).where(F.col("n_a") > least)
        return out.select("column_name", F.col("n_a").alias("n_valid"), F.col("n_b").alias("n_filled"), F.round("d", 4).alias("ks_stat"), F.round("p_value", 4).alias("p_value"), F.col("is_same").alias("is_preserved"))

    def log(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, round(self.ratios[c], 4), self.tier(c), str(v)) for c, v in self.fills.items()], "column_name string, missing_ratio double, tier string, fill string")


def ks_by(counted: DataFrame, by: tuple[str, ...] = (), level: float = 0.01) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of counts ``a`` and ``b`` by value ``v``, for each group: largest gap of the distribution functions, sizes, p and whether p reaches ``level`` (null where one side is empty).

    The running sums go over distinct values, in blocks; p is asymptotic with the
    small-sample correction of the statistic.
    """
    share = lambda c: F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"{c}_total"))
    gaps = running_sums(counted, "v", ["a", "b"], by=by).select(*by, F.abs(share("a") - share("b")).alias("gap"), F.col("a_total").alias("n_a"), F.col("b_total").alias("n_b"))
    out = gaps.groupBy(*by).agg(F.max("gap").alias("d"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    p = kolmogorov_tail((root + 0.12 + F.try_divide(F.lit(0.11), root)) * F.col("d"))
    return out.withColumn("p_value", p).withColumn("is_same", F.col("p_value") >= level)


def ks_two_sample(df: DataFrame, value: str, group: str) -> DataFrame:
    """``ks_by`` of the values of group 0 and group 1."""
    return ks_by(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b")))


def ks_p_value(d: float, n_a: int, n_b: int) -> float:
    import math

    n = n_a * n_b / (n_a + n_b)
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.04 else 1.0


# -- encoding and scaling ---------------------------------------------------------------


def cardinality_guard(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """Distinct values of categorical columns, and which exceed the limit."""
    agg = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return stack(agg, [{"column_name": F.lit(c), "distinct_values": F.col(c), "dropped": F.col(c) > most} for c in columns])


@dataclass
class OneHot:
    """Sorted training categories of each column; the first is left out, unknown values are all 0."""

    levels: dict[str, list[str]]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], most: int = 50) -> OneHot:
        values = long_form(train, columns).where("value is not null").distinct()
        few = values.groupBy("column_name").count().where(F.col("count") <= most)
        levels: dict[str, list[str]] = {}
        for r in values.join(few, "column_name", "left_semi").orderBy("column_name", "value").collect():  # at most ``most`` for each column
            levels.setdefault(r.column_name, []).append(r.value)
        return cls({c: levels[c] for c in columns if c in levels})

    def transform(self, df: DataFrame, keep: bool = False) -> DataFrame:
        made = {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c, levels in self.levels.items() for v in levels[1:]}
        out = df.withColumns(made) if made else df
        return out if keep else out.drop(*self.levels)


def freq_encode(df: DataFrame, column: str) -> DataFrame:
    """``{column}_freq``: the value's share of all rows.  (The table of shares is joined, not broadcast by force.)"""
    counted = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    every = df.agg(F.count("*").alias("__every"))
    shares = counted.join(every, how="cross").select("__v", (F.col("__n") / F.col("__every")).alias(f"{column}_freq"))  # a row for all
    return df.join(shares, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def factorize(df: DataFrame, column: str) -> DataFrame:
    """``{column}_code``: place of the value in sorted order, from 0; null is -1."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__v")).distinct()
    codes = running_sums(values.withColumn("one", F.lit(1)), "__v", ["one"]).select("__v", F.col("one_before").cast("int").alias(f"{column}_code"))
    return df.join(codes, F.col(column) == F.col("__v"), "left").drop("__v").fillna(-1, [f"{column}_code"])


@dataclass
class RobustScaler:
    params: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> RobustScaler:
        row = exact_quantiles(train, columns, [0.25, 0.5, 0.75])
        return cls({c: (row[c][1], (row[c][2] - row[c][0]) or 1.0) for c in columns if row[c]})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.params.items()})


@dataclass
class FeaturePipeline:
    """Drop, impute, encode and scale with what the training rows gave; no step sees other rows."""

    drop: list[str]
    imputer: Imputer
    encoder: OneHot
    scaler: RobustScaler
    lineage: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, target: str, key: str | None = None, pii: list[str] = ()) -> FeaturePipeline:
        roles = {r.column_name: r.role for r in column_roles(train, target, list(pii)).collect()}
        drop = [c for c, r in roles.items() if r in ("pii", "datetime", "id") and c != key]
        numbers = [c for c, r in roles.items() if r == "numeric" and c != key]
        texts = [c for c, r in roles.items() if r == "categorical" and c != key]
        imputer = Imputer.fit(train, numbers + texts)
        filled = imputer.transform(train)
        encoder, scaler = OneHot.fit(filled, texts), RobustScaler.fit(filled, numbers)
        lineage = [("drop", c) for c in drop] + [("impute", c) for c in imputer.fills] + [("one_hot", c) for c in encoder.levels] + [("scale", c) for c in scaler.params]
        return cls(drop + [c for c in texts if c not in encoder.levels], imputer, encoder, scaler, lineage)

    def transform(self, df: DataFrame) -> DataFrame:
        bools = {f.name: F.col(f.name).cast("int") for f in df.schema if isinstance(f.dataType, T.BooleanType)}
        out = self.imputer.transform(df.withColumns(bools) if bools else df)
        return self.scaler.transform(self.encoder.transform(out.drop(*self.drop)))

    def lineage_log(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(self.lineage)], "step_no int, step string, column_name string")


