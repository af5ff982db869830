"""Reusable column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket(key: str | Column, parts: int, seed: str = "") -> Column:
    """A reproducible bucket of a key, from the first 32 bits of its md5; equal for any partitioning."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.pmod(F.conv(F.substring(F.md5(F.concat(text, F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(parts))


def safe_ratio(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """a / (b + floor), or 0 where b is next to 0."""
    return F.when(F.abs(b) > floor, a / (b + F.lit(floor))).otherwise(0.0)


def missing(c: str, df: DataFrame) -> Column:
    """Null, or NaN in floating columns: one notion of a missing value."""
    kind = df.schema[c].dataType
    return F.col(c).isNull() | F.isnan(c) if isinstance(kind, T.DoubleType | T.FloatType) else F.col(c).isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns."""
    fix = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in fix else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def split_items(text: Column) -> Column:
    """A delimited list, by the first of ``, ; | /`` that occurs in it; trimmed, empties dropped."""
    parts = F.split(text, "\u0000")
    for sep in ("/", "|", ";", ","):
        parts = F.when(F.contains(text, F.lit(sep)), F.split(text, f"[{sep}]")).otherwise(parts)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
