"""Registered queries over the operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, deriving, drifting, modelling, profiling, recommending, statistics
from .registry import QUERIES, SQL

_ = (cleaning, deriving, drifting, modelling, profiling, recommending, statistics)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profile of a customer mart over orders."""
    from ..operators.profile import column_profile

    return column_profile(QUERIES["feature_mart"](spark, sf_dir))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
