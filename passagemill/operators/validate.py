"""Constraint checks, each one aggregate over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Values of ``key`` without a parent, with their rows."""
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(p, key, "left_anti")


def value_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows, NULLs, NaN and values outside the range."""
    c = F.col(column)
    one = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), one(c.isNull()).alias("nulls"), one(F.isnan(c)).alias("nans"), one(~F.isnan(c) & ((c < low) | (c > high))).alias("outside"))


def unique(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys (V6)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("n_distinct"))


def require(violations: DataFrame, what: str) -> None:
    """Raise if a violation table has any row; reads one row at most."""
    bad = violations.take(1)
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")
