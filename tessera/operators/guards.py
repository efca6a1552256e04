"""Guards that fail loudly. They run a job each, so the ``build`` functions call them, never a lazy query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raise if a key stands twice."""
    twice = df.groupBy(*keys).count().where("count > 1").take(3)
    if twice:
        raise ValueError(f"duplicate {keys}: {[tuple(r)[:-1] for r in twice]}")
    return df


def no_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Raise if a column has a NULL."""
    for c in columns:
        if df.where(F.col(c).isNull()).take(1):
            raise ValueError(f"missing values in {c}")
    return df


def all_found(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Raise if ``keys`` has a key that ``table`` lacks."""
    lost = keys.select(key).join(table.select(key), key, "left_anti").take(3)
    if lost:
        raise ValueError(f"unknown {key}: {[r[0] for r in lost]}")
    return keys


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Raise unless both tables have the same set of keys."""
    all_found(a, b, key)
    all_found(b, a, key)
    return a


def holds(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Raise if a row breaks ``condition`` (NULL counts as broken)."""
    if df.where(~F.coalesce(condition, F.lit(False))).take(1):
        raise ValueError(what)
    return df


def constant_within(df: DataFrame, key: str, column: str) -> DataFrame:
    """Raise if a group has two different values."""
    return holds(df.groupBy(key).agg(F.count_distinct(column).alias("n")), F.col("n") <= 1, f"{column} varies within {key}")


def same_count(df: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Raise unless ``df`` has as many rows as an earlier stage registered under ``key`` (entries: key, shown)."""
    known = entries.where(F.col("key") == key).select(F.col("shown").cast("double")).first()
    rows = df.count()
    if known is None or known[0] != rows:
        raise ValueError(f"{rows} rows, but {key} is {known and known[0]}: run the earlier stages again")
    return df
