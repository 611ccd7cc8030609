"""Concatenation and long-form series (U1-U6, S6 projection)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column missing in one becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "series",
            value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids, columns, name, value)


def dual_series(daily: DataFrame, indices: list[str], metrics: list[str], suffix: str = "",
                date: str = "date") -> DataFrame:
    """Index columns on the left axis and metric columns on the right, in long form."""
    chosen = daily.select(date, *[F.col(c + suffix).alias(c) for c in [*indices, *metrics]])
    axis = F.when(F.col("series").isin(*indices), "left").otherwise("right")
    return to_long(chosen, [date], [*indices, *metrics]).withColumn("axis", axis)


def type_series(df: DataFrame, value: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Present values per auction with date and security type."""
    return df.dropna(subset=[value]).select(
        "auction_id", "auction_date", "security_type", F.col(value).alias("value"), *extra)


def scatter_pairs(df: DataFrame, x: str, y: str, ids: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*ids, F.col(x).alias("x"), F.col(y).alias("y"))


def export_projection(df: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns that exist, without rows that are empty in all of them."""
    return df.select(*[c for c in columns if c in df.columns]).dropna("all")


def project_available(df: DataFrame, fields: list[str]) -> DataFrame:
    """Requested fields that exist, in requested order, each once."""
    return df.select(*[c for c in dict.fromkeys(fields) if c in df.columns])
