"""Filters and projections (F1-F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.measures import (fed_total, spread)


def date_window(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows from ``start`` up to and including the whole day ``end``."""
    return df.filter((F.col(column) >= F.lit(start).cast("date"))
                     & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1)))


def default_window(df: DataFrame, column: str, days: int = 365) -> DataFrame:
    """The last ``days`` days of the data itself."""
    bounds = df.agg(F.max(column).alias("last")).scalar()
    return df.filter(F.col(column) >= F.date_sub(bounds, days))


def default_bounds(df: DataFrame, column: str, days: int = 365) -> DataFrame:
    """One row with the start and end of the default window."""
    return df.agg(F.min(column).alias("first"), F.max(column).alias("end_date")).select(
        F.greatest("first", F.date_sub("end_date", days)).alias("start_date"), "end_date")


def since(df: DataFrame, column: str, start) -> DataFrame:
    return df.filter(F.col(column) >= F.lit(start).cast("date"))


def last_n_days(df: DataFrame, column: str, days: int, as_of) -> DataFrame:
    return df.filter(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def last_n_months(df: DataFrame, column: str, months: int, as_of) -> DataFrame:
    return df.filter(F.col(column) >= F.add_months(F.lit(as_of).cast("date"), -months))


def filter_type(df: DataFrame, security_type: str | None = None) -> DataFrame:
    return df if security_type is None else df.filter(F.col("security_type") == security_type)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)


def available_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The listed columns that exist and hold at least one value (reads one row back)."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return []
    filled = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return [c for c in present if filled[c]]


def is_out_of_bounds() -> Column:
    btc = F.col("bid_to_cover_ratio")
    return ((F.col("high_yield") < 0) | ~F.col("price_per_100").between(0, 200)
            | (btc.isNotNull() & ((btc <= 0) | (btc > 10))))


def out_of_bounds(auctions: DataFrame) -> DataFrame:
    """Auctions with a negative yield, a price outside 0-200 or an absurd bid-to-cover."""
    return auctions.filter(is_out_of_bounds()).select("auction_id", "high_yield", "price_per_100", "bid_to_cover_ratio")


def yield_spread(df: DataFrame, high: str = "high_yield", low: str = "low_yield",
                 name: str = "yield_spread") -> DataFrame:
    """Rows with both ends present, with their difference."""
    return complete_cases(df, [high, low]).withColumn(name, spread(high, low))


def bid_composition(df: DataFrame) -> DataFrame:
    """Competitive and non-competitive shares of their own sum (P10)."""
    total = F.col("competitive_accepted") + F.col("noncompetitive_accepted")
    return (
        complete_cases(df, ["competitive_accepted", "noncompetitive_accepted"])
        .withColumn("total_bids", total)
        .withColumn("comp_pct", F.try_divide(F.col("competitive_accepted"), total) * 100)
        .withColumn("noncomp_pct", F.try_divide(F.col("noncompetitive_accepted"), total) * 100)
    )


def fed_rows(df: DataFrame) -> DataFrame:
    """Auctions with any official participation."""
    return df.filter(F.col("fima_percentage").isNotNull() | F.col("soma_percentage").isNotNull())


def fed_participation(df: DataFrame) -> DataFrame:
    """Official participation with the combined share."""
    return fed_rows(df).withColumn("fed_total_pct", fed_total("fima_percentage", "soma_percentage"))
