"""Top-k reports and orderings (T1-T10). Limits plan as per-partition top-k plus a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.measures import approx_tendered, btc_ratio


def top_phrases(phrases: DataFrame, limit: int = 50) -> DataFrame:
    return phrases.select("phrase", "count").orderBy(F.desc("count"), "phrase").limit(limit)


def phrase_stats(phrases: DataFrame) -> DataFrame:
    """Number of all phrases with the most frequent one and its count."""
    return phrases.agg(
        F.count(F.lit(1)).alias("n_phrases"),
        F.min_by("phrase", F.struct((-F.col("count")).alias("c"), "phrase")).alias("top_phrase"),
        F.max("count").alias("top_count"))


def latest_completed(auctions: DataFrame, n: int = 10) -> DataFrame:
    return (
        auctions.dropna(subset=["bid_to_cover_ratio"])
        .select("auction_id", "auction_date", "security_type", "bid_to_cover_ratio")
        .orderBy(F.desc("auction_date"), F.desc("auction_id")).limit(n))


def top_indirect(bidder_facts: DataFrame, n: int = 10) -> DataFrame:
    return (
        bidder_facts.dropna(subset=["indirect_bidder_percentage"])
        .select("auction_id", "auction_date", "security_type", "indirect_bidder_percentage")
        .orderBy(F.desc("indirect_bidder_percentage"), "auction_id").limit(n))


def last_updates(runs: DataFrame, n: int = 5) -> DataFrame:
    return (
        runs.select("run_id", "update_timestamp", "records_fetched", "records_inserted", "status")
        .orderBy(F.desc_nulls_first("update_timestamp"), "run_id").limit(n))


def latest_non_null(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The newest present value of a column, as one row."""
    return df.agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias(column))


def edge_n(df: DataFrame, order: list[str], n: int = 20, edge: str = "newest") -> DataFrame:
    """The first or last ``n`` rows of an ordering."""
    direction = F.desc if edge == "newest" else F.asc
    return df.orderBy(*[direction(c) for c in order]).limit(n)


def recent_rows(df: DataFrame, columns: list[str], n: int = 20, order: str = "date") -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n).select(*columns)


def recent_tendered(auctions: DataFrame, n: int = 20, require_btc: bool = True) -> DataFrame:
    """Newest ids with the tendered amount implied by accepted x bid-to-cover."""
    needed = ["total_accepted", "bid_to_cover_ratio"] if require_btc else ["total_accepted"]
    return auctions.dropna(subset=needed).select(
        "auction_id", "total_accepted", "bid_to_cover_ratio",
        approx_tendered("total_accepted", "bid_to_cover_ratio").alias("approx_total_tendered"),
    ).orderBy(F.desc("auction_id")).limit(n)


def btc_recompute(auctions: DataFrame) -> DataFrame:
    """Published against recomputed bid-to-cover (P13); the difference uses the unrounded ratio."""
    ratio = btc_ratio("total_tendered", "total_accepted")
    return auctions.dropna(subset=["total_tendered", "total_accepted"]).select(
        "auction_id", "auction_date", "total_tendered", "total_accepted", "bid_to_cover_ratio",
        F.round(ratio, 3).alias("calc_btc"),
        F.round(F.col("bid_to_cover_ratio").cast("double") - ratio, 3).alias("diff"))


def recent_btc_check(auctions: DataFrame, n: int = 15) -> DataFrame:
    return btc_recompute(auctions).orderBy(F.desc("auction_date"), F.desc("auction_id")).limit(n)


def last_auction_date(auctions: DataFrame) -> DataFrame:
    return auctions.agg(F.max("auction_date").alias("last_auction_date"))


def sort_chronological(df: DataFrame, date: str = "auction_date", key: str = "auction_id") -> DataFrame:
    """Full sort; the unique key lets the range partitioner split a crowded day."""
    return df.orderBy(date, key)
