"""Joins of auctions, securities and bidder details.

No broadcast hints here: securities and bidder tables grow with the data, so Spark's own size
check decides, and adaptive execution splits a hot cusip when it has to shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.operators.filters import since

# Columns of the wide auction fact, by table.
AUCTION_COLUMNS = [
    "auction_id", "auction_date", "auction_date_year", "bid_to_cover_ratio", "high_yield",
    "low_yield", "offering_amount", "total_accepted", "total_tendered", "high_discount_rate",
    "low_discount_rate", "high_investment_rate", "low_investment_rate",
]
BIDDER_COLUMNS = [
    "primary_dealer_percentage", "direct_bidder_percentage", "indirect_bidder_percentage",
    "fima_accepted", "fima_percentage", "soma_accepted", "soma_percentage",
    "competitive_accepted", "noncompetitive_accepted", "treasury_retail_accepted",
]


def auctions_with_security(auctions: DataFrame, securities: DataFrame) -> DataFrame:
    """Every auction with the type, term and coupon of its security (inner)."""
    side = securities.select(
        "cusip", "security_type", "security_term",
        F.col("interest_rate").alias("security_interest_rate"))
    return auctions.join(side, "cusip", "inner")


def auction_facts(auctions: DataFrame, securities: DataFrame, bidders: DataFrame,
                  start=None) -> DataFrame:
    """The wide fact: auction, security and, where present, bidder details."""
    base = auctions if start is None else since(auctions, "auction_date", start)
    # Bidder details first: auctions come by auction_id, so their wide rows are shuffled once.
    joined = auctions_with_security(
        base.join(bidders.select("auction_id", *BIDDER_COLUMNS), "auction_id", "left"), securities)
    return joined.select(*AUCTION_COLUMNS, "security_type", "security_term",
                         "security_interest_rate", *BIDDER_COLUMNS)


def bidder_facts(auctions: DataFrame, securities: DataFrame, bidders: DataFrame) -> DataFrame:
    """Only auctions that have both a security and bidder details."""
    return auctions_with_security(
        auctions.join(bidders.select("auction_id", *BIDDER_COLUMNS), "auction_id", "inner"), securities)


def daily_join(auctions_daily: DataFrame, index_daily: DataFrame) -> DataFrame:
    """Two tables of one row per day, matched on the day."""
    return auctions_daily.join(index_daily, "date", "inner")


def orphans(child: DataFrame, parent: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Child rows whose key has no parent, null keys included."""
    return child.select(*columns).join(parent.select(key), key, "left_anti").select(*columns)


def append_new(existing: DataFrame | None, incoming: DataFrame,
               keys: tuple[str, ...] = ("cusip",)) -> DataFrame:
    """Incoming rows with an unseen key on top of the existing rows.

    Keys are compared as text, a missing key being one value of its own. Duplicates inside the
    incoming rows are kept.
    """
    if existing is None:
        return incoming
    return new_records(existing, incoming, keys).unionByName(existing, allowMissingColumns=True)


def new_records(existing: DataFrame, incoming: DataFrame,
                keys: tuple[str, ...] = ("cusip",)) -> DataFrame:
    """Rows whose key is unseen. Rows without any key need no partner, only to know if there is one."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("nan")).alias(f"_key_{k}") for k in keys]
    names = [f"_key_{k}" for k in keys]
    empty = reduce(lambda a, b: a & b, [F.col(n) == "nan" for n in names])
    known = existing.select(*text).distinct()
    keyed = incoming.select("*", *text)
    seen_empty = existing.select(*text).filter(empty).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    fresh = keyed.filter(~empty).join(known.filter(~empty), names, "left_anti")
    return fresh.unionByName(keyed.filter(empty & (seen_empty == 0))).drop(*names)
