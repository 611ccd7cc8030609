"""Data-quality and market report bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.operators.aggregates import avg_btc_by_type, pct_sum_check
from tenderlens.operators.filters import is_out_of_bounds
from tenderlens.operators.joins import auctions_with_security, bidder_facts
from tenderlens.operators.ranking import (last_updates, latest_completed, recent_btc_check,
                                          recent_tendered, top_indirect)
from tenderlens.operators.reshape import concat, to_long

# Auction columns whose missing values are reported.
IMPORTANT = ["bid_to_cover_ratio", "total_accepted", "offering_amount", "auction_date"]


def quality_report(auctions: DataFrame, securities: DataFrame, bidders: DataFrame, as_of) -> DataFrame:
    """Counts, orphans, missing values, bounds, status and coverage as (check, key, value).

    Everything that concerns auctions alone comes from a single pass over that table; orphans and the
    number of rows they are taken from come from one outer join per pair of tables.
    """
    btc, recent = F.col("bid_to_cover_ratio"), F.col("auction_date") >= F.date_sub(F.lit(as_of).cast("date"), 30)
    figures = auctions.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in IMPORTANT],
        F.count_if(btc.isNull()).alias("pending"), F.count_if(btc.isNotNull()).alias("results"),
        F.min("auction_date").alias("min_date"), F.max("auction_date").alias("max_date"),
        F.count_if(recent).alias("last_30d"), F.count_if(is_out_of_bounds()).alias("bounds"))
    split = {
        "rows": {"auctions": "rows"},
        "nulls": {c: f"null_{c}" for c in IMPORTANT},
        "status": {"PENDING": "pending", "RESULTS": "results"},
        "coverage": {"min_date": "min_date", "max_date": "max_date", "last_30d": "last_30d"},
        "bounds": {"auctions": "bounds"},
    }
    entries = [F.struct(F.lit(check).alias("check"), F.lit(key).alias("key"),
                        F.col(column).cast("string").alias("value"))
               for check, keys in split.items() for key, column in keys.items()]
    auction_part = figures.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

    def matched(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        """Rows of the parent and rows of the child without one, counted per key before they meet."""
        sides = child.groupBy(key).agg(F.count(F.lit(1)).alias("children")).join(
            parent.groupBy(key).agg(F.count(F.lit(1)).alias("parents")), key, "full")
        return sides.agg(F.coalesce(F.sum("parents"), F.lit(0)).alias("parents"),
                         F.coalesce(F.sum("children"), F.lit(0)).alias("children"),
                         F.coalesce(F.sum(F.when(F.col("parents").isNull(), F.col("children"))), F.lit(0)).alias("orphans"))

    by_cusip, by_auction = matched(auctions, securities, "cusip"), matched(bidders, auctions, "auction_id")

    def figures_of(row: DataFrame, entries: list[tuple[str, str, str]]) -> DataFrame:
        return row.select(F.explode(F.array(*[
            F.struct(F.lit(check).alias("check"), F.lit(key).alias("key"), F.col(column).cast("string").alias("value"))
            for check, key, column in entries])).alias("e")).select("e.*")

    return concat(
        auction_part,
        figures_of(by_cusip, [("rows", "securities", "parents"), ("orphans", "auctions", "orphans")]),
        figures_of(by_auction, [("rows", "bidder_details", "children"), ("orphans", "bidder_details", "orphans")]))


def consistency_report(auctions: DataFrame, bidders: DataFrame, n: int = 15) -> DataFrame:
    """Newest implied amounts, recomputed ratios and share sums as (report, auction_id, measure, value)."""
    parts = {
        "tendered": (recent_tendered(auctions, n, require_btc=False), ["approx_total_tendered"]),
        "ratio": (recent_btc_check(auctions, n), ["calc_btc", "diff"]),
        "shares": (pct_sum_check(bidders, n), ["pct_sum"]),
    }
    return concat(*[to_long(df, ["auction_id"], columns, "measure").withColumn("report", F.lit(name))
                    for name, (df, columns) in parts.items()])


def market_report(auctions: DataFrame, securities: DataFrame, bidders: DataFrame, as_of,
                  runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The market tables by name."""
    typed = auctions_with_security(auctions, securities)
    report = {
        "latest_completed": latest_completed(typed),
        "avg_btc_by_type": avg_btc_by_type(typed, as_of),
        "top_indirect": top_indirect(bidder_facts(auctions, securities, bidders)),
    }
    if runs is not None:
        report["last_updates"] = last_updates(runs)
    return report
