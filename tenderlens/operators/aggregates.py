"""Roll-ups and key figures.

Every operator is one aggregation with a map-side partial step; whole-table figures reduce to a
single row, so no raw rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.measures import (BILLION, MILLION, auction_status, mean_of, scaled,
                                           total_of)
from tenderlens.operators.filters import (complete_cases, fed_rows, last_n_days, last_n_months,
                                          yield_spread)
from tenderlens.operators.ranking import edge_n
from tenderlens.session import scalars

# Term label behind each yield column of the daily roll-up.
TERM_YIELDS = {
    "ten_year_yield": "10-Year", "two_year_yield": "2-Year",
    "five_year_yield": "5-Year", "thirty_year_yield": "30-Year",
}


def _latest(value: str, date: str, key: str):
    """The value on the newest row that has one."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(date, key)))


def overview_kpis(facts: DataFrame, as_of) -> DataFrame:
    recent = F.col("auction_date") >= F.date_sub(F.lit(as_of).cast("date"), 30)
    return facts.agg(
        F.count(F.lit(1)).alias("total_auctions"),
        F.count_if(recent).alias("last_30_days"),
        mean_of("bid_to_cover_ratio").alias("avg_bid_to_cover"),
        (total_of("offering_amount") / BILLION).alias("total_offered_b"),
        _latest("high_yield", "auction_date", "auction_id").alias("latest_yield"),
        mean_of("fima_percentage").alias("avg_fima_pct"),
        mean_of("soma_percentage").alias("avg_soma_pct"),
        (total_of("competitive_accepted") / BILLION).alias("competitive_b"),
        (total_of("noncompetitive_accepted") / BILLION).alias("noncompetitive_b"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mean_complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column means over rows that have all of the columns, one row per column."""
    means = complete_cases(df, columns).agg(*[mean_of(c).alias(c) for c in columns])
    return means.unpivot([], columns, "measure", "mean")


def daily_auction_rollup(facts: DataFrame) -> DataFrame:
    """One row per auction day with the 19 measures of the comparison pages."""
    term_yields = [
        F.avg(F.when(F.col("security_term") == label, F.col("high_yield"))).alias(name)
        for name, label in TERM_YIELDS.items()
    ]
    return facts.groupBy(F.col("auction_date").alias("date")).agg(
        mean_of("bid_to_cover_ratio").alias("bid_to_cover_ratio"),
        mean_of("high_yield").alias("avg_high_yield"),
        mean_of("low_yield").alias("avg_low_yield"),
        *term_yields,
        mean_of("primary_dealer_percentage").alias("primary_dealer_share"),
        mean_of("direct_bidder_percentage").alias("direct_bidder_share"),
        mean_of("indirect_bidder_percentage").alias("indirect_bidder_share"),
        mean_of("fima_percentage").alias("fima_share"),
        mean_of("soma_percentage").alias("soma_share"),
        scaled(F.sum("fima_accepted"), MILLION).alias("fima_accepted_millions"),
        scaled(F.sum("soma_accepted"), MILLION).alias("soma_accepted_millions"),
        scaled(mean_of("offering_amount"), MILLION).alias("avg_offering_millions"),
        scaled(F.sum("total_accepted"), MILLION).alias("total_accepted_millions"),
        F.avg(F.col("high_yield") - F.col("low_yield")).alias("yield_spread"),
        F.count(F.lit(1)).alias("auction_count"),
    )


def weekly_rollup(auctions: DataFrame, as_of, months: int = 24) -> DataFrame:
    """Per Monday week of the last two years: mean and deviation of demand, mean yield, count."""
    recent = last_n_months(auctions, "auction_date", months, as_of)
    btc = F.col("bid_to_cover_ratio").cast("double")
    return recent.groupBy(F.date_trunc("week", "auction_date").cast("date").alias("week")).agg(
        F.avg(btc).alias("avg_btc"),
        F.stddev_samp(btc).alias("std_btc"),
        mean_of("high_yield").alias("avg_yield"),
        F.count(F.lit(1)).alias("auction_count"),
    )


def participation_by_type(facts: DataFrame) -> DataFrame:
    return fed_rows(facts).groupBy("security_type").agg(
        mean_of("fima_percentage").alias("fima_percentage"),
        mean_of("soma_percentage").alias("soma_percentage"),
        total_of("fima_accepted").alias("fima_accepted"),
        total_of("soma_accepted").alias("soma_accepted"),
    ).withColumns({
        "fima_accepted_b": F.col("fima_accepted") / BILLION,
        "soma_accepted_b": F.col("soma_accepted") / BILLION,
    })


def stats_by_group(df: DataFrame, group: str, column: str, digits: int = 3) -> DataFrame:
    """count, mean, deviation, min and max per group, rounded half to even."""
    x = F.col(column).cast("double")
    return df.dropna(subset=[group]).groupBy(group).agg(
        F.count(x).alias("n"),
        F.bround(F.avg(x), digits).alias("mean"),
        F.bround(F.stddev_samp(x), digits).alias("std"),
        F.bround(F.min(x), digits).alias("min"),
        F.bround(F.max(x), digits).alias("max"),
    )


def avg_btc_by_type(auctions: DataFrame, as_of, days: int = 90, digits: int = 3) -> DataFrame:
    recent = last_n_days(auctions, "auction_date", days, as_of)
    return recent.dropna(subset=["bid_to_cover_ratio"]).groupBy("security_type").agg(
        F.round(mean_of("bid_to_cover_ratio"), digits).alias("avg_btc"),
        F.count(F.lit(1)).alias("n"),
    )


def null_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column from one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "col", "nulls")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def status_counts(auctions: DataFrame) -> DataFrame:
    return auctions.groupBy(auction_status("bid_to_cover_ratio").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


def coverage_window(auctions: DataFrame, as_of) -> DataFrame:
    recent = F.col("auction_date") >= F.date_sub(F.lit(as_of).cast("date"), 30)
    return auctions.agg(
        F.min("auction_date").alias("min_date"), F.max("auction_date").alias("max_date"),
        F.count_if(recent).alias("last_30d"))


def index_kpis(index_daily: DataFrame) -> DataFrame:
    return index_daily.agg(
        F.coalesce(F.sum("total_articles"), F.lit(0)).alias("total_articles"),
        (mean_of("rate") * 100).alias("avg_fiscal_rate_pct"),
        F.when(F.count(F.lit(1)) > 0, F.max_by("fiscal_policy_index", "date"))
        .otherwise(F.lit(0.0)).alias("latest_index"),
        (mean_of("tariff_rate") * 100).alias("avg_tariff_rate_pct"),
    )


def avg_articles_by_kind(index_daily: DataFrame) -> DataFrame:
    means = index_daily.agg(mean_of("tariff_fiscal_articles").alias("Tariff"),
                            mean_of("non_tariff_fiscal_articles").alias("Non-Tariff"))
    return means.unpivot([], ["Tariff", "Non-Tariff"], "type", "average_articles")


def fed_kpis(facts: DataFrame) -> DataFrame:
    return fed_rows(facts).agg(
        mean_of("fima_percentage").alias("avg_fima_pct"),
        (total_of("fima_accepted") / BILLION).alias("total_fima_b"),
        mean_of("soma_percentage").alias("avg_soma_pct"),
        (total_of("soma_accepted") / BILLION).alias("total_soma_b"),
    )


def stress_kpis(facts: DataFrame, n: int = 20, edge: str = "newest") -> DataFrame:
    """Means over the first or last ``n`` auctions against the whole period."""
    order = ["auction_date", "auction_id"]
    overall, = scalars(facts, mean_of("bid_to_cover_ratio"))
    spread, = scalars(edge_n(yield_spread(facts), order, n, edge), mean_of("yield_spread"))
    recent = edge_n(facts, order, n, edge).agg(
        mean_of("bid_to_cover_ratio").alias("recent_btc"),
        mean_of("fima_percentage").alias("recent_fima_pct"),
        mean_of("soma_percentage").alias("recent_soma_pct"))
    return recent.select(
        "recent_btc", overall.alias("historical_btc"),
        ((F.try_divide("recent_btc", overall) - 1) * 100).alias("btc_change_pct"),
        spread.alias("avg_yield_spread"), "recent_fima_pct", "recent_soma_pct")


def pct_sum_check(bidders: DataFrame, n: int = 15) -> DataFrame:
    """Sum of the three main shares of the newest rows (expected near 100)."""
    parts = ["primary_dealer_percentage", "direct_bidder_percentage", "indirect_bidder_percentage"]
    total = sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in parts)
    return bidders.select("auction_id", total.alias("pct_sum")).orderBy(F.desc("auction_id")).limit(n)
