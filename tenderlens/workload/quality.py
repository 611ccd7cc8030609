"""Queries of the report bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.operators.ranking import last_updates
from tenderlens.plans.quality import IMPORTANT, consistency_report, market_report, quality_report
from tenderlens.sources.tables import latest_run_states
from tenderlens.workload import views as v
from tenderlens.workload.market import _as_double, _exact_auctions
from tenderlens.workload.registry import query, rounded
from tenderlens.workload.views import AS_OF, using

_BOUNDS = """high_yield < 0 OR price_per_100 NOT BETWEEN 0 AND 200
    OR (bid_to_cover_ratio IS NOT NULL AND (bid_to_cover_ratio <= 0 OR bid_to_cover_ratio > 10))"""


def _line(check: str, key: str, value: str, source: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{key}' AS \"key\", CAST({value} AS VARCHAR) AS \"value\" FROM {source}"


@query("quality_report", using("auctions securities bidders", " UNION ALL ".join([
    *[_line("rows", k, "count(*)", t) for k, t in
      {"auctions": "auctions", "securities": "securities", "bidder_details": "bidders"}.items()],
    *[_line("nulls", c, f"count(*) - count({c})", "auctions") for c in IMPORTANT],
    _line("status", "PENDING", "count(*) - count(bid_to_cover_ratio)", "auctions"),
    _line("status", "RESULTS", "count(bid_to_cover_ratio)", "auctions"),
    _line("coverage", "min_date", "min(auction_date)", "auctions"),
    _line("coverage", "max_date", "max(auction_date)", "auctions"),
    _line("coverage", "last_30d", f"count(*) FILTER (WHERE auction_date >= DATE '{AS_OF}' - 30)", "auctions"),
    _line("orphans", "auctions", "count(*)",
          "auctions a WHERE NOT EXISTS (SELECT 1 FROM securities s WHERE s.cusip = a.cusip)"),
    _line("orphans", "bidder_details", "count(*)",
          "bidders b WHERE NOT EXISTS (SELECT 1 FROM auctions a WHERE a.auction_id = b.auction_id)"),
    _line("bounds", "auctions", "count(*)", f"auctions WHERE {_BOUNDS}"),
])))
def _(spark, sf):
    return quality_report(v.auctions(spark, sf), v.securities(spark, sf), v.bidders(spark, sf), AS_OF)


@query("consistency_report", using("auctions bidders", f"""
    (SELECT 'tendered' AS report, auction_id, 'approx_total_tendered' AS measure,
        round({v.TENDERED}, 2) AS "value" FROM auctions WHERE total_accepted IS NOT NULL
        ORDER BY auction_id DESC LIMIT 15)
    UNION ALL SELECT 'ratio', auction_id, 'calc_btc', calc_btc FROM ratio
    UNION ALL SELECT 'ratio', auction_id, 'diff', diff FROM ratio
    UNION ALL (SELECT 'shares', auction_id, 'pct_sum', round(coalesce(primary_dealer_percentage, 0)
        + coalesce(direct_bidder_percentage, 0) + coalesce(indirect_bidder_percentage, 0), 6)
        FROM bidders ORDER BY auction_id DESC LIMIT 15)""",
    ratio="""SELECT auction_id, round(total_tendered / nullif(total_accepted, 0), 3) AS calc_btc,
        round(bid_to_cover_ratio - total_tendered / nullif(total_accepted, 0), 3) AS diff FROM auctions
        WHERE total_tendered IS NOT NULL AND total_accepted IS NOT NULL
        ORDER BY auction_date DESC, auction_id DESC LIMIT 15"""))
def _(spark, sf):
    return rounded(_as_double(consistency_report(_exact_auctions(spark, sf), v.bidders(spark, sf))))


@query("market_report", using("typed bidders", f"""
    (SELECT 'latest_completed' AS report, CAST(auction_id AS VARCHAR) AS "key",
        bid_to_cover_ratio AS "value" FROM typed WHERE bid_to_cover_ratio IS NOT NULL
        ORDER BY auction_date DESC, auction_id DESC LIMIT 10)
    UNION ALL SELECT 'avg_btc_by_type', security_type, round(avg(bid_to_cover_ratio), 3) FROM typed
        WHERE auction_date >= DATE '{AS_OF}' - 90 AND bid_to_cover_ratio IS NOT NULL GROUP BY security_type
    UNION ALL (SELECT 'top_indirect', CAST(t.auction_id AS VARCHAR), indirect_bidder_percentage
        FROM typed t JOIN bidders b ON t.auction_id = b.auction_id
        WHERE indirect_bidder_percentage IS NOT NULL
        ORDER BY indirect_bidder_percentage DESC, t.auction_id LIMIT 10)"""))
def _(spark, sf):
    report = market_report(v.auctions(spark, sf), v.securities(spark, sf), v.bidders(spark, sf), AS_OF)
    shown = {"latest_completed": ("auction_id", "bid_to_cover_ratio"),
             "avg_btc_by_type": ("security_type", "avg_btc"),
             "top_indirect": ("auction_id", "indirect_bidder_percentage")}
    parts = [report[name].select(F.lit(name).alias("report"), F.col(key).cast("string").alias("key"),
                                 F.col(value).alias("value")) for name, (key, value) in shown.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _runs(spark, sf):
    """Ledger entries: every order month counts as one run that starts and, except some, ends."""
    months = v.table(spark, sf, "orders").groupBy(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("started")).agg(
        F.max("o_orderdate").alias("ended"), F.count(F.lit(1)).alias("fetched"))
    started = months.select(
        F.date_format("started", "yyyy-MM").alias("run_id"), F.col("started").alias("update_timestamp"),
        F.lit(None).cast("bigint").alias("records_fetched"), F.lit(None).cast("bigint").alias("records_inserted"),
        F.lit("RUNNING").alias("status"))
    ended = months.filter(F.month("started") != 2).select(
        F.date_format("started", "yyyy-MM").alias("run_id"), F.col("ended").alias("update_timestamp"),
        F.col("fetched").alias("records_fetched"), F.col("fetched").alias("records_inserted"),
        F.lit("SUCCESS").alias("status"))
    return started.filter(F.col("update_timestamp").isNotNull()).unionAll(
        ended.withColumn("update_timestamp", F.col("update_timestamp") + F.expr("INTERVAL 1 SECOND")))


_RUN_STATES = """SELECT strftime(m, '%Y-%m') AS run_id,
    CASE WHEN month(m) <> 2 THEN ended + INTERVAL 1 SECOND ELSE m END AS update_timestamp,
    CASE WHEN month(m) <> 2 THEN n END AS records_fetched, CASE WHEN month(m) <> 2 THEN n END AS records_inserted,
    CASE WHEN month(m) <> 2 THEN 'SUCCESS' ELSE 'RUNNING' END AS status
    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, max(o_orderdate) AS ended,
    count(*) AS n FROM orders GROUP BY 1)"""


@query("run_states", _RUN_STATES)
def _(spark, sf):
    return latest_run_states(_runs(spark, sf))


@query("last_updates", f"SELECT * FROM ({_RUN_STATES}) ORDER BY update_timestamp DESC, run_id LIMIT 5")
def _(spark, sf):
    return last_updates(latest_run_states(_runs(spark, sf)))
