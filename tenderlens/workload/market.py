"""Queries over auctions: filters, joins, roll-ups, windows, rankings and reshaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenderlens.functions import measures as m
from tenderlens.operators import aggregates as agg
from tenderlens.operators import correlation as corr
from tenderlens.operators import filters as flt
from tenderlens.operators import joins, ranking, reshape, rolling
from tenderlens.plans.facts import FactTables
from tenderlens.workload import views as v
from tenderlens.workload.registry import near, nears, query, rounded, rounds, scratch, settled
from tenderlens.workload.views import AS_OF, START, using

ID_ORDER = ["auction_date", "auction_id"]

# --- filters and projections -------------------------------------------------------------


@query("date_window", using("auctions", """SELECT auction_id, auction_date, bid_to_cover_ratio
    FROM auctions WHERE auction_date >= DATE '1997-03-01' AND auction_date < DATE '1998-03-01'"""))
def _(spark, sf):
    return flt.date_window(v.auctions(spark, sf), "auction_date", "1997-03-01", "1998-02-28").select(
        "auction_id", "auction_date", "bid_to_cover_ratio")


@query("default_window", using("auctions", """SELECT auction_id, auction_date FROM auctions
    WHERE auction_date >= (SELECT greatest(min(auction_date), max(auction_date) - 365) FROM auctions)"""))
def _(spark, sf):
    return flt.default_window(v.auctions(spark, sf), "auction_date").select("auction_id", "auction_date")


@query("default_bounds", using("auctions", """SELECT
    greatest(min(auction_date), max(auction_date) - 365) AS start_date,
    max(auction_date) AS end_date FROM auctions"""))
def _(spark, sf):
    return flt.default_bounds(v.auctions(spark, sf), "auction_date")


@query("since", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders
    WHERE o_orderdate >= TIMESTAMP '{START}'""")
def _(spark, sf):
    return flt.since(v.table(spark, sf, "orders"), "o_orderdate", START).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))


@query("last_n_days", using("auctions", f"""SELECT auction_id, auction_date FROM auctions
    WHERE auction_date >= DATE '{AS_OF}' - 90"""))
def _(spark, sf):
    return flt.last_n_days(v.auctions(spark, sf), "auction_date", 90, AS_OF).select(
        "auction_id", "auction_date")


@query("filter_type", using("typed", """SELECT auction_id, security_type, bid_to_cover_ratio
    FROM typed WHERE security_type = 'BUILDING'"""))
def _(spark, sf):
    return flt.filter_type(v.typed_auctions(spark, sf), "BUILDING").select(
        "auction_id", "security_type", "bid_to_cover_ratio")


@query("complete_cases", using("bidders", """SELECT auction_id, fima_percentage, soma_percentage
    FROM bidders WHERE fima_percentage IS NOT NULL AND soma_percentage IS NOT NULL"""))
def _(spark, sf):
    return flt.complete_cases(v.bidders(spark, sf), ["fima_percentage", "soma_percentage"]).select(
        "auction_id", "fima_percentage", "soma_percentage")


@query("available_columns", using("facts", "SELECT auction_id, bid_to_cover_ratio, fima_percentage FROM facts"))
def _(spark, sf):
    facts = v.facts(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    wanted = ["bid_to_cover_ratio", "empty", "no_such_column", "fima_percentage"]
    kept = flt.available_columns(facts, wanted)
    return facts.select("auction_id", *kept)


@query("out_of_bounds", using("auctions", """SELECT auction_id, high_yield, price_per_100,
    bid_to_cover_ratio FROM auctions WHERE high_yield < 0 OR price_per_100 NOT BETWEEN 0 AND 200
    OR (bid_to_cover_ratio IS NOT NULL AND (bid_to_cover_ratio <= 0 OR bid_to_cover_ratio > 10))
    ORDER BY auction_id DESC LIMIT 20"""))
def _(spark, sf):
    return flt.out_of_bounds(v.auctions(spark, sf)).orderBy(F.desc("auction_id")).limit(20)


# --- row measures ------------------------------------------------------------------------


@query("share_pct", using("bidders", """SELECT auction_id, primary_dealer_percentage,
    direct_bidder_percentage, indirect_bidder_percentage, fima_percentage, soma_percentage
    FROM bidders"""))
def _(spark, sf):
    return v.bidders(spark, sf).select("auction_id", *[f"{w}_percentage" for w in v.SHARES])


@query("yield_spread", using("auctions", f"""SELECT auction_id, {rounds('yield_spread')} FROM (
    SELECT auction_id, high_yield - low_yield AS yield_spread FROM auctions
    WHERE high_yield IS NOT NULL AND low_yield IS NOT NULL)"""))
def _(spark, sf):
    return rounded(flt.yield_spread(v.auctions(spark, sf)).select("auction_id", "yield_spread"))


@query("discount_spread", using("auctions", f"""SELECT auction_id, {rounds('discount_spread')} FROM (
    SELECT auction_id, high_discount_rate - low_discount_rate AS discount_spread FROM auctions
    WHERE high_discount_rate IS NOT NULL AND low_discount_rate IS NOT NULL)"""))
def _(spark, sf):
    spread = flt.yield_spread(v.auctions(spark, sf), "high_discount_rate", "low_discount_rate",
                              "discount_spread")
    return rounded(spread.select("auction_id", "discount_spread"))


@query("bid_composition", using("bidders", f"""SELECT auction_id, {rounds('total_bids', 'comp_pct', 'noncomp_pct')}
    FROM (SELECT auction_id, competitive_accepted + noncompetitive_accepted AS total_bids,
    competitive_accepted / (competitive_accepted + noncompetitive_accepted) * 100 AS comp_pct,
    noncompetitive_accepted / (competitive_accepted + noncompetitive_accepted) * 100 AS noncomp_pct
    FROM bidders WHERE competitive_accepted IS NOT NULL AND noncompetitive_accepted IS NOT NULL)"""))
def _(spark, sf):
    return rounded(flt.bid_composition(v.bidders(spark, sf)).select(
        "auction_id", "total_bids", "comp_pct", "noncomp_pct"))


@query("fed_total_pct", using("facts", f"""SELECT auction_id, {rounds('fed_total_pct')} FROM (
    SELECT auction_id, coalesce(fima_percentage, 0) + coalesce(soma_percentage, 0) AS fed_total_pct
    FROM facts WHERE fima_percentage IS NOT NULL OR soma_percentage IS NOT NULL)"""))
def _(spark, sf):
    return rounded(flt.fed_participation(v.facts(spark, sf)).select("auction_id", "fed_total_pct"))


def _exact_auctions(spark, sf):
    return v.auctions(spark, sf).withColumns({
        "total_accepted": v.exact("total_accepted", 20, 2),
        "bid_to_cover_ratio": v.exact("bid_to_cover_ratio", 10, 4)})


def _as_double(df):
    return df.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c)
                       for c, kind in df.dtypes])


@query("approx_total_tendered", using("auctions", f"""SELECT auction_id,
    {v.TENDERED} AS approx_total_tendered FROM auctions"""))
def _(spark, sf):
    return _as_double(_exact_auctions(spark, sf).select(
        "auction_id",
        m.approx_tendered("total_accepted", "bid_to_cover_ratio").alias("approx_total_tendered")))


@query("btc_recompute", using("auctions", """SELECT auction_id, auction_date, total_tendered,
    total_accepted, bid_to_cover_ratio,
    round(total_tendered / nullif(total_accepted, 0), 3) AS calc_btc,
    round(bid_to_cover_ratio - total_tendered / nullif(total_accepted, 0), 3) AS diff
    FROM auctions WHERE total_tendered IS NOT NULL AND total_accepted IS NOT NULL"""))
def _(spark, sf):
    return ranking.btc_recompute(v.auctions(spark, sf))


@query("auction_status", using("auctions", """SELECT auction_id,
    CASE WHEN bid_to_cover_ratio IS NULL THEN 'PENDING' ELSE 'RESULTS' END AS status FROM auctions"""))
def _(spark, sf):
    return v.auctions(spark, sf).select("auction_id", m.auction_status("bid_to_cover_ratio").alias("status"))


@query("pct_change", using("typed", f"""SELECT auction_id, security_type, {near('change', 6)} AS change FROM (
    SELECT auction_id, security_type, bid_to_cover_ratio / nullif(lag(bid_to_cover_ratio) OVER (
    PARTITION BY security_type ORDER BY auction_date, auction_id), 0) - 1 AS change
    FROM typed WHERE bid_to_cover_ratio IS NOT NULL)"""))
def _(spark, sf):
    present = v.typed_auctions(spark, sf).select(
        "security_type", *ID_ORDER, "bid_to_cover_ratio").dropna(subset=["bid_to_cover_ratio"])
    return settled(rolling.pct_change(present, "bid_to_cover_ratio", ID_ORDER, ["security_type"])
                   .select("auction_id", "security_type", "change"), 6)


@query("zscore", using("typed", """SELECT auction_id, round((bid_to_cover_ratio - mean) / nullif(std, 0), 6) AS z_score
    FROM typed CROSS JOIN (SELECT avg(bid_to_cover_ratio) AS mean, stddev_samp(bid_to_cover_ratio) AS std FROM typed)"""))
def _(spark, sf):
    return rounded(corr.zscore(v.typed_auctions(spark, sf), "bid_to_cover_ratio").select(
        "auction_id", "z_score"))


@query("zscore_by_type", using("typed", """SELECT auction_id, security_type,
    round((bid_to_cover_ratio - mean) / nullif(std, 0), 6) AS z_score
    FROM typed JOIN (SELECT security_type AS st, avg(bid_to_cover_ratio) AS mean,
    stddev_samp(bid_to_cover_ratio) AS std FROM typed GROUP BY 1) ON security_type = st"""))
def _(spark, sf):
    return rounded(corr.zscore(v.typed_auctions(spark, sf), "bid_to_cover_ratio", ["security_type"])
                   .select("auction_id", "security_type", "z_score"))


# --- joins -------------------------------------------------------------------------------


@query("auctions_with_security", using("typed", """SELECT auction_id, cusip, auction_date,
    security_type, security_term, bid_to_cover_ratio FROM typed"""))
def _(spark, sf):
    return v.typed_auctions(spark, sf).select(
        "auction_id", "cusip", "auction_date", "security_type", "security_term", "bid_to_cover_ratio")


_FACT = ", ".join([*joins.AUCTION_COLUMNS, "security_type", "security_term",
                   "security_interest_rate", *joins.BIDDER_COLUMNS])


@query("auction_facts", using("facts", f"SELECT {_FACT} FROM facts WHERE auction_date >= DATE '{START}'"))
def _(spark, sf):
    return v.facts(spark, sf, START)


@query("auction_facts_bucketed", using("facts", f"SELECT {_FACT} FROM facts WHERE auction_date >= DATE '{START}'"))
def _(spark, sf):
    """The fact over tables stored in buckets: written once, joined without a shuffle."""
    stored = FactTables(spark, scratch(spark), f"facts_{uuid.uuid4().hex}", buckets=8)
    stored.save(v.auctions(spark, sf), v.securities(spark, sf), v.bidders(spark, sf))
    return stored.facts(START)


@query("bidder_facts", using("typed bidders", """SELECT t.auction_id, t.security_type,
    b.indirect_bidder_percentage, b.fima_accepted FROM typed t JOIN bidders b ON t.auction_id = b.auction_id"""))
def _(spark, sf):
    return joins.bidder_facts(v.auctions(spark, sf), v.securities(spark, sf), v.bidders(spark, sf)).select(
        "auction_id", "security_type", "indirect_bidder_percentage", "fima_accepted")


@query("orphan_auctions", using("auctions securities", """SELECT auction_id, cusip FROM auctions a
    WHERE NOT EXISTS (SELECT 1 FROM securities s WHERE s.cusip = a.cusip)"""))
def _(spark, sf):
    return joins.orphans(v.auctions(spark, sf), v.securities(spark, sf), "cusip", ["auction_id", "cusip"])


@query("orphan_bidders", using("auctions bidders", """SELECT auction_id FROM bidders b
    WHERE NOT EXISTS (SELECT 1 FROM auctions a WHERE a.auction_id = b.auction_id)"""))
def _(spark, sf):
    return joins.orphans(v.bidders(spark, sf), v.auctions(spark, sf), "auction_id", ["auction_id"])


@query("auctions_without_bidders", using("auctions bidders", """SELECT auction_id, cusip FROM auctions a
    WHERE NOT EXISTS (SELECT 1 FROM bidders b WHERE a.auction_id = b.auction_id)"""))
def _(spark, sf):
    return joins.orphans(v.auctions(spark, sf), v.bidders(spark, sf), "auction_id", ["auction_id", "cusip"])


# Parents of which some are missing, so that there are orphans to find.
_LOST = {"known": "SELECT * FROM securities WHERE cusip % 10 <> 3", "listed": "SELECT * FROM auctions WHERE auction_id % 8 <> 5"}


@query("orphan_auctions_lost", using("auctions securities", """SELECT auction_id, cusip FROM auctions a
    WHERE NOT EXISTS (SELECT 1 FROM known s WHERE s.cusip = a.cusip)""", known=_LOST["known"]))
def _(spark, sf):
    known = v.securities(spark, sf).filter("cusip % 10 <> 3")
    return joins.orphans(v.auctions(spark, sf), known, "cusip", ["auction_id", "cusip"])


@query("orphan_bidders_lost", using("auctions bidders", """SELECT auction_id FROM bidders b
    WHERE NOT EXISTS (SELECT 1 FROM listed a WHERE a.auction_id = b.auction_id)""", listed=_LOST["listed"]))
def _(spark, sf):
    listed = v.auctions(spark, sf).filter("auction_id % 8 <> 5")
    return joins.orphans(v.bidders(spark, sf), listed, "auction_id", ["auction_id"])


# --- aggregations ------------------------------------------------------------------------


@query("overview_kpis", using("facts", f"""SELECT count(*) AS total_auctions,
    count(*) FILTER (WHERE auction_date >= DATE '{AS_OF}' - 30) AS last_30_days,
    round(avg(bid_to_cover_ratio), 8) AS avg_bid_to_cover,
    round(coalesce(sum(offering_amount), 0) / 1e9, 8) AS total_offered_b,
    round(arg_max(high_yield, (auction_date, auction_id)) FILTER (WHERE high_yield IS NOT NULL), 8) AS latest_yield,
    round(avg(fima_percentage), 8) AS avg_fima_pct, round(avg(soma_percentage), 8) AS avg_soma_pct,
    round(coalesce(sum(competitive_accepted), 0) / 1e9, 8) AS competitive_b,
    round(coalesce(sum(noncompetitive_accepted), 0) / 1e9, 8) AS noncompetitive_b FROM facts"""))
def _(spark, sf):
    return rounded(agg.overview_kpis(v.facts(spark, sf), AS_OF), 8)


@query("value_counts", using("typed", """SELECT security_type, count(*) AS n FROM typed
    WHERE security_type IS NOT NULL GROUP BY security_type"""))
def _(spark, sf):
    return agg.value_counts(v.typed_auctions(spark, sf), "security_type")


@query("mean_complete_cases", using("facts", """SELECT 'primary_dealer_percentage' AS measure,
    round(avg(primary_dealer_percentage), 8) AS mean FROM facts
    WHERE primary_dealer_percentage IS NOT NULL AND indirect_bidder_percentage IS NOT NULL
    UNION ALL SELECT 'indirect_bidder_percentage', round(avg(indirect_bidder_percentage), 8) FROM facts
    WHERE primary_dealer_percentage IS NOT NULL AND indirect_bidder_percentage IS NOT NULL"""))
def _(spark, sf):
    return rounded(agg.mean_complete_cases(
        v.facts(spark, sf), ["primary_dealer_percentage", "indirect_bidder_percentage"]), 8)


_DAILY = ["bid_to_cover_ratio", "avg_high_yield", "avg_low_yield", "ten_year_yield",
          "two_year_yield", "five_year_yield", "thirty_year_yield", "primary_dealer_share",
          "direct_bidder_share", "indirect_bidder_share", "fima_share", "soma_share", "yield_spread"]
_MILLIONS = ["fima_accepted_millions", "soma_accepted_millions", "avg_offering_millions",
             "total_accepted_millions"]


@query("daily_auction_rollup", using("auctions_daily", f"""SELECT date, auction_count,
    {nears(*_DAILY, digits=9)}, {nears(*_MILLIONS, digits=10)} FROM auctions_daily"""))
def _(spark, sf):
    return settled(v.auctions_daily(spark, sf), 9, **dict.fromkeys(_MILLIONS, 10))


@query("weekly_rollup", using("weekly", f"""SELECT week, auction_count,
    {nears('avg_btc', 'std_btc', 'avg_yield', digits=9)} FROM weekly"""))
def _(spark, sf):
    return settled(agg.weekly_rollup(v.typed_auctions(spark, sf), AS_OF), 9)


@query("participation_by_type", using("facts", """SELECT security_type,
    round(avg(fima_percentage), 8) AS fima_percentage, round(avg(soma_percentage), 8) AS soma_percentage,
    round(coalesce(sum(fima_accepted), 0), 2) AS fima_accepted,
    round(coalesce(sum(soma_accepted), 0), 2) AS soma_accepted,
    round(coalesce(sum(fima_accepted), 0) / 1e9, 8) AS fima_accepted_b,
    round(coalesce(sum(soma_accepted), 0) / 1e9, 8) AS soma_accepted_b
    FROM facts WHERE fima_percentage IS NOT NULL OR soma_percentage IS NOT NULL GROUP BY security_type"""))
def _(spark, sf):
    return rounded(agg.participation_by_type(v.facts(spark, sf)), 8, fima_accepted=2, soma_accepted=2)


@query("stats_by_group", using("typed", """SELECT security_type, count(bid_to_cover_ratio) AS n,
    round_even(avg(bid_to_cover_ratio), 3) AS mean, round_even(stddev_samp(bid_to_cover_ratio), 3) AS std,
    round_even(min(bid_to_cover_ratio), 3) AS min, round_even(max(bid_to_cover_ratio), 3) AS max
    FROM typed GROUP BY security_type"""))
def _(spark, sf):
    return agg.stats_by_group(v.typed_auctions(spark, sf), "security_type", "bid_to_cover_ratio")


@query("avg_btc_by_type", using("typed", f"""SELECT security_type, round(avg(bid_to_cover_ratio), 3) AS avg_btc,
    count(*) AS n FROM typed WHERE auction_date >= DATE '{AS_OF}' - 90 AND bid_to_cover_ratio IS NOT NULL
    GROUP BY security_type"""))
def _(spark, sf):
    return agg.avg_btc_by_type(v.typed_auctions(spark, sf), AS_OF)


_COVERED = ["bid_to_cover_ratio", "total_accepted", "offering_amount", "auction_date"]


@query("null_coverage", using("auctions", " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) - count({c}) AS nulls FROM auctions" for c in _COVERED)))
def _(spark, sf):
    return agg.null_coverage(v.auctions(spark, sf), _COVERED)


@query("row_counts", using("auctions securities bidders", """SELECT 'auctions' AS "table", count(*) AS "rows" FROM auctions
    UNION ALL SELECT 'securities', count(*) FROM securities UNION ALL SELECT 'bidder_details', count(*) FROM bidders"""))
def _(spark, sf):
    return agg.row_counts({"auctions": v.auctions(spark, sf), "securities": v.securities(spark, sf),
                           "bidder_details": v.bidders(spark, sf)})


@query("status_counts", using("auctions", """SELECT CASE WHEN bid_to_cover_ratio IS NULL THEN 'PENDING'
    ELSE 'RESULTS' END AS status, count(*) AS n FROM auctions GROUP BY 1"""))
def _(spark, sf):
    return agg.status_counts(v.auctions(spark, sf))


@query("coverage_window", using("auctions", f"""SELECT min(auction_date) AS min_date,
    max(auction_date) AS max_date, count(*) FILTER (WHERE auction_date >= DATE '{AS_OF}' - 30) AS last_30d
    FROM auctions"""))
def _(spark, sf):
    return agg.coverage_window(v.auctions(spark, sf), AS_OF)


@query("fed_kpis", using("facts", """SELECT round(avg(fima_percentage), 8) AS avg_fima_pct,
    round(coalesce(sum(fima_accepted), 0) / 1e9, 8) AS total_fima_b,
    round(avg(soma_percentage), 8) AS avg_soma_pct,
    round(coalesce(sum(soma_accepted), 0) / 1e9, 8) AS total_soma_b
    FROM facts WHERE fima_percentage IS NOT NULL OR soma_percentage IS NOT NULL"""))
def _(spark, sf):
    return rounded(agg.fed_kpis(v.facts(spark, sf)), 8)


def _stress(direction: str) -> str:
    return using("facts", f"""SELECT round(e.recent_btc, 8) AS recent_btc,
        round(h.historical_btc, 8) AS historical_btc,
        round((e.recent_btc / h.historical_btc - 1) * 100, 8) AS btc_change_pct,
        round(s.avg_yield_spread, 8) AS avg_yield_spread,
        round(e.recent_fima_pct, 8) AS recent_fima_pct, round(e.recent_soma_pct, 8) AS recent_soma_pct
        FROM (SELECT avg(bid_to_cover_ratio) AS recent_btc, avg(fima_percentage) AS recent_fima_pct,
              avg(soma_percentage) AS recent_soma_pct FROM (SELECT * FROM facts
              ORDER BY auction_date {direction}, auction_id {direction} LIMIT 20)) e
        CROSS JOIN (SELECT avg(bid_to_cover_ratio) AS historical_btc FROM facts) h
        CROSS JOIN (SELECT avg(high_yield - low_yield) AS avg_yield_spread FROM (SELECT * FROM facts
              WHERE high_yield IS NOT NULL AND low_yield IS NOT NULL
              ORDER BY auction_date {direction}, auction_id {direction} LIMIT 20)) s""")


@query("stress_kpis_newest", _stress("DESC"))
def _(spark, sf):
    return rounded(agg.stress_kpis(v.facts(spark, sf)), 8)


@query("stress_kpis_oldest", _stress("ASC"))
def _(spark, sf):
    return rounded(agg.stress_kpis(v.facts(spark, sf), edge="oldest"), 8)


@query("pct_sum_check", using("bidders", """SELECT auction_id, round(coalesce(primary_dealer_percentage, 0)
    + coalesce(direct_bidder_percentage, 0) + coalesce(indirect_bidder_percentage, 0), 6) AS pct_sum
    FROM bidders ORDER BY auction_id DESC LIMIT 15"""))
def _(spark, sf):
    return rounded(agg.pct_sum_check(v.bidders(spark, sf)))


# --- correlation, anomalies, stress ------------------------------------------------------


def r_sql(a: str, b: str, digits: int = 6) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), {digits}) END"


def matrix_sql(source: str, columns: list[str], group: str = "", having: str = "") -> str:
    lead = f"{group}, " if group else ""
    tail = (f" GROUP BY {group}" if group else "") + (f" HAVING {having}" if having else "")
    return " UNION ALL ".join(
        f"SELECT {lead}'{a}' AS col_a, '{b}' AS col_b, {r_sql(a, b)} AS r, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_obs FROM {source}{tail}"
        for a in columns for b in columns)


_LISTWISE = ["bid_to_cover_ratio", "high_yield", "offering_amount", "primary_dealer_percentage",
             "indirect_bidder_percentage", "fima_percentage", "soma_percentage"]
_PAIRWISE = ["bid_to_cover_ratio", "high_yield", "primary_dealer_percentage",
             "indirect_bidder_percentage"]


@query("corr_matrix_listwise", using(
    "facts", matrix_sql("complete", _LISTWISE, "security_type", "count(*) > 10"),
    complete="SELECT * FROM facts WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _LISTWISE)))
def _(spark, sf):
    return rounded(corr.corr_matrix_listwise(v.facts(spark, sf), _LISTWISE, ["security_type"]))


@query("corr_matrix_pairwise", using(
    "facts", matrix_sql("recent", _PAIRWISE, "security_type", "count(*) > 30"),
    recent=f"SELECT * FROM facts WHERE auction_date >= DATE '{START}'"))
def _(spark, sf):
    return rounded(corr.corr_matrix(v.facts(spark, sf, START), _PAIRWISE, ["security_type"], 31))


@query("ols_trendline_by_type", using("facts", """SELECT security_type,
    round(regr_slope(bid_to_cover_ratio, high_yield), 6) AS slope,
    round(regr_intercept(bid_to_cover_ratio, high_yield), 6) AS intercept,
    round(regr_r2(bid_to_cover_ratio, high_yield), 6) AS r2,
    CAST(regr_count(bid_to_cover_ratio, high_yield) AS BIGINT) AS n_obs
    FROM facts GROUP BY security_type HAVING regr_count(bid_to_cover_ratio, high_yield) >= 10"""))
def _(spark, sf):
    return rounded(corr.ols_trendline(v.facts(spark, sf), "high_yield", "bid_to_cover_ratio", ["security_type"]))


@query("detect_anomalies", using("typed", """SELECT auction_id, security_type, auction_date,
    bid_to_cover_ratio, round(z, 6) AS z_score FROM (
    SELECT t.*, abs((bid_to_cover_ratio - mean) / nullif(std, 0)) AS z FROM typed t JOIN (
    SELECT security_type AS st, avg(bid_to_cover_ratio) AS mean, stddev_samp(bid_to_cover_ratio) AS std
    FROM typed GROUP BY 1) ON security_type = st WHERE bid_to_cover_ratio IS NOT NULL) WHERE z > 2.5"""))
def _(spark, sf):
    return rounded(corr.detect_anomalies(v.typed_auctions(spark, sf), threshold=2.5).select(
        "auction_id", "security_type", "auction_date", "bid_to_cover_ratio", "z_score"))


@query("market_stress_index", using("weekly", """SELECT week, auction_count, round(btc_z, 6) AS btc_zscore,
    round(yield_z, 6) AS yield_zscore, round(vol_z, 6) AS volatility_zscore,
    round((-btc_z + yield_z + vol_z) / 3, 6) AS stress_index FROM (
    SELECT week, auction_count, (avg_btc - m1) / nullif(s1, 0) AS btc_z,
    (avg_yield - m2) / nullif(s2, 0) AS yield_z, (std_btc - m3) / nullif(s3, 0) AS vol_z
    FROM weekly CROSS JOIN (SELECT avg(avg_btc) AS m1, stddev_samp(avg_btc) AS s1,
    avg(avg_yield) AS m2, stddev_samp(avg_yield) AS s2, avg(std_btc) AS m3, stddev_samp(std_btc) AS s3
    FROM weekly))"""))
def _(spark, sf):
    stress = corr.market_stress_index(agg.weekly_rollup(v.typed_auctions(spark, sf), AS_OF))
    return rounded(stress.select("week", "auction_count", "btc_zscore", "yield_zscore",
                                 "volatility_zscore", "stress_index"))


# --- rolling windows ---------------------------------------------------------------------

_BY_TYPE = "PARTITION BY security_type ORDER BY auction_date, auction_id"


def _frame(rows: int, over: str) -> str:
    return f"OVER ({over} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


@query("rolling_mean_by_type", using("typed", f"""SELECT auction_id, security_type,
    {near('avg(bid_to_cover_ratio) ' + _frame(30, _BY_TYPE), 9)} AS moving_avg
    FROM typed WHERE bid_to_cover_ratio IS NOT NULL"""))
def _(spark, sf):
    rows = v.typed_auctions(spark, sf).select("security_type", *ID_ORDER, "bid_to_cover_ratio")
    return settled(rolling.rolling_mean(rows, "bid_to_cover_ratio", ID_ORDER, ["security_type"])
                   .select("auction_id", "security_type", "moving_avg"), 9)


@query("rolling_mean_market", using("auctions", f"""SELECT auction_id,
    {near('avg(bid_to_cover_ratio) ' + _frame(30, 'ORDER BY auction_date, auction_id'), 9)} AS moving_avg
    FROM auctions WHERE bid_to_cover_ratio IS NOT NULL"""))
def _(spark, sf):
    rows = v.auctions(spark, sf).select(*ID_ORDER, "bid_to_cover_ratio")
    return settled(rolling.rolling_mean(rows, "bid_to_cover_ratio", ID_ORDER).select(
        "auction_id", "moving_avg"), 9)


@query("rolling_std_by_type", using("typed", f"""SELECT auction_id, security_type, round(s, 7) AS volatility
    FROM (SELECT auction_id, security_type, CASE WHEN count(bid_to_cover_ratio) {_frame(30, _BY_TYPE)} >= 5
    THEN stddev_samp(bid_to_cover_ratio) {_frame(30, _BY_TYPE)} END AS s FROM typed) WHERE s IS NOT NULL"""))
def _(spark, sf):
    rows = v.typed_auctions(spark, sf).select("security_type", *ID_ORDER, "bid_to_cover_ratio")
    return rounded(rolling.rolling_std(rows, "bid_to_cover_ratio", ID_ORDER, ["security_type"])
                   .select("auction_id", "security_type", "volatility"), 7)


@query("annualized_volatility", using("typed", f"""SELECT auction_id, security_type,
    {near('btc_returns', 6)} AS btc_returns, round(CASE WHEN count(btc_returns) {_frame(30, _BY_TYPE)} >= 10
    THEN stddev_samp(btc_returns) {_frame(30, _BY_TYPE)} END * sqrt(252) + 1e-9, 6) AS volatility FROM (
    SELECT auction_id, auction_date, security_type, bid_to_cover_ratio /
    nullif(lag(bid_to_cover_ratio) OVER ({_BY_TYPE}), 0) - 1 AS btc_returns
    FROM typed WHERE bid_to_cover_ratio IS NOT NULL)"""))
def _(spark, sf):
    rows = v.typed_auctions(spark, sf).select("security_type", *ID_ORDER, "bid_to_cover_ratio")
    volatility = rolling.annualized_volatility(rows, "bid_to_cover_ratio", ID_ORDER, ["security_type"])
    return settled(volatility.select("auction_id", "security_type", "btc_returns", "volatility"), 6)


# --- rankings ----------------------------------------------------------------------------


@query("latest_completed", using("typed", """SELECT auction_id, auction_date, security_type,
    bid_to_cover_ratio FROM typed WHERE bid_to_cover_ratio IS NOT NULL
    ORDER BY auction_date DESC, auction_id DESC LIMIT 10"""))
def _(spark, sf):
    return ranking.latest_completed(v.typed_auctions(spark, sf))


@query("top_indirect", using("typed bidders", """SELECT t.auction_id, auction_date, security_type,
    indirect_bidder_percentage FROM typed t JOIN bidders b ON t.auction_id = b.auction_id
    WHERE indirect_bidder_percentage IS NOT NULL
    ORDER BY indirect_bidder_percentage DESC, t.auction_id LIMIT 10"""))
def _(spark, sf):
    return ranking.top_indirect(joins.bidder_facts(
        v.auctions(spark, sf), v.securities(spark, sf), v.bidders(spark, sf)))


@query("latest_non_null", using("facts", """SELECT round(arg_max(fima_percentage, (auction_date, auction_id))
    FILTER (WHERE fima_percentage IS NOT NULL), 6) AS fima_percentage FROM facts"""))
def _(spark, sf):
    return rounded(ranking.latest_non_null(v.facts(spark, sf), "fima_percentage", ID_ORDER))


@query("edge_newest", using("facts", """SELECT auction_id, auction_date, bid_to_cover_ratio FROM facts
    ORDER BY auction_date DESC, auction_id DESC LIMIT 20"""))
def _(spark, sf):
    return ranking.edge_n(v.facts(spark, sf), ID_ORDER).select("auction_id", "auction_date", "bid_to_cover_ratio")


@query("edge_oldest", using("facts", """SELECT auction_id, auction_date, bid_to_cover_ratio FROM facts
    ORDER BY auction_date, auction_id LIMIT 20"""))
def _(spark, sf):
    return ranking.edge_n(v.facts(spark, sf), ID_ORDER, edge="oldest").select(
        "auction_id", "auction_date", "bid_to_cover_ratio")


@query("recent_tendered", using("auctions", f"""SELECT auction_id, total_accepted, bid_to_cover_ratio,
    {v.TENDERED} AS approx_total_tendered FROM auctions
    WHERE total_accepted IS NOT NULL AND bid_to_cover_ratio IS NOT NULL ORDER BY auction_id DESC LIMIT 20"""))
def _(spark, sf):
    return _as_double(ranking.recent_tendered(_exact_auctions(spark, sf)))


@query("recent_btc_check", using("auctions", """SELECT auction_id, auction_date, total_tendered,
    total_accepted, bid_to_cover_ratio, round(total_tendered / nullif(total_accepted, 0), 3) AS calc_btc,
    round(bid_to_cover_ratio - total_tendered / nullif(total_accepted, 0), 3) AS diff FROM auctions
    WHERE total_tendered IS NOT NULL AND total_accepted IS NOT NULL
    ORDER BY auction_date DESC, auction_id DESC LIMIT 15"""))
def _(spark, sf):
    return ranking.recent_btc_check(v.auctions(spark, sf))


@query("last_auction_date", using("auctions", "SELECT max(auction_date) AS last_auction_date FROM auctions"))
def _(spark, sf):
    return ranking.last_auction_date(v.auctions(spark, sf))


@query("sort_chronological", using("auctions", """SELECT auction_id, auction_date, bid_to_cover_ratio
    FROM auctions ORDER BY auction_date, auction_id"""))
def _(spark, sf):
    return ranking.sort_chronological(v.auctions(spark, sf)).select(
        "auction_id", "auction_date", "bid_to_cover_ratio")


# --- reshaping ---------------------------------------------------------------------------


@query("concat_frames", using("auctions bidders", """SELECT auction_id, auction_date, NULL::DOUBLE AS fima_accepted
    FROM auctions UNION ALL SELECT auction_id, NULL::DATE, fima_accepted FROM bidders"""))
def _(spark, sf):
    return reshape.concat(v.auctions(spark, sf).select("auction_id", "auction_date"),
                          v.bidders(spark, sf).select("auction_id", "fima_accepted"))


_BARS = ["fima_percentage", "soma_percentage"]


@query("participation_long", using("facts", " UNION ALL ".join(
    f"""SELECT security_type, '{c}' AS series, round(avg({c}), 8) AS value FROM facts
    WHERE fima_percentage IS NOT NULL OR soma_percentage IS NOT NULL GROUP BY security_type""" for c in _BARS)))
def _(spark, sf):
    return rounded(reshape.to_long(agg.participation_by_type(v.facts(spark, sf)), ["security_type"], _BARS), 8)


@query("type_series_fima", using("facts", """SELECT auction_id, auction_date, security_type,
    fima_percentage AS value, fima_accepted FROM facts WHERE fima_percentage IS NOT NULL"""))
def _(spark, sf):
    return reshape.type_series(v.facts(spark, sf), "fima_percentage", ("fima_accepted",))


@query("type_series_soma", using("facts", """SELECT auction_id, auction_date, security_type,
    soma_percentage AS value, soma_accepted FROM facts WHERE soma_percentage IS NOT NULL"""))
def _(spark, sf):
    return reshape.type_series(v.facts(spark, sf), "soma_percentage", ("soma_accepted",))


@query("type_series_spread", using("facts", """SELECT auction_id, auction_date, security_type,
    round(high_yield - low_yield, 6) AS value FROM facts WHERE high_yield IS NOT NULL AND low_yield IS NOT NULL"""))
def _(spark, sf):
    return rounded(reshape.type_series(flt.yield_spread(v.facts(spark, sf)), "yield_spread"))


@query("type_series_discount", using("facts", """SELECT auction_id, auction_date, security_type,
    round(high_discount_rate - low_discount_rate, 6) AS value FROM facts
    WHERE high_discount_rate IS NOT NULL AND low_discount_rate IS NOT NULL"""))
def _(spark, sf):
    return rounded(reshape.type_series(flt.yield_spread(
        v.facts(spark, sf), "high_discount_rate", "low_discount_rate", "discount_spread"), "discount_spread"))


@query("type_series_fed_total", using("facts", """SELECT auction_id, auction_date, security_type,
    round(coalesce(fima_percentage, 0) + coalesce(soma_percentage, 0), 6) AS value FROM facts
    WHERE fima_percentage IS NOT NULL OR soma_percentage IS NOT NULL"""))
def _(spark, sf):
    return rounded(reshape.type_series(flt.fed_participation(v.facts(spark, sf)), "fed_total_pct"))


@query("scatter_btc_by_type", using("typed", """SELECT auction_id, security_type, auction_date AS x,
    bid_to_cover_ratio AS y FROM typed WHERE bid_to_cover_ratio IS NOT NULL"""))
def _(spark, sf):
    present = v.typed_auctions(spark, sf).dropna(subset=["bid_to_cover_ratio"])
    return reshape.scatter_pairs(present, "auction_date", "bid_to_cover_ratio", ("auction_id", "security_type"))


@query("project_available", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def _(spark, sf):
    return reshape.project_available(
        v.table(spark, sf, "orders"), ["o_orderkey", "o_orderdate", "no_such_field", "o_orderdate", "o_totalprice"])


@query("append_new", """SELECT c_custkey AS cusip, c_name AS name, 'incoming' AS origin FROM customer
    WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
    UNION ALL SELECT s_suppkey, s_name, 'existing' FROM supplier""")
def _(spark, sf):
    existing = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("cusip"), F.col("s_name").alias("name"), F.lit("existing").alias("origin"))
    incoming = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cusip"), F.col("c_name").alias("name"), F.lit("incoming").alias("origin"))
    return joins.append_new(existing, incoming)


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(spark, sf):
    from tenderlens.operators.merge import duplicate_keys
    return duplicate_keys(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("unit_scale", using("facts", """SELECT auction_id, round(offering_amount / 1e6, 9) AS offering_millions,
    round(total_accepted / 1e9, 12) AS accepted_billions FROM facts"""))
def _(spark, sf):
    return rounded(v.facts(spark, sf).select(
        "auction_id", m.scaled("offering_amount", m.MILLION).alias("offering_millions"),
        m.scaled("total_accepted", m.BILLION).alias("accepted_billions")), 9, accepted_billions=12)
