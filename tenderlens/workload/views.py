"""The driver tables seen as auction and news tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions.measures import approx_tendered, share_pct
from tenderlens.operators.aggregates import daily_auction_rollup
from tenderlens.operators.articles import classify
from tenderlens.operators.joins import auction_facts, auctions_with_security, daily_join
from tenderlens.operators.policy_index import daily_article_counts, normalized_index

AS_OF = "2001-08-01"
START = "1996-01-01"

# The prose of the test documents is invented, so the test terms are invented words as well.
TEST_TERMS = {
    "america": ["inth", "ention"], "tariffs_trade": ["blees", "whst"],
    "tax": ["erblest", "ouor"], "budget_debt": ["eleau"],
}

# A short list in the four languages of the documents.
TEST_STOPWORDS = ["the", "of", "and", "to", "in", "que", "le", "la", "de", "et", "un", "une",
                  "les", "des", "der", "die", "und", "das", "el", "los", "y", "en"]

AMOUNTS = ["primary_dealer", "direct_bidder", "indirect_bidder", "fima", "soma", "competitive",
           "noncompetitive", "treasury_retail"]
SHARES = ["primary_dealer", "direct_bidder", "indirect_bidder", "fima", "soma"]


def exact(column: str, precision: int, scale: int):
    return F.col(column).cast(f"decimal({precision},{scale})")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def securities(spark, sf) -> DataFrame:
    term = F.col("c_nationkey") % 5
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cusip"), F.col("c_mktsegment").alias("security_type"),
        F.when(term == 0, "2-Year").when(term == 1, "5-Year").when(term == 2, "10-Year")
        .when(term == 3, "30-Year").otherwise("13-Week").alias("security_term"),
        (F.col("c_acctbal") / 1000.0).alias("interest_rate"))


def auctions(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("auction_id")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total_accepted"),
        F.round(F.sum("l_quantity") / 30.0, 4).alias("bid_to_cover_ratio"),
        (F.max("l_discount") * 100).alias("high_yield"),
        (F.min("l_discount") * 100).alias("low_yield"),
        (F.max("l_tax") * 100).alias("high_discount_rate"),
        (F.min("l_tax") * 100).alias("low_discount_rate"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("auction_id"), F.col("o_custkey").alias("cusip"),
        F.col("o_orderdate").cast("date").alias("auction_date"),
        F.year("o_orderdate").cast("string").alias("auction_date_year"),
        F.col("o_totalprice").alias("offering_amount"))
    return orders.join(lines, "auction_id", "left").withColumns({
        "total_tendered": approx_tendered(exact("total_accepted", 20, 2),
                                          exact("bid_to_cover_ratio", 10, 4)).cast("double"),
        "high_investment_rate": F.col("high_discount_rate") + 1,
        "low_investment_rate": F.col("low_discount_rate") + 1,
        "price_per_100": 100 - F.col("high_yield"),
    })


def bidders(spark, sf) -> DataFrame:
    price, flag, status = F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_linestatus")
    line = F.col("l_linenumber")
    when = {
        "primary_dealer": flag == "A", "direct_bidder": flag == "N", "indirect_bidder": flag == "R",
        "fima": (status == "F") & (line <= 2), "soma": (status == "O") & (line <= 2),
        "competitive": status == "F", "noncompetitive": status == "O", "treasury_retail": line == 1,
    }
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("auction_id")).agg(
        *[F.round(F.sum(F.when(c, price)), 2).alias(f"{who}_accepted") for who, c in when.items()],
        F.round(F.sum(price), 2).alias("accepted"))
    return sums.select(
        "auction_id", *[f"{who}_accepted" for who in AMOUNTS],
        *[share_pct(f"{who}_accepted", "accepted").alias(f"{who}_percentage") for who in SHARES],
        "accepted")


def typed_auctions(spark, sf) -> DataFrame:
    return auctions_with_security(auctions(spark, sf), securities(spark, sf))


def facts(spark, sf, start=None) -> DataFrame:
    return auction_facts(auctions(spark, sf), securities(spark, sf), bidders(spark, sf), start)


def auctions_daily(spark, sf) -> DataFrame:
    return daily_auction_rollup(facts(spark, sf, START))


def articles(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") % 250) * 9).cast("int")).alias("date"),
        F.lower("text").alias("text"))


def flagged_articles(spark, sf) -> DataFrame:
    return classify(articles(spark, sf), "text", TEST_TERMS).drop("text")


def index_daily(spark, sf) -> DataFrame:
    return normalized_index(daily_article_counts(flagged_articles(spark, sf)))


def daily(spark, sf) -> DataFrame:
    return daily_join(auctions_daily(spark, sf), index_daily(spark, sf))


# --- the same views as SQL ---------------------------------------------------------------

def _count(term: str) -> str:
    return f"CAST((length(text) - length(replace(text, '{term}', ''))) / {len(term)} AS BIGINT)"


def hits_sql(category: str) -> str:
    return "(" + " + ".join(_count(t) for t in TEST_TERMS[category]) + ")"


_MATCHED = " + ".join(f"CAST({hits_sql(c)} > 0 AS INT)" for c in TEST_TERMS)

_ARTICLE_DATE = "DATE '1995-01-01' + CAST((doc_id % 250) * 9 AS INT)"

# Exact decimal arithmetic, as the stored tables have it; both engines round it half up.
TENDERED = ("CAST(round(CAST(total_accepted AS DECIMAL(20,2)) * "
            "CAST(bid_to_cover_ratio AS DECIMAL(10,4)), 2) AS DOUBLE)")

CTES = {
    "securities": """SELECT c_custkey AS cusip, c_mktsegment AS security_type,
        CASE c_nationkey % 5 WHEN 0 THEN '2-Year' WHEN 1 THEN '5-Year' WHEN 2 THEN '10-Year'
             WHEN 3 THEN '30-Year' ELSE '13-Week' END AS security_term,
        c_acctbal / 1000.0 AS interest_rate FROM customer""",
    "lines": """SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total_accepted,
        round(sum(l_quantity) / 30.0, 4) AS bid_to_cover_ratio,
        max(l_discount) * 100 AS high_yield, min(l_discount) * 100 AS low_yield,
        max(l_tax) * 100 AS high_discount_rate, min(l_tax) * 100 AS low_discount_rate
        FROM lineitem GROUP BY l_orderkey""",
    "auctions": f"""SELECT o.o_orderkey AS auction_id, o.o_custkey AS cusip,
        CAST(o.o_orderdate AS DATE) AS auction_date,
        CAST(year(o.o_orderdate) AS VARCHAR) AS auction_date_year,
        o.o_totalprice AS offering_amount, l.total_accepted, l.bid_to_cover_ratio, l.high_yield,
        l.low_yield, l.high_discount_rate, l.low_discount_rate,
        {TENDERED} AS total_tendered,
        l.high_discount_rate + 1 AS high_investment_rate,
        l.low_discount_rate + 1 AS low_investment_rate, 100 - l.high_yield AS price_per_100
        FROM orders o LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey""",
    "bidder_amounts": """SELECT l_orderkey AS auction_id,
        round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 2) AS primary_dealer_accepted,
        round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 2) AS direct_bidder_accepted,
        round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS indirect_bidder_accepted,
        round(sum(CASE WHEN l_linestatus = 'F' AND l_linenumber <= 2 THEN l_extendedprice END), 2) AS fima_accepted,
        round(sum(CASE WHEN l_linestatus = 'O' AND l_linenumber <= 2 THEN l_extendedprice END), 2) AS soma_accepted,
        round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2) AS competitive_accepted,
        round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 2) AS noncompetitive_accepted,
        round(sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice END), 2) AS treasury_retail_accepted,
        round(sum(l_extendedprice), 2) AS accepted FROM lineitem GROUP BY l_orderkey""",
    "bidders": "SELECT *, " + ", ".join(
        f"CASE WHEN {w}_accepted <> 0 AND accepted > 0 THEN round({w}_accepted / accepted * 100, 2) END "
        f"AS {w}_percentage" for w in SHARES) + " FROM bidder_amounts",
    "typed": """SELECT a.*, s.security_type, s.security_term, s.interest_rate AS security_interest_rate
        FROM auctions a JOIN securities s ON a.cusip = s.cusip""",
    "facts": """SELECT t.*, b.* EXCLUDE (auction_id, accepted)
        FROM typed t LEFT JOIN bidders b ON t.auction_id = b.auction_id""",
    "auctions_daily": f"""SELECT auction_date AS date,
        avg(bid_to_cover_ratio) AS bid_to_cover_ratio, avg(high_yield) AS avg_high_yield,
        avg(low_yield) AS avg_low_yield,
        avg(CASE WHEN security_term = '10-Year' THEN high_yield END) AS ten_year_yield,
        avg(CASE WHEN security_term = '2-Year' THEN high_yield END) AS two_year_yield,
        avg(CASE WHEN security_term = '5-Year' THEN high_yield END) AS five_year_yield,
        avg(CASE WHEN security_term = '30-Year' THEN high_yield END) AS thirty_year_yield,
        avg(primary_dealer_percentage) AS primary_dealer_share,
        avg(direct_bidder_percentage) AS direct_bidder_share,
        avg(indirect_bidder_percentage) AS indirect_bidder_share,
        avg(fima_percentage) AS fima_share, avg(soma_percentage) AS soma_share,
        sum(fima_accepted) / 1000000 AS fima_accepted_millions,
        sum(soma_accepted) / 1000000 AS soma_accepted_millions,
        avg(offering_amount) / 1000000 AS avg_offering_millions,
        sum(total_accepted) / 1000000 AS total_accepted_millions,
        avg(high_yield - low_yield) AS yield_spread, count(*) AS auction_count
        FROM facts WHERE auction_date >= DATE '{START}' GROUP BY auction_date""",
    "articles": f"""SELECT CAST(doc_id AS VARCHAR) AS article_id, {_ARTICLE_DATE} AS date,
        lower(text) AS text FROM documents""",
    "flagged": f"""SELECT article_id, date,
        ({_MATCHED}) >= 2 AND {hits_sql('america')} > 0 AS is_fiscal_article,
        {hits_sql('tariffs_trade')} > 0 AS has_tariff FROM articles""",
    "article_days": """SELECT date, count(article_id) AS total_articles,
        CAST(sum(CAST(is_fiscal_article AS INT)) AS BIGINT) AS fiscal_articles,
        CAST(sum(CAST(has_tariff AS INT)) AS BIGINT) AS tariff_fiscal_articles,
        CAST(sum(CAST(is_fiscal_article AS INT)) - sum(CAST(has_tariff AS INT)) AS BIGINT) AS non_tariff_fiscal_articles
        FROM flagged GROUP BY date""",
    "rated": """SELECT *, fiscal_articles * 1.0::DOUBLE / total_articles AS rate,
        tariff_fiscal_articles * 1.0::DOUBLE / total_articles AS tariff_rate,
        non_tariff_fiscal_articles * 1.0::DOUBLE / total_articles AS non_tariff_rate FROM article_days""",
    "index_daily": """SELECT r.*, r.rate / nullif(m.a, 0) * 100 AS fiscal_policy_index,
        r.tariff_rate / nullif(m.b, 0) * 100 AS tariff_fiscal_index,
        r.non_tariff_rate / nullif(m.c, 0) * 100 AS non_tariff_fiscal_index
        FROM rated r CROSS JOIN (SELECT avg(rate) AS a, avg(tariff_rate) AS b,
        avg(non_tariff_rate) AS c FROM rated) m""",
    "daily": """SELECT a.*, i.* EXCLUDE (date) FROM auctions_daily a JOIN index_daily i ON a.date = i.date""",
    "weekly": f"""SELECT CAST(date_trunc('week', auction_date) AS DATE) AS week,
        avg(bid_to_cover_ratio) AS avg_btc, stddev_samp(bid_to_cover_ratio) AS std_btc,
        avg(high_yield) AS avg_yield, count(*) AS auction_count
        FROM typed WHERE auction_date >= CAST(DATE '{AS_OF}' - INTERVAL 24 MONTH AS DATE)
        GROUP BY 1""",
}

_NEEDS = {
    "auctions": ["lines"], "bidders": ["bidder_amounts"], "typed": ["auctions", "securities"],
    "facts": ["typed", "bidders"], "auctions_daily": ["facts"], "flagged": ["articles"],
    "article_days": ["flagged"], "rated": ["article_days"], "index_daily": ["rated"],
    "daily": ["auctions_daily", "index_daily"], "weekly": ["typed"],
}


def using(names: str, body: str, **extra: str) -> str:
    """``body`` with the named views (and what they need) in front; ``extra`` adds own views."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    views = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(views)} {body}"
