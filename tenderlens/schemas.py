"""Table schemas and the API field map."""

from __future__ import annotations

from pyspark.sql import types as T


def _amount():
    return T.DecimalType(20, 2)


def _rate():
    return T.DecimalType(10, 4)


def _share():
    return T.DecimalType(5, 2)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _B, _I, _L = T.StringType(), T.DateType(), T.BooleanType(), T.IntegerType(), T.LongType()
_TS, _COUPON = T.TimestampNTZType(), T.DecimalType(10, 6)

SECURITIES = _schema(
    cusip=_S, security_type=_S, security_term=_S, original_security_term=_S, series=_S,
    corpus_cusip=_S, interest_rate=_COUPON, tips=_B, floating_rate=_B, callable=_B, call_date=_D,
)

AUCTIONS = _schema(
    auction_id=_L, cusip=_S, announcement_date=_D, auction_date=_D, auction_date_year=_S,
    issue_date=_D, maturity_date=_D, dated_date=_D, maturing_date=_D, auction_format=_S,
    closing_time_competitive=_S, closing_time_noncompetitive=_S, offering_amount=_amount(),
    allocation_percentage=_share(), total_tendered=_amount(), total_accepted=_amount(),
    bid_to_cover_ratio=_rate(), interest_rate=_COUPON, high_yield=_rate(), low_yield=_rate(),
    average_median_yield=_rate(), high_discount_rate=_rate(), low_discount_rate=_rate(),
    high_investment_rate=_rate(), low_investment_rate=_rate(), high_price=_rate(),
    low_price=_rate(), price_per_100=_rate(), updated_timestamp=_TS,
)

BIDDER_DETAILS = _schema(
    auction_id=_L,
    primary_dealer_accepted=_amount(), primary_dealer_percentage=_share(),
    direct_bidder_accepted=_amount(), direct_bidder_percentage=_share(),
    indirect_bidder_accepted=_amount(), indirect_bidder_percentage=_share(),
    fima_accepted=_amount(), fima_percentage=_share(),
    soma_accepted=_amount(), soma_percentage=_share(),
    competitive_accepted=_amount(), noncompetitive_accepted=_amount(),
    treasury_retail_accepted=_amount(),
)

RUNS = _schema(
    run_id=_S, update_timestamp=_TS, records_fetched=_L, records_inserted=_L, records_updated=_L,
    last_auction_date=_D, status=_S, error_message=_S, run_type=_S,
)

ARTICLES = _schema(article_id=_S, date=_D, is_fiscal_article=_B, has_tariff=_B)

SCORES = _schema(
    total_articles=_I, fiscal_articles=_I, tariff_fiscal_articles=_I,
    non_tariff_fiscal_articles=_I, rate=T.DoubleType(), tariff_rate=T.DoubleType(),
    non_tariff_rate=T.DoubleType(), fiscal_policy_index=T.DoubleType(),
    tariff_fiscal_index=T.DoubleType(), non_tariff_fiscal_index=T.DoubleType(),
)

INDICES = _schema(
    date=_D, total_articles=_I, fiscal_articles=_I, tariff_fiscal_articles=_I,
    non_tariff_fiscal_articles=_I, rate=_COUPON, tariff_rate=_COUPON, non_tariff_rate=_COUPON,
    fiscal_policy_index=_rate(), tariff_fiscal_index=_rate(), non_tariff_fiscal_index=_rate(),
)

PHRASES = _schema(phrase=_S, count=_L)

TABLES = {
    "securities": SECURITIES, "auctions": AUCTIONS, "bidder_details": BIDDER_DETAILS,
    "data_updates": RUNS, "fiscal_articles": ARTICLES, "fiscal_policy_indices": INDICES,
    "top_phrases": PHRASES,
}

# API field name of each column of the three auction tables. Where a column is
# absent here its API name is the camelCase form of the column name.
_API_EXCEPTIONS = {"fima_accepted": "fimaNoncompetitiveAccepted"}

# Columns that are computed, not received.
_COMPUTED = {"auction_id"} | {f.name for f in BIDDER_DETAILS if f.name.endswith("_percentage")}


def api_name(column: str) -> str:
    head, *tail = column.split("_")
    return _API_EXCEPTIONS.get(column, head + "".join(word.capitalize() for word in tail))


def received(schema: T.StructType) -> list[tuple[str, str, T.DataType]]:
    """(API field, column, type) for every column of ``schema`` that arrives from the API."""
    return [(api_name(f.name), f.name, f.dataType) for f in schema if f.name not in _COMPUTED]


API_FIELDS = list(dict.fromkeys(
    name for table in (SECURITIES, AUCTIONS, BIDDER_DETAILS) for name, _, _ in received(table)
))

API_RECORD = T.StructType([T.StructField(name, T.StringType(), True) for name in API_FIELDS])

# The flat auction extract, in its column order.
EXTRACT_FIELDS = [
    "cusip", "issueDate", "securityType", "securityTerm", "auctionDateYear", "maturityDate",
    "datedDate", "maturingDate", "auctionFormat", "closingTimeCompetitive", "offeringAmount",
    "allocationPercentage", "totalTendered", "totalAccepted", "bidToCoverRatio", "interestRate",
    "highYield", "lowYield", "averageMedianYield", "highDiscountRate", "lowDiscountRate",
    "highInvestmentRate", "lowInvestmentRate", "highPrice", "lowPrice", "pricePer100",
    "updatedTimestamp",
]
