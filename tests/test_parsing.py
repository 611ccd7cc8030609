import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tenderlens import schemas
from tenderlens.functions import measures as m
from tenderlens.functions import parsing as ps


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, t string")
    return [r[1] for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]


def test_decimal(spark):
    texts = [None, "", " 12.34565 ", "1e3", "12x", "9999999", "-0.00005", "NaN", " "]
    assert column(spark, texts, ps.parse_decimal("t", 10, 4)) == [
        None, None, Decimal("12.3457"), Decimal("1000.0000"), None, None, Decimal("-0.0001"), None, None]
    assert column(spark, texts, ps.malformed_decimal("t", 10, 4)) == [
        False, False, False, False, True, True, False, True, True]


def test_dates_and_times(spark):
    texts = ["2025-08-14T00:00:00", "08/14/2025", "8/4/2025", "nonsense", "", None, "2025-02-30"]
    assert column(spark, texts, ps.parse_date("t")) == [
        dt.date(2025, 8, 14), dt.date(2025, 8, 14), dt.date(2025, 8, 4), None, None, None, None]
    assert column(spark, ["2025-08-14T13:05:00", "x", ""], ps.parse_timestamp("t")) == [
        dt.datetime(2025, 8, 14, 13, 5), None, None]


def test_booleans_and_integers(spark):
    assert column(spark, ["Yes", "TRUE", "1", "no", "", None], ps.parse_bool("t")) == [
        True, True, True, False, None, None]
    assert column(spark, ["12", "1.5", "x", ""], ps.parse_int("t")) == [12, None, None, None]
    assert column(spark, ["a", ""], ps.parse_str("t")) == ["a", None]


def test_api_names():
    assert schemas.api_name("fima_accepted") == "fimaNoncompetitiveAccepted"
    assert schemas.api_name("price_per_100") == "pricePer100"
    assert schemas.api_name("bid_to_cover_ratio") == "bidToCoverRatio"
    assert "auctionId" not in schemas.API_FIELDS
    assert len(set(schemas.EXTRACT_FIELDS)) == 27
    assert set(schemas.EXTRACT_FIELDS) <= set(schemas.API_FIELDS)


def test_rename_fields_adds_missing(spark):
    raw = spark.createDataFrame([("C1", "Bill", "4.5")], "cusip string, securityType string, interestRate string")
    row = ps.rename_fields(raw, schemas.received(schemas.SECURITIES)).first()
    assert row["security_type"] == "Bill" and row["interest_rate"] == Decimal("4.500000") and row["call_date"] is None


def test_share_pct(spark):
    rows = spark.createDataFrame(
        [(0, 0.0, 10.0), (1, None, 10.0), (2, 5.0, 0.0), (3, 5.0, None), (4, 1.0, 3.0), (5, 3.0, 3.0)],
        "i int, part double, total double")
    got = [r[0] for r in rows.orderBy("i").select(m.share_pct("part", "total")).collect()]
    assert got == [None, None, None, None, 33.33, 100.0]


def test_labels(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.51), (2, -0.31), (3, 0.3), (4, 0.0)], "i int, r double")
    got = [tuple(r) for r in rows.orderBy("i").select(
        m.correlation_strength("r"), m.correlation_direction("r")).collect()]
    assert got == [("Moderate", "Positive"), ("Strong", "Positive"), ("Moderate", "Negative"),
                   ("Weak", "Positive"), ("Weak", "Negative")]


def test_ratio_uses_unrounded_difference(spark):
    row = spark.createDataFrame([(100.0, 3.0, 33.3333)], "t double, a double, b double").select(
        F.round(m.btc_ratio("t", "a"), 3), F.round(F.col("b") - m.btc_ratio("t", "a"), 3)).first()
    assert tuple(row) == (33.333, -0.0) or tuple(row) == (33.333, 0.0)
