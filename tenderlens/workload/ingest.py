"""Queries of parsing, staging, keyed merges, files, stored tables and the file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens import schemas
from tenderlens.functions import parsing as ps
from tenderlens.operators import merge
from tenderlens.operators.articles import classify
from tenderlens.operators.ordering import with_position
from tenderlens.operators.policy_index import daily_article_counts
from tenderlens.operators.sections import (extract_sections, parse_article_id, parse_broken_date)
from tenderlens.plans.ingest import AuctionStore, NewsStore, verify_load
from tenderlens.session import DROP_SHUFFLES, materialise, settings
from tenderlens.session import settled as written
from tenderlens.sources import files, records, tables
from tenderlens.streaming.ingest import stream_ingest
from tenderlens.workload import views as v
from tenderlens.workload.market import _as_double
from tenderlens.workload.news import dump_parts
from tenderlens.workload.registry import near, query, scratch, settled
from tenderlens.workload.views import using


ARRAY_RECORDS = 10_000      # records of one array file
LANDED_RECORDS = 200_000    # records of one landing file, some 16 MB: it is compressed, so one task reads it whole


# --- parsing -----------------------------------------------------------------------------

_NUMBER = "CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR)"
_NUMBER_TEXT = f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN ' ' || {_NUMBER} || ' ' WHEN 3 THEN {_NUMBER} || 'x' WHEN 4 THEN '99999999999'
    WHEN 5 THEN '1e3' WHEN 6 THEN 'NaN' ELSE {_NUMBER} END AS t FROM orders"""


def _number_text(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 8
    number = v.exact("o_totalprice", 20, 2).cast("string")
    return v.table(spark, sf, "orders").select("o_orderkey", (
        F.when(k == 1, "").when(k == 2, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(k == 3, F.concat(number, F.lit("x"))).when(k == 4, "99999999999").when(k == 5, "1e3")
        .when(k == 6, "NaN").when(k == 7, number)).alias("t"))


@query("parse_decimal", f"""SELECT o_orderkey, CAST(TRY_CAST(nullif(t, '') AS DECIMAL(12,2)) AS DOUBLE) AS parsed,
    t IS NOT NULL AND t <> '' AND TRY_CAST(nullif(t, '') AS DECIMAL(12,2)) IS NULL AS malformed
    FROM ({_NUMBER_TEXT})""")
def _(spark, sf):
    return _number_text(spark, sf).select(
        "o_orderkey", ps.parse_decimal("t", 12, 2).cast("double").alias("parsed"),
        ps.malformed_decimal("t", 12, 2).alias("malformed"))


_DAY = "CAST(o_orderdate AS DATE)"


@query("parse_date", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN {_DAY} END AS parsed FROM orders""")
def _(spark, sf):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    text = (F.when(k == 0, "").when(k == 1, day.cast("string"))
            .when(k == 2, F.concat(day.cast("string"), F.lit("T00:00:00")))
            .when(k == 3, F.date_format(day, "MM/dd/yyyy")).otherwise("nonsense"))
    return v.table(spark, sf, "orders").select("o_orderkey", text.alias("t")).select(
        "o_orderkey", ps.parse_date("t").alias("parsed"))


@query("parse_timestamp", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) END AS parsed FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, "").otherwise("later")
    return v.table(spark, sf, "events").select("event_id", text.alias("t")).select(
        "event_id", ps.parse_timestamp("t").alias("parsed"))


@query("parse_bool", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE
    WHEN 3 THEN FALSE WHEN 4 THEN NULL END AS parsed FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 6
    text = (F.when(k == 0, "Yes").when(k == 1, "TRUE").when(k == 2, "1").when(k == 3, F.col("event_type"))
            .when(k == 4, ""))
    return v.table(spark, sf, "events").select("event_id", text.alias("t")).select(
        "event_id", ps.parse_bool("t").alias("parsed"))


@query("parse_int_str", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id END AS parsed_int,
    CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type END AS parsed_str FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.col("event_type")).otherwise("")
    return v.table(spark, sf, "events").select("event_id", text.alias("t")).select(
        "event_id", ps.parse_int("t").alias("parsed_int"), ps.parse_str("t").alias("parsed_str"))


# --- raw records -------------------------------------------------------------------------


def raw_records(spark, sf) -> DataFrame:
    """Auctions as API records: text only, few distinct keys, and some faulty fields."""
    f = v.auctions(spark, sf).join(
        v.securities(spark, sf).select("cusip", "security_type", "security_term", "interest_rate"), "cusip").join(
        v.bidders(spark, sf).select("auction_id", *[f"{w}_accepted" for w in v.AMOUNTS]), "auction_id", "left")
    k, day = F.col("auction_id"), F.trunc("auction_date", "month")

    def amount(column):
        return F.coalesce(v.exact(column, 20, 2).cast("string"), F.lit(""))

    def rate(column):
        return F.coalesce(v.exact(column, 10, 4).cast("string"), F.lit(""))

    columns = {
        "cusip": F.concat(F.lit("C"), (F.col("cusip") % 500).cast("string")),
        "securityType": F.col("security_type"), "securityTerm": F.col("security_term"),
        "interestRate": F.when(k % 19 == 0, "n/a").otherwise(
            F.coalesce(v.exact("interest_rate", 10, 6).cast("string"), F.lit(""))),
        "tips": F.when(k % 2 == 0, "Yes").otherwise("No"),
        "auctionDate": F.when(k % 11 == 0, "").when(k % 13 == 0, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.concat(day.cast("string"), F.lit("T00:00:00"))),
        "offeringAmount": amount("offering_amount"), "totalAccepted": amount("total_accepted"),
        "totalTendered": amount("total_tendered"), "bidToCoverRatio": rate("bid_to_cover_ratio"),
        "highYield": F.when(k % 17 == 0, "12x").otherwise(rate("high_yield")),
        **{schemas.api_name(f"{w}_accepted"): F.when(k % 23 == 0, "abc").otherwise(amount(f"{w}_accepted"))
           if w == "primary_dealer" else amount(f"{w}_accepted") for w in v.AMOUNTS},
    }
    return f.select(k.alias("arrival"), *[
        columns.get(n, F.lit(None).cast("string")).alias(n) for n in schemas.API_FIELDS])


def _text_sql(column: str, scale: str) -> str:
    return f"coalesce(CAST(CAST({column} AS DECIMAL({scale})) AS VARCHAR), '')"


_RECORDS = {
    "records": f"""SELECT a.auction_id AS arrival, 'C' || CAST(a.cusip % 500 AS VARCHAR) AS cusip,
    security_type, security_term, a.auction_id % 2 = 0 AS tips,
    CASE WHEN a.auction_id % 19 = 0 THEN 'n/a' ELSE {_text_sql('security_interest_rate', '10,6')} END AS interest_rate,
    CASE WHEN a.auction_id % 11 <> 0 THEN CAST(date_trunc('month', auction_date) AS DATE) END AS auction_date,
    {_text_sql('offering_amount', '20,2')} AS offering_amount, {_text_sql('total_accepted', '20,2')} AS total_accepted,
    CASE WHEN a.auction_id % 17 = 0 THEN '12x' ELSE {_text_sql('high_yield', '10,4')} END AS high_yield,
    CASE WHEN a.auction_id % 23 = 0 THEN 'abc' ELSE {_text_sql('primary_dealer_accepted', '20,2')} END AS primary_dealer,
    {_text_sql('fima_accepted', '20,2')} AS fima
    FROM typed a LEFT JOIN bidders b ON a.auction_id = b.auction_id""",
    "staged": """SELECT *, interest_rate <> 'n/a' AS to_security,
    interest_rate <> 'n/a' AND auction_date IS NOT NULL AND high_yield <> '12x' AS to_auction,
    interest_rate <> 'n/a' AND auction_date IS NOT NULL AND high_yield <> '12x'
        AND coalesce(TRY_CAST(nullif(total_accepted, '') AS DECIMAL(20,2)) > 0, FALSE) AS due FROM records""",
    "judged": """SELECT *, due AND primary_dealer <> 'abc' AS to_bidder, NOT to_security
    OR (to_security AND auction_date IS NOT NULL AND high_yield = '12x')
    OR (due AND primary_dealer = 'abc') AS failed FROM staged""",
    "auction_rows": """SELECT *, row_number() OVER (PARTITION BY cusip, auction_date ORDER BY arrival DESC) AS back,
    min(arrival) OVER (PARTITION BY cusip, auction_date) AS first_arrival FROM judged WHERE to_auction""",
    "numbered": """SELECT *, row_number() OVER (ORDER BY first_arrival) AS auction_id
    FROM auction_rows WHERE back = 1""",
}


def _sql(body: str, *names: str) -> str:
    return using("typed bidders", body, **{n: _RECORDS[n] for n in names})


_ALL = ("records", "staged", "judged", "auction_rows", "numbered")


def _staged(spark, sf):
    return merge.stage_records(raw_records(spark, sf))


@query("rename_api_fields", _sql("""SELECT arrival, cusip, auction_date,
    CAST(TRY_CAST(nullif(offering_amount, '') AS DECIMAL(20,2)) AS DOUBLE) AS offering_amount,
    CAST(TRY_CAST(nullif(high_yield, '') AS DECIMAL(10,4)) AS DOUBLE) AS high_yield FROM records""", "records"))
def _(spark, sf):
    typed = ps.rename_fields(raw_records(spark, sf), schemas.received(schemas.AUCTIONS), ("arrival",))
    return _as_double(typed.select("arrival", "cusip", "auction_date", "offering_amount", "high_yield"))


@query("stage_records", _sql("SELECT arrival, to_security, to_auction, to_bidder, failed FROM judged", *_ALL[:3]))
def _(spark, sf):
    return _staged(spark, sf).select("arrival", "to_security", "to_auction", "to_bidder", "failed")


@query("quarantine", _sql("SELECT arrival FROM judged WHERE failed", *_ALL[:3]))
def _(spark, sf):
    return merge.quarantine(_staged(spark, sf))[1].select("arrival")


@query("upsert_securities", _sql("""SELECT cusip, security_type, security_term, tips,
    CAST(CAST(interest_rate AS DECIMAL(10,6)) AS DOUBLE) AS interest_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY late DESC, arrival DESC) AS back FROM (
    SELECT *, arrival % 2 AS late FROM judged WHERE to_security)) WHERE back = 1""", *_ALL[:3]))
def _(spark, sf):
    rows = merge.securities_from(_staged(spark, sf), "arrival")
    existing = merge.latest_rows(rows.filter("arrival % 2 = 0"), ["cusip"], "arrival")
    merged = merge.upsert(existing, rows.filter("arrival % 2 = 1"), ["cusip"], "arrival")
    return _as_double(merged.select("cusip", "security_type", "security_term", "tips", "interest_rate"))


@query("upsert_auctions", _sql("""SELECT auction_id, cusip, auction_date,
    CAST(CAST(nullif(high_yield, '') AS DECIMAL(10,4)) AS DOUBLE) AS high_yield FROM numbered""", *_ALL))
def _(spark, sf):
    numbered = merge.with_auction_ids(merge.auctions_from(_staged(spark, sf), "arrival"), None)
    return _as_double(numbered.select("auction_id", "cusip", "auction_date", "high_yield"))


@query("upsert_stats", _sql("""SELECT count(*) AS inserted, CAST(sum(n) - count(*) AS BIGINT) AS updated FROM (
    SELECT count(*) AS n FROM judged WHERE to_auction GROUP BY cusip, auction_date)""", *_ALL[:3]))
def _(spark, sf):
    return merge.upsert_stats(None, merge.auctions_from(_staged(spark, sf), "arrival"), ["cusip", "auction_date"])


_BIDDER_SQL = """SELECT cusip, auction_date, CAST(CAST(nullif(primary_dealer, '') AS DECIMAL(20,2)) AS DOUBLE) AS primary_dealer_accepted,
    CASE WHEN CAST(nullif(fima, '') AS DECIMAL(20,2)) <> 0 THEN round(CAST(nullif(fima, '') AS DOUBLE)
        / CAST(total_accepted AS DOUBLE) * 100, 2) END AS fima_percentage FROM (
    SELECT *, row_number() OVER (PARTITION BY cusip, auction_date ORDER BY arrival DESC) AS last
    FROM judged WHERE to_bidder) WHERE last = 1"""


@query("upsert_bidders", _sql(_BIDDER_SQL, *_ALL[:3]))
def _(spark, sf):
    rows = merge.latest_rows(merge.bidders_from(_staged(spark, sf), "arrival"), ["cusip", "auction_date"], "arrival")
    return _as_double(rows.select("cusip", "auction_date", "primary_dealer_accepted", "fima_percentage"))


@query("conform", using("auctions", """SELECT auction_id, CAST(cusip AS VARCHAR) AS cusip, auction_date,
    CAST(CAST(bid_to_cover_ratio AS DECIMAL(10,4)) AS DOUBLE) AS bid_to_cover_ratio,
    NULL::VARCHAR AS auction_format FROM auctions"""))
def _(spark, sf):
    conformed = merge.conform(v.auctions(spark, sf), schemas.AUCTIONS)
    return _as_double(conformed.select("auction_id", "cusip", "auction_date", "bid_to_cover_ratio", "auction_format"))


# --- articles, scores, phrases -----------------------------------------------------------


def _delivered_articles(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    day = F.date_add(F.lit("1995-01-01").cast("date"), ((k % 250) * 9).cast("int"))
    text = F.when(k % 9 == 0, "nonsense").when(k % 7 == 0, "").otherwise(day.cast("string"))
    flags = classify(v.table(spark, sf, "documents").withColumn("low", F.lower("text")), "low", v.TEST_TERMS)
    return flags.select(
        (k % 700).cast("string").alias("article_id"), text.alias("date"), "is_fiscal_article",
        F.when(k % 5 != 0, F.col("has_tariff")).alias("has_tariff"), k.alias("arrival"))


_ARTICLES = """SELECT article_id, date, is_fiscal_article, has_tariff FROM (
    SELECT CAST(CAST(f.article_id AS BIGINT) % 700 AS VARCHAR) AS article_id, date, is_fiscal_article,
    CASE WHEN CAST(f.article_id AS BIGINT) % 5 <> 0 THEN has_tariff ELSE FALSE END AS has_tariff,
    row_number() OVER (PARTITION BY CAST(f.article_id AS BIGINT) % 700 ORDER BY CAST(f.article_id AS BIGINT) DESC) AS last
    FROM flagged f WHERE CAST(f.article_id AS BIGINT) % 9 <> 0 AND CAST(f.article_id AS BIGINT) % 7 <> 0)
    WHERE last = 1"""


@query("upsert_articles", using("flagged", _ARTICLES))
def _(spark, sf):
    return merge.upsert_articles(None, _delivered_articles(spark, sf), "arrival")


def _late(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is stored already (even arrivals) and what comes as a correction (odd ones)."""
    return rows.filter("arrival % 2 = 0"), rows.filter("arrival % 2 = 1")


def _stored_and_corrected(spark, schema, keys, part, stored, late) -> DataFrame:
    """A table after two batches, the second of which rewrites only the folders it touches."""
    table = tables.PartitionedTable(spark, scratch(spark), schema, keys, part)
    table.merge(stored, 0)
    table.merge(late, 1)
    return table.read()


@query("upsert_articles_update", using("flagged", _ARTICLES.replace(
    "ORDER BY CAST", "ORDER BY CAST(f.article_id AS BIGINT) % 2 DESC, CAST")))
def _(spark, sf):
    stored, late = _late(_delivered_articles(spark, sf))
    return _stored_and_corrected(
        spark, schemas.ARTICLES, ["article_id"], tables.hash_folder("article_id", folders=16),
        merge.upsert_articles(None, stored, "arrival"), merge.upsert_articles(None, late, "arrival"))


@query("upsert_bidders_update", _sql(_BIDDER_SQL.replace(
    "ORDER BY arrival DESC", "ORDER BY arrival % 2 DESC, arrival DESC"), *_ALL[:3]))
def _(spark, sf):
    key = ["cusip", "auction_date"]
    stored, late = _late(merge.bidders_from(_staged(spark, sf), "arrival"))
    schema = T.StructType([*[schemas.AUCTIONS[k] for k in key], *schemas.BIDDER_DETAILS.fields])
    merged = _stored_and_corrected(spark, schema, key, F.year("auction_date"), merge.latest_rows(stored, key, "arrival"),
                                   merge.latest_rows(late, key, "arrival"))
    return _as_double(merged.select(*key, "primary_dealer_accepted", "fima_percentage"))


_LATE_AUCTIONS = {
    "ranked": """SELECT *, row_number() OVER (PARTITION BY cusip, auction_date ORDER BY arrival % 2 DESC, arrival DESC) AS back,
    min(arrival % 2) OVER (PARTITION BY cusip, auction_date) AS batch,
    min(arrival) OVER (PARTITION BY cusip, auction_date) AS any_first,
    min(CASE WHEN arrival % 2 = 0 THEN arrival END) OVER (PARTITION BY cusip, auction_date) AS stored_first
    FROM judged WHERE to_auction""",
    "renumbered": """SELECT *, row_number() OVER (ORDER BY batch, CASE WHEN batch = 0 THEN stored_first ELSE any_first END) AS auction_id
    FROM ranked WHERE back = 1""",
}


@query("upsert_auctions_update", using("typed bidders", """SELECT auction_id, cusip, auction_date,
    CAST(CAST(nullif(high_yield, '') AS DECIMAL(10,4)) AS DOUBLE) AS high_yield FROM renumbered""",
    **{n: _RECORDS[n] for n in _ALL[:3]}, **_LATE_AUCTIONS))
def _(spark, sf):
    """Corrections keep the ids of stored auctions, new auctions are numbered after them.

    Ids are looked up in the years that the corrections touch; of the other years only the highest id is read.
    """
    key = ["cusip", "auction_date"]
    stored, late = _late(merge.auctions_from(_staged(spark, sf), "arrival"))
    table = tables.PartitionedTable(spark, scratch(spark), schemas.AUCTIONS, key, F.year("auction_date"))
    table.merge(merge.with_auction_ids(stored, None), 0)
    top = table.read().agg(F.max("auction_id").alias("top")).scalar()
    table.merge(merge.with_auction_ids(late, table.touched(late, before=1), top=top), 1)
    return _as_double(table.read().select("auction_id", *key, "high_yield"))


@query("upsert_stats_update", _sql("""SELECT CAST(count(*) FILTER (WHERE known = 0 AND late > 0) AS BIGINT) AS inserted,
    CAST(sum(late) - count(*) FILTER (WHERE known = 0 AND late > 0) AS BIGINT) AS updated FROM (
    SELECT count(*) FILTER (WHERE arrival % 2 = 0) AS known, count(*) FILTER (WHERE arrival % 2 = 1) AS late
    FROM judged WHERE to_auction GROUP BY cusip, auction_date)""", *_ALL[:3]))
def _(spark, sf):
    stored, late = _late(merge.auctions_from(_staged(spark, sf), "arrival"))
    return merge.upsert_stats(stored, late, ["cusip", "auction_date"])


@query("load_stats", """WITH articles AS (SELECT doc_id AS k, doc_id % 700 AS id FROM documents),
    valid AS (SELECT * FROM articles WHERE k % 9 <> 0 AND k % 7 <> 0),
    ids AS (SELECT id, count(*) FILTER (WHERE k % 2 = 1) AS late, count(*) FILTER (WHERE k % 2 = 0) AS known FROM valid GROUP BY id),
    days AS (SELECT count(DISTINCT (k % 250)) AS n FROM valid WHERE k % 2 = 1),
    phrases AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
    SELECT 'fiscal_articles' AS "table", (SELECT count(*) FROM articles WHERE k % 2 = 1) - sum(late)::BIGINT AS skipped,
        count(*) FILTER (WHERE late > 0 AND known = 0) AS inserted,
        sum(late)::BIGINT - count(*) FILTER (WHERE late > 0 AND known = 0) AS updated FROM ids
    UNION ALL SELECT 'fiscal_policy_indices', count(*) - least(count(*), any_value(n)), least(count(*), any_value(n)), 0
        FROM orders, days
    UNION ALL SELECT 'top_phrases', 0, count(*), (sum(n) - count(*))::BIGINT FROM phrases""")
def _(spark, sf):
    stored, late = _late(_delivered_articles(spark, sf))
    scores = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("arrival"), F.lit(1.0).alias("rate"))
    phrases = v.table(spark, sf, "part").select(F.col("p_type").alias("phrase"), F.col("p_partkey").alias("arrival"))
    return merge.load_stats(late, scores, phrases, "arrival", known_articles=merge.valid_articles(stored, "arrival"))


def _scores(spark, sf) -> DataFrame:
    """The daily index without its dates, in order."""
    index = v.index_daily(spark, sf)
    return index.withColumn("row_no", F.unix_date("date")).drop("date")


_SCORED = """SELECT d.date, s.total_articles, s.fiscal_articles, {columns} FROM (
    SELECT *, row_number() OVER (ORDER BY date) AS i FROM index_daily) s JOIN (
    SELECT auction_date AS date, row_number() OVER (ORDER BY auction_date) AS i FROM (
    SELECT DISTINCT auction_date FROM auctions)) d ON s.i = d.i"""


@query("positional_date_join", using("index_daily auctions", _SCORED.format(
    columns=near("s.rate", 8) + " AS rate, " + near("s.fiscal_policy_index", 8) + " AS fiscal_policy_index")))
def _(spark, sf):
    days = v.auctions(spark, sf).select(F.col("auction_date").alias("date"))
    dated = merge.positional_date_join(_scores(spark, sf), days, ["row_no"])
    return settled(dated.select("date", "total_articles", "fiscal_articles", "rate", "fiscal_policy_index"), 8)


@query("upsert_indices", using("index_daily auctions", _SCORED.format(
    columns="CAST(CAST(s.rate AS DECIMAL(10,6)) AS DOUBLE) AS rate")))
def _(spark, sf):
    days = v.auctions(spark, sf).select(F.col("auction_date").alias("date"))
    merged = merge.upsert_indices(None, _scores(spark, sf), days, "row_no")
    return _as_double(merged.select("date", F.col("total_articles").cast("bigint").alias("total_articles"),
                                    F.col("fiscal_articles").cast("bigint").alias("fiscal_articles"), "rate"))


@query("upsert_phrases", """SELECT phrase, "count" FROM (SELECT trim(p_type) AS phrase,
    CAST(p_size AS BIGINT) AS "count", row_number() OVER (PARTITION BY trim(p_type) ORDER BY p_partkey DESC) AS last
    FROM part) WHERE last = 1""")
def _(spark, sf):
    delivered = v.table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_type", F.lit("  ")).alias("phrase"),
        F.col("p_size").cast("bigint").alias("count"), F.col("p_partkey").alias("arrival"))
    return merge.upsert_phrases(None, delivered, "arrival")


@query("verify_load", using("flagged article_days", """SELECT 'fiscal_articles' AS "table", count(*) AS "rows" FROM flagged
    UNION ALL SELECT 'fiscal_policy_indices', count(*) FROM article_days
    UNION ALL SELECT 'top_phrases', count(DISTINCT p_type) FROM part
    UNION ALL (SELECT 'sample article: ' || article_id || ' ' || date || ' ' || is_fiscal_article || ' ' || has_tariff, 1
        FROM flagged ORDER BY article_id LIMIT 1)
    UNION ALL (SELECT 'sample index: ' || date || ' ' || fiscal_articles || '/' || total_articles, 1
        FROM article_days ORDER BY date LIMIT 1)
    UNION ALL (SELECT 'top phrase: ' || p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
        ORDER BY n DESC, p_type LIMIT 1)"""))
def _(spark, sf):
    articles = v.flagged_articles(spark, sf)
    phrases = v.table(spark, sf, "part").groupBy(F.col("p_type").alias("phrase")).agg(
        F.count(F.lit(1)).alias("count"))
    return verify_load(articles, daily_article_counts(articles), phrases)


# --- order and positions -----------------------------------------------------------------


@query("global_position", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position
    FROM orders""")
def _(spark, sf):
    rows = v.table(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    return with_position(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


# --- pages, files, stored tables, stream -------------------------------------------------


@query("flatten_pages", """SELECT o_orderkey, o_custkey, floor(o_orderkey / 100)::BIGINT AS page FROM orders""")
def _(spark, sf):
    orders = v.table(spark, sf, "orders")
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("securityList"))
    total = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    flat = records.flatten_pages(pages.withColumn("totalResultsCount", total))
    return flat.select("o_orderkey", "o_custkey", F.col("arrival.page").alias("page"))


@query("flatten_pages_stop", """SELECT page, count(*) AS n FROM (
    SELECT floor(l_orderkey / 100)::BIGINT AS page FROM lineitem) WHERE page <= (
    SELECT min(page) FROM (SELECT floor(l_orderkey / 100)::BIGINT AS page,
        sum(count(*)) OVER (ORDER BY floor(l_orderkey / 100)::BIGINT) AS fetched FROM lineitem GROUP BY 1)
    WHERE fetched >= (SELECT count(*) * 0.6 FROM lineitem)) GROUP BY page""")
def _(spark, sf):
    """The announced total is reached on the way; more records than one download used to be allowed."""
    lines = v.table(spark, sf, "lineitem")
    pages = lines.groupBy(F.floor(F.col("l_orderkey") / 100).alias("page")).agg(
        F.collect_list(F.struct("l_orderkey", "l_linenumber")).alias("securityList"))
    total = lines.agg(F.ceil(F.count(F.lit(1)) * F.lit(6) / 10).cast("bigint").alias("n")).scalar()
    flat = records.flatten_pages(pages.withColumn("totalResultsCount", total))
    return flat.groupBy(F.col("arrival.page").alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query("read_auction_json", _sql("SELECT cusip, security_type, count(*) AS n FROM records GROUP BY ALL", "records"))
def _(spark, sf):
    folder = scratch(spark)
    raw_records(spark, sf).drop("arrival").write.json(folder)
    read = records.read_auction_json(spark, folder, multi_line=False)
    return read.groupBy("cusip", F.col("securityType").alias("security_type")).agg(F.count(F.lit(1)).alias("n"))


def _array_files(spark, sf) -> str:
    """Files of some thousand records, each one JSON array."""
    folder = scratch(spark)
    rows = raw_records(spark, sf).withColumn("part", F.floor(F.col("arrival") / ARRAY_RECORDS)).drop("arrival")
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct(*schemas.API_FIELDS))).alias("value"))
    arrays.write.partitionBy("part").text(folder)
    return folder


@query("read_auction_array", _sql("SELECT cusip, security_type, count(*) AS n FROM records GROUP BY ALL", "records"))
def _(spark, sf):
    read = records.read_auction_json(spark, _array_files(spark, sf))
    return read.groupBy("cusip", F.col("securityType").alias("security_type")).agg(F.count(F.lit(1)).alias("n"))


@query("read_auction_array_splits", _sql("""SELECT cusip, security_type, count(*) AS n FROM records GROUP BY ALL""", "records"))
def _(spark, sf):
    """The same files read by split, as one very large array would be."""
    read = records.read_auction_array(spark, _array_files(spark, sf))
    return read.groupBy("cusip", F.col("securityType").alias("security_type")).agg(F.count(F.lit(1)).alias("n"))


@query("typed_csv_round_trip", using("flagged", "SELECT article_id, date, is_fiscal_article, has_tariff FROM flagged"))
def _(spark, sf):
    folder = scratch(spark)
    files.write_csv(v.flagged_articles(spark, sf), folder)
    return files.read_typed_csv(spark, folder, schemas.ARTICLES).drop("arrival", files.CORRUPT)


@query("stored_table", using("auctions", """SELECT auction_id, CAST(cusip AS VARCHAR) AS cusip, auction_date,
    CAST(CAST(high_yield AS DECIMAL(10,4)) AS DOUBLE) AS high_yield FROM auctions"""))
def _(spark, sf):
    folder = scratch(spark)
    by_year = v.auctions(spark, sf).withColumn("auction_year", F.year("auction_date"))
    tables.save_table(by_year, folder, schemas.AUCTIONS, ("auction_year",), ("cusip", "auction_date"))
    stored = tables.load_table(spark, folder, schemas.AUCTIONS)
    return _as_double(stored.select("auction_id", "cusip", "auction_date", "high_yield"))


@query("read_corpus", """SELECT CAST(doc_id AS VARCHAR) AS article_id,
    DATE '1995-01-01' + CAST((doc_id % 250) * 9 AS INT) AS date,
    md5(lower(replace(text, chr(10), ' ')) || ' ') AS article_digest FROM documents""")
def _(spark, sf):
    folder = scratch(spark)
    # One dump file per task of the scan; a file never has to hold a whole source.
    dump_parts(spark, sf).select(F.array_join("lines", "\n").alias("value")).write.text(folder)
    found = extract_sections(files.read_corpus(spark, folder))
    return found.select(parse_article_id("details").alias("article_id"),
                        parse_broken_date("details").alias("date"), F.md5("article").alias("article_digest"))


def _landed(spark, sf) -> AuctionStore:
    """A store after three runs of the stream over files in arrival order.

    The first run meets the first third of the records, the second the rest, and the third only a late copy of a
    file that came before: its name puts it before the newest file, so it changes nothing.
    """
    folder = scratch(spark)
    store = AuctionStore(spark, f"{folder}/store")
    with settings(spark, DROP_SHUFFLES):
        rows = written(raw_records(spark, sf), "records", compression="zstd")     # read ten times below
        end = rows.agg((F.max("arrival") + 1).alias("end")).scalar()
        thirds = rows.withColumn("third", F.floor(F.col("arrival") * 3 / end))
        for landed in ({"1": 0}, {"2": 1, "3": 2}, {"2b": 1}):
            for name, third in landed.items():
                ordered = thirds.filter(F.col("third") == third).drop("third").orderBy("arrival")
                (ordered.drop("arrival").write.options(compression="gzip", maxRecordsPerFile=LANDED_RECORDS)
                 .json(f"{folder}/landing/{name}"))
            stream_ingest(spark, f"{folder}/landing/*", store, f"{folder}/progress", multi_line=False,
                          split_bytes="32m").awaitTermination()
    return store


@query("stream_ingest", _sql("""SELECT n.cusip, n.auction_date,
    CAST(CAST(nullif(n.high_yield, '') AS DECIMAL(10,4)) AS DOUBLE) AS high_yield,
    b.primary_dealer_accepted FROM numbered n LEFT JOIN (""" + _BIDDER_SQL + """) b
    ON n.cusip = b.cusip AND n.auction_date = b.auction_date""", *_ALL))
def _(spark, sf):
    store = _landed(spark, sf)
    auctions, bidders = store.auctions.read(), store.bidders.read()
    joined = auctions.join(bidders, "auction_id", "left")
    return _as_double(joined.select("cusip", "auction_date", "high_yield", "primary_dealer_accepted"))


@query("stream_ledger", _sql("""SELECT run, records_fetched, inserted AS records_inserted,
    arrived - inserted AS records_updated, last_auction_date FROM (
    SELECT run, count(*) AS records_fetched, count(*) FILTER (WHERE to_auction) AS arrived,
        count(*) FILTER (WHERE new) AS inserted, max(max(CASE WHEN to_auction THEN auction_date END)) OVER (ORDER BY run) AS last_auction_date
    FROM (SELECT *, run < 3 AND to_auction AND row_number() OVER (PARTITION BY to_auction, cusip, auction_date ORDER BY run, arrival) = 1 AS new
        FROM (SELECT *, unnest(CASE third WHEN 0 THEN [1] WHEN 1 THEN [2, 3] ELSE [2] END) AS run FROM (
            SELECT *, floor(arrival * 3 / (SELECT max(arrival) + 1 FROM judged)) AS third FROM judged)))
    GROUP BY run)""", *_ALL[:3]))
def _(spark, sf):
    runs = _landed(spark, sf).ledger.runs().filter("status = 'SUCCESS'")
    numbered = F.row_number().over(Window.orderBy("update_timestamp")).cast("bigint")
    return runs.select(numbered.alias("run"), "records_fetched", "records_inserted", "records_updated", "last_auction_date")


@query("news_load", using("flagged rated", f"""SELECT date, CAST(total_articles AS INTEGER) AS total_articles,
    CAST(CAST(rate AS DECIMAL(10,6)) AS DOUBLE) AS rate FROM rated WHERE date IN (SELECT date FROM ({_ARTICLES}))"""))
def _(spark, sf):
    """Articles, scores and phrases delivered once; every stored day carries its own score."""
    folder = scratch(spark)
    delivered = materialise(_delivered_articles(spark, sf))
    store = NewsStore(spark, folder)
    days = merge.upsert_articles(None, delivered, "arrival").select("date").distinct()
    scores = v.index_daily(spark, sf).join(days, "date").withColumn("row_no", F.unix_date("date")).drop("date")
    phrases = v.table(spark, sf, "part").select(
        F.col("p_type").alias("phrase"), F.col("p_size").cast("bigint").alias("count"),
        F.col("p_partkey").alias("arrival"))
    store.load(delivered, scores.withColumnRenamed("row_no", "arrival"), phrases, 0)
    return _as_double(store.indices.read().select("date", "total_articles", "rate"))
