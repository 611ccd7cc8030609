"""Keyed merges (M1-M9) and key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.functions.measures import share_pct
from tenderlens.functions.parsing import any_malformed, parse_as, parse_date, rename_fields
from tenderlens.operators.ordering import with_position
from tenderlens.schemas import AUCTIONS, BIDDER_DETAILS, INDICES, SECURITIES, received
from tenderlens.session import materialise

# Bidder groups that carry a share of the accepted amount.
SHARED = ["primary_dealer", "direct_bidder", "indirect_bidder", "fima", "soma"]


def latest_rows(df: DataFrame, keys: list[str], order: str, first: str | None = None) -> DataFrame:
    """The last row per key; a row without an order value comes before all others.

    A key with very many rows shrinks to one row per task before the shuffle. ``first`` names an extra
    column for the order value of the key's first row.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    last = df.withColumn("_back", F.row_number().over(newest)).filter("_back = 1").drop("_back", order)
    if not first:
        return last
    starts = df.groupBy(*keys).agg(F.min(order).alias(first))
    return last.join(starts.toDF(*[f"_{k}" for k in keys], first), same_keys(keys)).drop(*[f"_{k}" for k in keys])


def same_keys(keys: list[str]) -> Column:
    """Join condition on columns ``k`` and ``_k`` for which missing keys are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def _known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys])


def upsert(existing: DataFrame | None, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows with every column of a known key replaced by its last incoming row.

    A missing key is a key like any other.
    """
    last = latest_rows(incoming, keys, order)
    if existing is None:
        return last
    return existing.join(_known_keys(last, keys), same_keys(keys), "left_anti").unionByName(
        last, allowMissingColumns=True)


def upsert_stats(existing: DataFrame | None, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row (inserted, updated): the first sighting of a key inserts, every other row updates."""
    seen = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if existing is None:
        marked = seen.withColumn("_known", F.lit(None).cast("boolean"))
    else:
        known = _known_keys(existing, keys).distinct().withColumn("_known", F.lit(True))
        marked = seen.join(known, same_keys(keys), "left")
    new = F.count_if(F.col("_known").isNull())
    return marked.agg(new.alias("inserted"),
                      (F.coalesce(F.sum("_rows"), F.lit(0)) - new).alias("updated"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones as nulls, NaN as null (M6)."""
    have = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name)
        if isinstance(have[field.name], (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(have[field.name]))
        return c.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema])


def stage_records(records: DataFrame) -> DataFrame:
    """Mark how far each raw record gets (M4).

    A bad security field stops the record at once. Without an auction date only its security is
    kept, which is no error. A bad auction field lets the security through, a bad bidder field
    the security and the auction. Bidder fields matter only if something was accepted.
    """
    security_ok = (F.col("cusip").isNotNull() & F.col("securityType").isNotNull()
                   & ~any_malformed(records, received(SECURITIES)))
    dated = parse_date("auctionDate").isNotNull()
    auction_ok = ~any_malformed(records, received(AUCTIONS))
    total = parse_as(F.col("totalAccepted"), AUCTIONS["total_accepted"].dataType)
    due = F.coalesce(total > 0, F.lit(False))
    bidders = _bidder_columns(records)
    too_large = F.lit(False)
    for who in SHARED:
        part = bidders[f"{who}_accepted"]
        too_large = too_large | F.coalesce(
            (part != 0) & bidders[f"{who}_percentage"].isNull(), F.lit(False))
    bidder_ok = ~any_malformed(records, received(BIDDER_DETAILS)) & ~too_large
    return records.withColumns({
        "to_security": security_ok,
        "to_auction": security_ok & dated & auction_ok,
        "to_bidder": security_ok & dated & auction_ok & due & bidder_ok,
        "failed": ~security_ok | (dated & (~auction_ok | (due & ~bidder_ok))),
    })


def _bidder_columns(records: DataFrame) -> dict[str, Column]:
    """Bidder amounts and their shares of the accepted total."""
    total = parse_as(F.col("totalAccepted"), AUCTIONS["total_accepted"].dataType)
    columns = {name: parse_as(F.col(source), kind) if source in records.columns
               else F.lit(None).cast(kind)
               for source, name, kind in received(BIDDER_DETAILS) if name != "auction_id"}
    for who in SHARED:
        kind = BIDDER_DETAILS[f"{who}_percentage"].dataType
        columns[f"{who}_percentage"] = share_pct(columns[f"{who}_accepted"], total, None).try_cast(kind)
    return columns


def securities_from(staged: DataFrame, order: str) -> DataFrame:
    return rename_fields(staged.filter("to_security"), received(SECURITIES), (order,))


def auctions_from(staged: DataFrame, order: str) -> DataFrame:
    return rename_fields(staged.filter("to_auction"), received(AUCTIONS), (order,))


def bidders_from(staged: DataFrame, order: str) -> DataFrame:
    """Bidder rows still keyed by (cusip, auction_date)."""
    rows = staged.filter("to_bidder")
    amounts = [c.alias(name) for name, c in _bidder_columns(rows).items()]
    return rows.select(order, "cusip", parse_date("auctionDate").alias("auction_date"), *amounts)


def quarantine(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without and with a failing stage."""
    return staged.filter(~F.col("failed")), staged.filter("failed")


def with_auction_ids(arrived: DataFrame, existing: DataFrame | None, order: str = "arrival",
                     top: Column | None = None) -> DataFrame:
    """The last row per auction of a batch with its id.

    Known auctions keep their id; new ones are numbered on in order of first arrival, by a
    distributed row number. ``top`` is the highest id so far, where ``existing`` has only some of the auctions.
    """
    keys = ["cusip", "auction_date"]
    last = latest_rows(arrived, keys, order, first="_first")
    if existing is None:
        last = last.withColumn("auction_id", F.lit(None).cast("bigint"))
        top = F.lit(0) if top is None else top
    else:
        last = last.join(existing.select(*keys, "auction_id"), keys, "left")
        top = existing.agg(F.max("auction_id").alias("top")).scalar() if top is None else top
    top = F.coalesce(top, F.lit(0))
    # Numbering samples its input before it sorts it, so the merged rows are settled first.
    last = materialise(last)
    fresh = with_position(last.filter("auction_id IS NULL"), ["_first", *keys], "_place")
    numbered = fresh.withColumn("auction_id", (F.col("_place") + 1 + top).cast("bigint")).drop("_place")
    return last.filter("auction_id IS NOT NULL").unionByName(numbered).drop("_first")


def upsert_articles(existing: DataFrame | None, incoming: DataFrame, order: str) -> DataFrame:
    """Articles by id (M7); rows without a readable date are skipped, missing flags are false."""
    return upsert(existing, valid_articles(incoming, order), ["article_id"], order)


def valid_articles(incoming: DataFrame, order: str) -> DataFrame:
    date = (parse_date("date") if isinstance(incoming.schema["date"].dataType, T.StringType)
            else F.col("date").cast("date"))

    def flag(name: str) -> Column:
        if name not in incoming.columns:
            return F.lit(False)
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))

    return incoming.select(
        F.col("article_id").cast("string").alias("article_id"), date.alias("date"),
        *[flag(n).alias(n) for n in ("is_fiscal_article", "has_tariff")], order,
    ).filter(F.col("date").isNotNull())


def load_stats(articles: DataFrame, scores: DataFrame, phrases: DataFrame, order: str,
               known_articles: DataFrame | None = None, known_indices: DataFrame | None = None,
               known_phrases: DataFrame | None = None) -> DataFrame:
    """Rows skipped, inserted and updated by a delivery of the three files, one row per table.

    Articles without a readable date and scores beyond the last article date are skipped.
    """
    valid = valid_articles(articles, order)
    dated = positional_date_join(scores, valid, [order])
    trimmed = phrases.withColumn("phrase", F.trim("phrase"))

    def stats(name: str, delivered: DataFrame, used: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
        counts = upsert_stats(known, used, [key])
        rows = delivered.agg(F.count(F.lit(1)).alias("n")).scalar()
        return counts.select(F.lit(name).alias("table"), (rows - F.col("inserted") - F.col("updated")).alias("skipped"),
                             "inserted", "updated")

    return stats("fiscal_articles", articles, valid, known_articles, "article_id").unionAll(
        stats("fiscal_policy_indices", scores, dated, known_indices, "date")).unionAll(
        stats("top_phrases", phrases, trimmed, known_phrases, "phrase"))


def positional_date_join(scores: DataFrame, articles: DataFrame, order: list[str]) -> DataFrame:
    """Give score row i the i-th smallest article date (M8). Rows beyond the last date drop out."""
    days = articles.select("date").dropna().distinct()
    # Distinct calendar days: at most 366 a year, so one window task is enough.
    dated = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint").alias("_place"))
    return with_position(scores, order, "_place").join(dated, "_place").drop("_place")


def upsert_indices(existing: DataFrame | None, scores: DataFrame, articles: DataFrame,
                   order: str) -> DataFrame:
    dated = positional_date_join(scores, articles, [order])
    return upsert(existing, conform(dated, INDICES).withColumn(order, F.lit(0)), ["date"], order)


def upsert_phrases(existing: DataFrame | None, incoming: DataFrame, order: str) -> DataFrame:
    """Phrases by trimmed text; the last count wins (M9)."""
    trimmed = incoming.withColumn("phrase", F.trim("phrase"))
    return upsert(existing, trimmed.select("phrase", "count", order), ["phrase"], order)
