"""Batch ingest of auction records and loading of article, score and phrase files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tenderlens.functions.parsing import parse_date
from tenderlens.operators.aggregates import row_counts
from tenderlens.operators.merge import (auctions_from, bidders_from, latest_rows,
                                        securities_from, stage_records, upsert_articles,
                                        upsert_indices, upsert_phrases)
from tenderlens.operators.ranking import top_phrases
from tenderlens.schemas import (ARTICLES, AUCTIONS, BIDDER_DETAILS, INDICES, PHRASES, SECURITIES)
from tenderlens.session import materialise
from tenderlens.sources.tables import PartitionedTable, RunLedger, hash_folder

AUCTION_KEY = ["cusip", "auction_date"]


def auction_key_id() -> Column:
    """Id of an auction from its key: the same in every replay and every store, and never looked up."""
    return F.xxhash64(*AUCTION_KEY)


class AuctionStore:
    """The three auction tables and the run ledger under one folder.

    Auctions and their bidder details lie in folders by year, so a batch rewrites the years it has news for.
    """

    def __init__(self, spark: SparkSession, root: str, folders: int = 64):
        self.spark = spark
        year = F.year("auction_date")
        self.securities = PartitionedTable(spark, f"{root}/securities", SECURITIES, ["cusip"],
                                           hash_folder("cusip", folders=folders))
        self.auctions = PartitionedTable(spark, f"{root}/auctions", AUCTIONS, AUCTION_KEY, year)
        # The id is made from the auction's key, so its date is a function of it.
        self.bidders = PartitionedTable(spark, f"{root}/bidder_details", BIDDER_DETAILS, ["auction_id"], year)
        self.ledger = RunLedger(spark, f"{root}/data_updates")

    def merge(self, securities: DataFrame, auctions: DataFrame, bidders: DataFrame, batch: int) -> dict:
        """Store changed rows, unique by key; returns the auctions ``written`` and ``inserted``.

        ``bidders`` comes with the auction's key in place of its id.
        """
        self.securities.merge(securities, batch)
        counts = self.auctions.merge(auctions.withColumn("auction_id", auction_key_id()), batch)
        self.bidders.merge(bidders.withColumn("auction_id", auction_key_id()), batch)
        return counts


def ingest_batch(store: AuctionStore, records: DataFrame, batch: int, run_type: str = "FULL") -> dict:
    """Stage, deduplicate and store one batch of raw records (with an ``arrival`` column).

    The records are read once; what the ledger needs is gathered on the way. Only folders with changed keys
    are read and rewritten. A bad record is counted and set aside; it never stops the others.
    Running the same batch again gives the same tables and figures.
    """
    run_id = uuid.uuid4().hex
    store.ledger.record(run_id, "RUNNING", run_type)
    try:
        seen = Observation()
        dated = F.when(F.col("to_auction"), parse_date("auctionDate"))
        staged = materialise(stage_records(records).observe(
            seen, F.count(F.lit(1)).alias("fetched"), F.count_if("failed").alias("errors"),
            F.count_if("to_auction").alias("arrived"), F.max(dated).alias("last")))
        counts = store.merge(
            latest_rows(securities_from(staged, "arrival"), ["cusip"], "arrival"),
            latest_rows(auctions_from(staged, "arrival"), AUCTION_KEY, "arrival"),
            latest_rows(bidders_from(staged, "arrival"), AUCTION_KEY, "arrival"), batch)
        return finish_run(store, run_id, run_type, fetched=seen.get["fetched"], errors=seen.get["errors"],
                          inserted=counts["inserted"], updated=seen.get["arrived"] - counts["inserted"],
                          last=seen.get["last"])
    except Exception as error:
        store.ledger.record(run_id, "FAILED", run_type, error_message=str(error))
        raise


def finish_run(store: AuctionStore, run_id: str, run_type: str, fetched: int, errors: int, inserted: int,
               updated: int, last) -> dict:
    """Note a successful run. The last auction date is the later of the batch's and the ledger's."""
    dates = [d for d in (last, store.ledger.last_auction_date()) if d is not None]
    store.ledger.record(
        run_id, "SUCCESS", run_type, records_fetched=fetched, records_inserted=inserted,
        records_updated=updated, last_auction_date=max(dates, default=None))
    return {"status": "success", "fetched": fetched, "inserted": inserted, "updated": updated, "errors": errors}


class NewsStore:
    """The article, index and phrase tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, folders: int = 64):
        self.articles = PartitionedTable(spark, f"{root}/fiscal_articles", ARTICLES, ["article_id"],
                                         hash_folder("article_id", folders=folders))
        self.indices = PartitionedTable(spark, f"{root}/fiscal_policy_indices", INDICES, ["date"], F.year("date"))
        self.phrases = PartitionedTable(spark, f"{root}/top_phrases", PHRASES, ["phrase"],
                                        hash_folder("phrase", folders=folders))

    def load(self, articles: DataFrame, scores: DataFrame, phrases: DataFrame, batch: int) -> DataFrame:
        """Store one delivery of the three files and return the verification table."""
        self.articles.merge(upsert_articles(None, articles, "arrival"), batch)
        self.indices.merge(upsert_indices(None, scores, self.articles.read(), "arrival"), batch)
        self.phrases.merge(upsert_phrases(None, phrases, "arrival"), batch)
        return self.verify()

    def verify(self) -> DataFrame:
        return verify_load(self.articles.read(), self.indices.read(), self.phrases.read())


def verify_load(articles: DataFrame, indices: DataFrame, phrases: DataFrame) -> DataFrame:
    """Row counts of the three tables, the first article and day, and the most frequent phrase."""
    counts = row_counts({"fiscal_articles": articles, "fiscal_policy_indices": indices,
                         "top_phrases": phrases})
    top = top_phrases(phrases, 1).select(
        F.concat(F.lit("top phrase: "), "phrase").alias("table"), F.col("count").alias("rows"))

    def sample(rows: DataFrame, name: str, order: str, *shown: Column) -> DataFrame:
        return rows.orderBy(order).limit(1).select(
            F.concat(F.lit(f"sample {name}: "), F.concat_ws(" ", *shown)).alias("table"), F.lit(1).cast("bigint").alias("rows"))

    article = sample(articles, "article", "article_id", *[
        F.col(c).cast("string") for c in ("article_id", "date", "is_fiscal_article", "has_tariff")])
    index = sample(indices, "index", "date", F.col("date").cast("string"),
                   F.concat_ws("/", F.col("fiscal_articles").cast("string"), F.col("total_articles").cast("string")))
    return counts.unionAll(article).unionAll(index).unionAll(top)
