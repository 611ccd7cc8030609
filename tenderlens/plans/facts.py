"""The wide auction fact over tables that are stored in buckets of the same key.

Auctions, securities and bidder details are written once in as many hash buckets of the cusip, sorted within each. Every
later join of the three reads matching buckets side by side: no row is shuffled, however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderlens.operators.filters import since
from tenderlens.operators.joins import AUCTION_COLUMNS, BIDDER_COLUMNS, auctions_with_security

BUCKETS = 64
# Tables bucketed by part of a join's keys are joined in place only if this is off.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_TABLES = ("auctions", "securities", "bidder_details")


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table of the session catalog in one sorted file per bucket of ``key``.

    Choose ``buckets`` so that one fits a task; all tables joined with each other need the same number.
    """
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))


class FactTables:
    """The three tables under one folder and one prefix of catalog names."""

    def __init__(self, spark: SparkSession, path: str, prefix: str, buckets: int = BUCKETS):
        self.spark, self.path, self.prefix, self.buckets = spark, path.rstrip("/"), prefix, buckets

    def save(self, auctions: DataFrame, securities: DataFrame, bidders: DataFrame) -> None:
        """Store all three; bidder details get the cusip of their auction, and those without an auction are left out."""
        placed = bidders.join(auctions.select("auction_id", "cusip"), "auction_id")
        for name, rows in zip(_TABLES, (auctions, securities, placed)):
            save_bucketed(rows, f"{self.prefix}_{name}", f"{self.path}/{name}", "cusip", self.buckets)

    def facts(self, start=None) -> DataFrame:
        """The same rows as ``auction_facts``."""
        self.spark.conf.set(ALL_KEYS, "false")
        auctions, securities, bidders = (self.spark.table(f"{self.prefix}_{name}") for name in _TABLES)
        base = auctions if start is None else since(auctions, "auction_date", start)
        details = bidders.select("cusip", "auction_id", *BIDDER_COLUMNS)
        joined = auctions_with_security(base.join(details, ["cusip", "auction_id"], "left"), securities)
        return joined.select(*AUCTION_COLUMNS, "security_type", "security_term", "security_interest_rate", *BIDDER_COLUMNS)
