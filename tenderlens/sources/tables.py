"""Tables on shared storage (S8) and the run ledger (M5).

Plain Parquet has no MERGE. A keyed table is cut into folders by a function of its key, and a batch
reads and overwrites only the folders that its keys fall into.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.operators.merge import conform, latest_rows, same_keys
from tenderlens.schemas import RUNS
from tenderlens.session import materialise
from tenderlens.sources.files import is_missing


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table in its declared schema, also if older files lack later columns."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), schema)


def save_table(df: DataFrame, path: str, schema: T.StructType, partition_by: tuple[str, ...] = (),
               sort_by: tuple[str, ...] = ()) -> None:
    """Write a table; sorted files let later scans skip row groups."""
    extra = [df.schema[c] for c in partition_by if c not in schema.fieldNames()]
    rows = conform(df, T.StructType([*schema.fields, *extra]))
    if partition_by:
        # Adaptive execution cuts a crowded folder into tasks of its advisory size.
        rows = rows.hint("rebalance", *partition_by)
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def hash_folder(*keys: str, folders: int = 64) -> Column:
    """Folder number of a key without a natural order."""
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")


class PartitionedTable:
    """A table with one current row per key, in folders ``part=<number>``.

    ``part`` is a function of the key, such as the year of a date or a hash (``hash_folder``); choose it so that
    a folder is a handful of files. Beside its columns a row keeps the batch that first brought its key, so
    that a repeated batch finds the same keys new as the first time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], part: Column):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.part = F.coalesce(part.cast("int"), F.lit(-1))     # a key without a value has a folder too
        self._stored = T.StructType([*schema.fields, T.StructField("first_batch", T.LongType()),
                                     T.StructField("part", T.IntegerType())])

    def _read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self._stored).parquet(self.path)
        except AnalysisException as error:
            if is_missing(error):
                return None
            raise

    def read(self) -> DataFrame | None:
        """Current rows; None if nothing was ever written."""
        stored = self._read()
        return None if stored is None else stored.select(*self.schema.fieldNames())

    def touched(self, rows: DataFrame, before: int | None = None) -> DataFrame | None:
        """Stored rows in the folders of ``rows``, those of keys first seen ``before`` a batch."""
        stored = self._read()
        if stored is None:
            return None
        # As many values as folders exist at most; they prune the scan when it is planned.
        part = F.col("part") if "part" in rows.columns else self.part.alias("part")
        folders = [r["part"] for r in rows.select(part).distinct().collect()]
        stored = stored.filter(F.col("part").isin(folders))
        if before is not None:
            stored = stored.filter(F.col("first_batch") < before)
        return stored.select(*self.schema.fieldNames(), "first_batch", "part")

    def merge(self, rows: DataFrame, batch: int) -> dict:
        """Replace or add rows (unique by key); returns how many keys were ``written`` and ``inserted``.

        Only folders with such keys are read and rewritten, all others keep their files. The new files are moved in
        when all are written; a batch repeated after a failure gives the same rows and figures.
        """
        placed = rows.withColumn("part", self.part)
        fields = [*self.schema.fields, T.StructField("part", T.IntegerType())]
        new = materialise(conform(placed, T.StructType(fields)))
        if new.isEmpty():
            return {"written": 0, "inserted": 0}
        old = self.touched(new)
        if old is None:
            merged = new.withColumn("first_batch", F.lit(batch).cast("bigint")).withColumn("_new", F.lit(True))
        else:
            known = old.select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.col("first_batch").alias("_first"))
            latest = new.join(known, same_keys(self.keys), "left").select(
                *new.columns, F.least(F.coalesce("_first", F.lit(batch)), F.lit(batch)).cast("bigint").alias("first_batch"),
                F.lit(True).alias("_new"))
            keys = new.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            kept = old.join(keys, same_keys(self.keys), "left_anti").withColumn("_new", F.lit(False))
            merged = latest.unionByName(kept)
        seen = Observation()
        observed = merged.observe(
            seen, F.count_if("_new").alias("written"),
            F.count_if(F.col("_new") & (F.col("first_batch") == batch)).alias("inserted"))
        (observed.drop("_new").hint("rebalance", "part").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path))
        return seen.get


class RunLedger:
    """Append-only record of runs; the newest entry of a run is its state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, run_id: str, status: str, run_type: str = "FULL", **facts) -> None:
        row = {"run_id": run_id, "status": status, "run_type": run_type,
               "update_timestamp": datetime.now(timezone.utc).replace(tzinfo=None), **facts}
        entry = tuple(row.get(name) for name in RUNS.fieldNames())
        self.spark.createDataFrame([entry], RUNS).coalesce(1).write.mode("append").parquet(self.path)

    def last_auction_date(self):
        """The latest auction date of any successful run."""
        return self.runs().filter("status = 'SUCCESS'").agg(F.max("last_auction_date").alias("last")).first()["last"]

    def runs(self) -> DataFrame:
        try:
            entries = self.spark.read.schema(RUNS).parquet(self.path)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], RUNS)
        return latest_run_states(entries)


def latest_run_states(entries: DataFrame) -> DataFrame:
    """The last entry of every run."""
    stamped = entries.withColumn("_entered", F.col("update_timestamp"))
    return latest_rows(stamped, ["run_id"], "_entered")
