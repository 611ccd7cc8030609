"""Incremental ingest (ST1): each landing file is taken once; corrections overwrite.

What is known of every key lives in the stream's own keyed state, in its checkpoint: the key's newest record, the
place it came from and when the key was met. A batch therefore knows which keys are new and which rows change
without reading any stored table. Records are in order of file name and place in the file, whatever order the files
are processed in: a file delivered late never overwrites newer ones.

The state is a streaming aggregation, so records of a key are combined in each task before they are shuffled. It tells
batches apart by their time stamps (milliseconds, kept in the checkpoint), whichever way the clock runs.

The changed rows of a batch are written once, to ``changes/batch=<n>``, and merged from there into the folders
of the store that they fall into.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlens.functions.parsing import parse_date
from tenderlens.operators.merge import auctions_from, bidders_from, securities_from, stage_records
from tenderlens.plans.ingest import AuctionStore, finish_run
from tenderlens.schemas import (API_FIELDS, API_RECORD, AUCTIONS, BIDDER_DETAILS, SECURITIES, received)
from tenderlens.session import DROP_SHUFFLES, settings
from tenderlens.sources.files import is_missing

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The state holds record texts, much alike: blocks of 32 KB under zstd take less than half of 4 KB under lz4.
PACKED = {"spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
          "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32"}
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
_PLACE = "path string, start long, row long"
# Kinds of entries; a record gives one for each table that it reaches, and one to its file.
SECURITY, AUCTION, BIDDER, REJECTED, FILE = "security", "auction", "bidder", "rejected", "file"
CHANGE = "kind string, cusip string, day string, body string, fresh boolean, fetched long, arrived long"


def numbered_records(stream: DataFrame) -> DataFrame:
    """Add ``row``, the number of a record in its file split; splits are read in their order by one task."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            if not len(batch):
                continue
            path, starts = batch.column("path"), np.asarray(batch.column("start"))
            names = np.asarray(path.dictionary_encode().indices)
            new = np.flatnonzero((np.diff(names) != 0) | (np.diff(starts) != 0)) + 1
            begins = np.concatenate([[0], new])
            rows = np.arange(len(batch), dtype=np.int64)
            for low, high in zip(begins, [*begins[1:], len(batch)]):    # one run of rows per file split
                place = path[int(low)].as_py(), int(starts[low])
                rows[low:high] += seen.get(place, 0) - low
                seen[place] = int(rows[high - 1]) + 1
            yield batch.append_column("row", pa.array(rows, pa.int64()))

    placed = stream.select(*API_FIELDS, F.col("_metadata.file_path").alias("path"),
                           F.col("_metadata.file_block_start").alias("start"))
    fields = ", ".join(f"{n} string" for n in API_FIELDS)
    return placed.mapInArrow(number, f"{fields}, {_PLACE}")


def _body(*fields: str) -> Column:
    return F.to_json(F.struct(*dict.fromkeys(fields)))


def record_entries(records: DataFrame) -> DataFrame:
    """One entry per record and table that it reaches, one for a record that fails, and one for its file.

    An entry's ``body`` holds what its table needs of the record; that of a failed one holds all fields. Only entries
    that may meet newer ones of their key carry their place: it is the key of a failed one, and a file has none.
    """
    staged = stage_records(records)
    day = parse_date("auctionDate").cast("string")
    place = F.concat_ws(":", "path", "start", "row")
    fields = {table: [name for name, _, _ in received(schema)] for table, schema in
              ((SECURITY, SECURITIES), (AUCTION, AUCTIONS), (BIDDER, BIDDER_DETAILS))}

    def entry(kind: str, cusip, key, body):
        placed = [F.col(c) if kind in (SECURITY, AUCTION, BIDDER) else F.lit(None).cast(records.schema[c].dataType)
                  for c in ("path", "start", "row")]
        return F.struct(F.lit(kind).alias("kind"), cusip.alias("cusip"), key.alias("day"),
                        *[c.alias(name) for c, name in zip(placed, ("path", "start", "row"))],
                        body.alias("body"), F.col("to_auction").cast("long").alias("arrived"))

    none = F.lit(None).cast("string")
    cusip = F.col("cusip")
    entries = F.array(
        F.when(F.col("to_security"), entry(SECURITY, cusip, none, _body(*fields[SECURITY]))),
        F.when(F.col("to_auction"), entry(AUCTION, cusip, day, _body(*fields[AUCTION]))),
        F.when(F.col("to_bidder"), entry(BIDDER, cusip, day, _body(
            "cusip", "auctionDate", "totalAccepted", *fields[BIDDER]))),
        F.when(F.col("failed"), entry(REJECTED, place, none, _body(*API_FIELDS))),
        entry(FILE, F.col("path"), none, none))
    return staged.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")


def changed_rows(stream: DataFrame) -> DataFrame:
    """CHANGE rows of a stream of API records (with file metadata): one per key met in a batch.

    ``body`` is the key's record if it is newer than all before, else null; ``fresh`` tells that the key was
    never seen; rejected records stand for themselves. The row of a file counts its records (``fetched``) and those
    that reach the auctions (``arrived``); a file comes in one batch, so these are the batch's.
    """
    now = F.current_timestamp()     # in a stream: the time stamp of the batch, the same when it is repeated
    entries = record_entries(numbered_records(stream)).withColumn("met", now)
    known = entries.groupBy("kind", "cusip", "day").agg(
        F.max(F.struct("path", "start", "row", "met", "body")).alias("newest"),
        F.min("met").alias("first"), F.max("met").alias("last"),
        F.count(F.lit(1)).alias("fetched"), F.sum("arrived").alias("arrived"))
    of_file = F.col("kind") == FILE
    return known.select(
        "kind", "cusip", "day", F.when(F.col("newest.met") == now, F.col("newest.body")).alias("body"),
        ((F.col("first") == now) & (F.col("last") == now)).alias("fresh"),
        F.when(of_file, F.col("fetched")).alias("fetched"), F.when(of_file, F.col("arrived")).alias("arrived"))


def apply_changes(store: AuctionStore, changes: DataFrame, batch: int, run_type: str = "INCREMENTAL") -> dict:
    """Merge one batch of CHANGE rows into the store and note the run."""
    run_id = uuid.uuid4().hex
    store.ledger.record(run_id, "RUNNING", run_type)
    try:
        bodies = changes.filter("body IS NOT NULL").select("kind", F.from_json("body", API_RECORD).alias("r"))

        def of(kind: str, flag: str) -> DataFrame:
            rows = bodies.filter(F.col("kind") == kind).select("r.*")
            return rows.withColumns({"arrival": F.lit(0), flag: F.lit(True)})

        store.merge(securities_from(of(SECURITY, "to_security"), "arrival").drop("arrival"),
                    auctions_from(of(AUCTION, "to_auction"), "arrival").drop("arrival"),
                    bidders_from(of(BIDDER, "to_bidder"), "arrival").drop("arrival"), batch)
        auction = F.col("kind") == AUCTION
        # All figures come from the changes of the batch, which are already written.
        row = changes.agg(
            F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"), F.count_if(F.col("kind") == REJECTED).alias("errors"),
            F.count_if(auction & F.col("fresh")).alias("inserted"),
            F.coalesce(F.sum("arrived"), F.lit(0)).alias("arrived"),
            F.max(F.when(auction, F.to_date("day"))).alias("last")).first()
        return finish_run(store, run_id, run_type, row["fetched"], row["errors"], row["inserted"],
                          row["arrived"] - row["inserted"], row["last"])
    except Exception as error:
        store.ledger.record(run_id, "FAILED", run_type, error_message=str(error))
        raise


def stream_ingest(spark: SparkSession, source: str, store: AuctionStore, checkpoint: str,
                  multi_line: bool = True, max_files: int | None = None, split_bytes: str | None = None) -> StreamingQuery:
    """Process all files that have landed, then stop; run it on a timer for daily updates.

    ``checkpoint`` holds the keyed state and must be on storage that all executors share. Batch numbers come from it, so a
    batch repeated after a failure overwrites its own changes and merges the same rows again. ``split_bytes`` is how much of
    the files one task reads, if not the session's; compressed files are much longer than their bytes.
    """
    reader = spark.readStream.schema(API_RECORD).option("multiLine", str(multi_line).lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def process(changes: DataFrame, batch: int) -> None:
        folder = f"{checkpoint.rstrip('/')}-changes/batch={batch}"
        changes.write.mode("overwrite").option("compression", "zstd").parquet(folder)   # the stateful plan runs once
        apply_changes(store, changes.sparkSession.read.schema(CHANGE).parquet(folder), batch)

    own = {STATE_STORE: ROCKSDB, **PACKED, **DROP_SHUFFLES, **({SPLIT_BYTES: split_bytes} if split_bytes else {})}
    with settings(spark, own):
        return (changed_rows(reader.json(source)).writeStream
                .outputMode("update")
                .foreachBatch(process)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start())


def rejected_records(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """All records that a stream has set aside, with the batch that met them; None before the first batch."""
    try:
        changes = spark.read.schema(f"{CHANGE}, batch long").parquet(f"{checkpoint.rstrip('/')}-changes")
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise
    return changes.filter(F.col("kind") == REJECTED).select("batch", F.from_json("body", API_RECORD).alias("record"))
