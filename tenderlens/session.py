"""Session settings and the few cluster facts the operators depend on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Shuffle files go when the action that wrote them ends; else they stay until the driver's garbage is collected.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build_session(app: str = "tenderlens", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, UTC dates and ANSI arithmetic.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit
    supplies the first, and the second should be about total input bytes / 128 MB.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one up only for a local session without any."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tenderlens-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the block only; a stream started in it keeps them."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, name: str = "settled", **options: str) -> DataFrame:
    """Write the rows as Parquet (``options``) in the shared folder and read them again: later steps prune columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder, **options)
    return spark.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, volume: Column, piece: int) -> DataFrame:
    """Rows dealt by their hash to partitions of about ``piece`` of ``volume`` each, however long the scan's splits are.

    For steps whose memory in a task grows with the rows of the task, such as combining nearly unique keys before
    a shuffle: what does not fit is sorted and written to disk. The volume is added up in a pass of its own.
    """
    total = df.agg(F.sum(volume.cast("bigint")).alias("total")).first()["total"] or 0
    return df.repartition(max(1, -(-total // piece)), *df.columns)


def scalars(df: DataFrame, *aggregates):
    """Whole-table double statistics as columns usable in any other DataFrame.

    One scalar subquery returns them all, so no join and no driver round trip is needed.
    """
    packed = df.agg(F.array(*[a.cast("double") for a in aggregates]).alias("stats")).scalar()
    return [packed[i] for i in range(len(aggregates))]
