"""Global order without a single task: positions, running totals and state carried over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.session import materialise

SAMPLE = 32  # keys per slice that settle its border
HALO_ROWS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def sliced(df: DataFrame, order: list) -> DataFrame:
    """Range-partition and sort by a unique order; add ``_slice`` and ``_offset`` within it.

    The range partitioner splits on the full key, so a date or type that holds a third of the
    rows is spread over many slices. The slices are checkpointed because later steps read them
    twice and both reads must see the same slice borders.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialise(
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return numbered.select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).alias("_slice"),
        F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_offset"),
    )


def _before(slices: DataFrame, amount: Column) -> DataFrame:
    # One row per slice: never more rows than spark.sql.shuffle.partitions.
    totals = slices.groupBy("_slice").agg(amount.alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(
        "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Number all rows 0, 1, 2, ... in a unique order."""
    slices = sliced(df, order)
    return (
        slices.join(_before(slices, F.count(F.lit(1))), "_slice")
        .withColumn(name, F.col("_before") + F.col("_offset"))
        .drop("_slice", "_offset", "_before")
    )


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows (the row itself excluded)."""
    slices = sliced(df, order)
    earlier = Window.partitionBy("_slice").orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.join(_before(slices, F.sum(value)), "_slice")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        .drop("_slice", "_offset", "_before")
    )


def keyed_slices(df: DataFrame, order: list, slices: int) -> DataFrame:
    """Add ``_slice``, which depends on nothing but the row's place in a unique order.

    The borders are quantiles of the keys with the smallest hashes, ``SAMPLE`` a slice, so a day or type that
    holds a third of the rows spans many slices. The sample settles where the cuts lie, never which rows count:
    every row finds its slice by binary search among the borders. Nulls come first, as in a sort. As the same
    rows always give the same borders, the frame may be read again or a task repeated at any time.
    """
    keys = df.select(F.struct(*order).alias("key"))
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * slices)
    cuts = materialise(sample.agg(F.sort_array(F.collect_list("key")).alias("keys")).select(
        F.filter("keys", lambda key, at: (at + 1) % F.greatest(F.size("keys") / slices, F.lit(1)).cast("int") == 0)
        .alias("_borders")))
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range((2 * slices).bit_length()))])
    return df.withColumns({"_borders": cuts.scalar(), "_key": F.struct(*order)}).withColumn(
        "_slice", F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            F.get("_borders", at + step - 1) <= F.col("_key"), at + step).otherwise(at))
    ).drop("_borders", "_key")


def with_halo(df: DataFrame, order: list, reach: int, slices: int) -> DataFrame:
    """Rows in slices of a unique order, each slice preceded by the ``reach`` rows before it.

    Adds ``_slice`` and ``_halo`` (true for the rows lent by earlier slices). Only the last ``reach`` rows of every
    slice are lent. A row serves each slice whose first row is among the ``reach`` rows after it, several where slices
    are short. These rows meet in one task to be told their slices, so there are at most ``HALO_ROWS / reach`` slices.
    """
    rows = keyed_slices(df, order, max(1, min(slices, HALO_ROWS // max(reach, 1)))).repartition("_slice")
    backwards = Window.partitionBy("_slice").orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= reach)
    following = Window.orderBy(*order).rowsBetween(1, reach)
    served = tails.withColumn("_served", F.collect_set("_slice").over(following))
    lent = served.withColumn("_target", F.explode(F.array_except("_served", F.array("_slice"))))
    halo = lent.select(*df.columns, F.col("_target").alias("_slice"), F.lit(True).alias("_halo"))
    return rows.withColumn("_halo", F.lit(False)).unionByName(halo.repartition("_slice"))


def block_starts(marks: DataFrame, group: list[str], block: str, line: str,
                 totals: dict[str, str], latest: dict[str, str]) -> DataFrame:
    """State at the start of every block: sums and last non-null values of all earlier blocks.

    The window runs over one row per block, so even a file of many terabytes is a short group.
    """
    per_block = marks.groupBy(*group, block).agg(
        *[F.sum(column).alias(name) for name, column in totals.items()],
        *[F.max_by(column, F.when(F.col(column).isNotNull(), F.col(line))).alias(name)
          for name, column in latest.items()],
    )
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *group, block,
        *[F.sum(name).over(earlier).alias(name) for name in totals],
        *[F.last(name, ignorenulls=True).over(earlier).alias(name) for name in latest],
    )
