"""Row-count rolling windows.

Auction-grain input may have very few, very large partitions (a handful of security types, or
none for the whole market). There the rows are cut into slices of their order by borders taken from their
keys, and each slice also receives the last rows before it, so that every frame is complete inside its
slice. Rows are shuffled once and never written; only those last rows are. Daily-grain input has at most 366 rows a year and uses a plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.operators.ordering import with_halo

SLICES_PER_TASK = 4  # more slices than tasks even out the tasks' loads
TRADING_DAYS = 252


def haloed_window(df: DataFrame, partition: list[str], order: list[str], reach: int,
                  compute: Callable, slices: int | None = None) -> DataFrame:
    """Apply ``compute(frame, window)`` where the window sees at least ``reach`` earlier rows.

    ``window`` is partitioned and ordered but has no frame yet. ``order`` must be unique within
    a partition. There are ``SLICES_PER_TASK`` slices a shuffle partition unless ``slices`` says otherwise.
    """
    slices = slices or SLICES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_halo(df, [*partition, *order], reach, slices)
    window = Window.partitionBy(*partition, "_slice").orderBy(*order)
    return compute(rows, window).filter(~F.col("_halo")).drop("_slice", "_halo")


def _guarded(value: Column, statistic: Column, window, rows: int, min_periods: int) -> Column:
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) >= min_periods, statistic.over(frame))


def rolling_mean(df: DataFrame, value: str, order: list[str], partition: list[str] = (),
                 rows: int = 30, min_periods: int = 1, name: str = "moving_avg",
                 slices: int | None = None) -> DataFrame:
    """Rolling mean over present values, per partition or over the whole market."""
    x = F.col(value).cast("double")
    return haloed_window(
        df.filter(x.isNotNull()), list(partition), order, rows - 1,
        lambda frame, w: frame.withColumn(name, _guarded(x, F.avg(x), w, rows, min_periods)),
        slices)


def rolling_std(df: DataFrame, value: str, order: list[str], partition: list[str] = (),
                rows: int = 30, min_periods: int = 5, name: str = "volatility",
                slices: int | None = None) -> DataFrame:
    """Rolling sample deviation; missing values keep their place in the frame."""
    x = F.col(value).cast("double")
    return haloed_window(
        df, list(partition), order, rows - 1,
        lambda frame, w: frame.withColumn(name, _guarded(x, F.stddev_samp(x), w, rows, min_periods)),
        slices).filter(F.col(name).isNotNull())


def pct_change(df: DataFrame, value: str, order: list[str], partition: list[str] = (),
               name: str = "change", slices: int | None = None) -> DataFrame:
    """value / previous value - 1 (P16); null on the first row and after a zero."""
    x = F.col(value).cast("double")
    return haloed_window(
        df, list(partition), order, 1,
        lambda frame, w: frame.withColumn(name, F.try_divide(x, F.lag(x).over(w)) - 1),
        slices)


def annualized_volatility(df: DataFrame, value: str, order: list[str], partition: list[str] = (),
                          rows: int = 30, min_periods: int = 10,
                          slices: int | None = None) -> DataFrame:
    """Rolling deviation of returns times sqrt(252) (W5); both windows share one shuffle."""
    x = F.col(value).cast("double")
    change = F.col("btc_returns")

    def compute(frame, w):
        returns = frame.withColumn("btc_returns", F.try_divide(x, F.lag(x).over(w)) - 1)
        std = _guarded(change, F.stddev_samp(change), w, rows, min_periods)
        return returns.withColumn("volatility", std * F.sqrt(F.lit(TRADING_DAYS)))

    return haloed_window(df.filter(x.isNotNull()), list(partition), order, rows, compute, slices)


def smooth(daily: DataFrame, columns: list[str], order: str = "date",
           rows: int | None = 30) -> DataFrame:
    """Add ``<column>_smooth`` to a daily table (W3); ``rows=None`` leaves it as it is."""
    if rows is None:
        return daily
    frame = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    return daily.withColumns({
        f"{c}_smooth": F.avg(F.col(c).cast("double")).over(frame)
        for c in columns if c in daily.columns
    })


def rolling_mean_strict(daily: DataFrame, columns: list[str], order: str = "date",
                        rows: int = 7) -> DataFrame:
    """Mean of a daily column that is null until the window is full and has no gap."""
    window = Window.orderBy(order)
    return daily.withColumns({
        f"{c}_avg": _guarded(F.col(c).cast("double"), F.avg(F.col(c).cast("double")), window, rows, rows)
        for c in columns
    })
