"""Correlations, trend lines, z-scores and the stress index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.functions.measures import (correlation_direction, correlation_strength,
                                           pair_correlation, pair_count)
from tenderlens.operators.filters import complete_cases
from tenderlens.session import scalars


# Below this share of the mean a deviation is rounding: the values are constant.
_CONSTANT = 1e-13
_MOMENTS = "x int, y int, n long, mean_x double, mean_y double, m2_x double, m2_y double, c double, rows long"


def pair_moments(values: np.ndarray) -> np.ndarray:
    """(6, k, k): for every two columns n, both means, both sums of squares and the sum of products, over the
    rows where both are present (NaN is missing). Sums are taken about the columns' means."""
    present = ~np.isnan(values)
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = np.nan_to_num(np.where(present, values, 0).sum(0) / present.sum(0))
        apart = np.where(present, values - centre, 0.0)
        seen = present.astype(float)
        n, first, second = seen.T @ seen, apart.T @ seen, (apart ** 2).T @ seen
        mean = np.nan_to_num(first / n)
        squares = second - first * mean
        squares[squares <= _CONSTANT * second] = 0.0
        products = apart.T @ apart - first * mean.T
    return np.stack([n, centre[:, None] + mean, centre[None] + mean.T, squares, squares.T, products])


def merged_moments(parts: np.ndarray) -> np.ndarray:
    """Moments (parts, 6, ...) of disjoint rows put together."""
    n, mean_x, mean_y, m2_x, m2_y, c = np.moveaxis(parts, 1, 0)
    total = n.sum(0)
    share = n / np.maximum(total, 1)
    held = np.argmax(n > 0, axis=0)[None]

    def centred(mean):
        first = np.take_along_axis(mean, held, 0)
        middle = first + (share * np.where(n > 0, mean - first, 0)).sum(0)
        return middle[0], np.where(n > 0, mean - middle, 0)

    (at_x, off_x), (at_y, off_y) = centred(mean_x), centred(mean_y)
    return np.stack([total, at_x, at_y, (m2_x + n * off_x ** 2).sum(0), (m2_y + n * off_y ** 2).sum(0),
                     (c + n * off_x * off_y).sum(0)])


def _long_pairs(df: DataFrame, group: list[str], pairs: list[tuple[str, str]],
                rows_needed: int = 0) -> DataFrame:
    """All pair statistics from one pass, one output row per pair (and group).

    Every task keeps one matrix of pair moments per group, which a batch of rows updates by a few matrix products;
    what is shuffled is one row per task, group and pair. Moments are taken about means, so large
    offsets do no harm.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    # A pair both ways round is computed once.
    names: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for a, b in pairs:
        names.setdefault((min(at[a], at[b]), max(at[a], at[b])), []).append((a, b))
    keys = [f"_g{i}" for i in range(len(group))]
    given = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)],
                      *[F.col(c).cast("double").alias(f"_v{i}") for c, i in at.items()])
    key_fields = [T.StructField(k, given.schema[k].dataType) for k in keys]
    schema = T.StructType([*key_fields, *T.StructType.fromDDL(_MOMENTS).fields])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple[np.ndarray, int]] = {}
        for frame in batches:
            groups = frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]
            for key, part in groups:
                new = pair_moments(part[[f"_v{i}" for i in range(len(columns))]].to_numpy(float))
                key = tuple(None if pd.isna(k) else k for k in key)
                old, rows = found.get(key, (None, 0))
                found[key] = (new if old is None else merged_moments(np.stack([old, new])), rows + len(part))
        for key, (m, rows) in found.items():
            out = pd.DataFrame([(x, y, *m[:, x, y], rows) for x, y in names],
                               columns=["x", "y", "n", "mean_x", "mean_y", "m2_x", "m2_y", "c", "rows"])
            out["n"] = out["n"].astype("int64")
            for k, value in zip(keys, key):
                out[k] = pd.Series([value] * len(out), dtype=object)
            yield out[[*keys, *out.columns[:9]]]

    def correlate(frame: pd.DataFrame) -> pd.DataFrame:
        # One row per task that met the group.
        n, at_x, at_y, m2_x, m2_y, c = merged_moments(
            frame[["n", "mean_x", "mean_y", "m2_x", "m2_y", "c"]].to_numpy(float))
        varies = n > 1 and m2_x > n * (_CONSTANT * at_x) ** 2 and m2_y > n * (_CONSTANT * at_y) ** 2
        out = frame[[*keys, "x", "y"]].head(1).copy()
        out["r"], out["n_obs"], out["rows"] = [c / np.sqrt(m2_x * m2_y) if varies else None], int(n), int(frame["rows"].sum())
        return out

    merged_schema = T.StructType([*key_fields, *T.StructType.fromDDL("x int, y int, r double, n_obs long, rows long").fields])
    table = given.mapInPandas(moments, schema).groupBy(*keys, "x", "y").applyInPandas(correlate, merged_schema)
    labels = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(a).alias("col_a"), F.lit(b).alias("col_b"))
                       for (x, y), both in names.items() for a, b in both])
    mine = F.filter(labels, lambda e: (e["x"] == F.col("x")) & (e["y"] == F.col("y")))
    return table.filter(F.col("rows") >= rows_needed).select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], F.explode(mine).alias("_pair"), "r", "n_obs",
    ).select(*group, "_pair.col_a", "_pair.col_b", "r", "n_obs")


def corr_matrix(df: DataFrame, columns: list[str], group: list[str] = (), min_rows: int = 0) -> DataFrame:
    """Square matrix in long form; each pair uses its own complete rows.

    Groups with fewer than ``min_rows`` rows, missing values counted, are left out.
    """
    return _long_pairs(df, list(group), [(a, b) for a in columns for b in columns], min_rows)


def corr_matrix_listwise(df: DataFrame, columns: list[str], group: list[str] = (),
                         min_n: int = 11) -> DataFrame:
    """Square matrix over rows complete in all columns."""
    return corr_matrix(complete_cases(df, columns), columns, group, min_n)


def corr_pairs(df: DataFrame, xs: list[str], ys: list[str], min_n: int = 10, digits: int = 4) -> DataFrame:
    """Every x against every y with strength, direction and observations."""
    pairs = _long_pairs(df, [], [(x, y) for x in xs for y in ys]).filter(F.col("n_obs") >= min_n)
    return pairs.select(
        F.col("col_a").alias("index_name"), F.col("col_b").alias("metric"),
        F.round("r", digits).alias("r"), correlation_strength("r").alias("strength"),
        correlation_direction("r").alias("direction"), "n_obs")


def policy_correlations(daily: DataFrame, min_fima: int = 11) -> DataFrame:
    """The four headline figures of the policy page."""
    index, btc = "fiscal_policy_index", "bid_to_cover_ratio"
    return daily.agg(
        pair_correlation(index, btc).alias("index_btc"),
        pair_correlation(index, "avg_high_yield").alias("index_yield"),
        pair_correlation("tariff_fiscal_index", btc).alias("tariff_btc"),
        F.when(pair_count(index, "fima_share") >= min_fima,
               pair_correlation(index, "fima_share")).alias("index_fima"))


def ols_trendline(df: DataFrame, x: str, y: str, group: list[str] = (), min_n: int = 10) -> DataFrame:
    """Least-squares line of y on x."""
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*group).agg(
        F.regr_slope(v, u).alias("slope"), F.regr_intercept(v, u).alias("intercept"),
        F.regr_r2(v, u).alias("r2"), F.regr_count(v, u).alias("n_obs"),
    ).filter(F.col("n_obs") >= min_n)


def zscore(df: DataFrame, column: str, partition: list[str] = (), name: str = "z_score") -> DataFrame:
    """(x - mean) / sample deviation over a group or over everything."""
    x = F.col(column).cast("double")
    if not partition:
        mean, std = scalars(df, F.avg(x), F.stddev_samp(x))
        return df.withColumn(name, F.try_divide(x - mean, std))
    moments = df.groupBy(*partition).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))
    return (
        df.join(moments, list(partition), "left")
        .withColumn(name, F.try_divide(x - F.col("_mean"), F.col("_std")))
        .drop("_mean", "_std"))


def detect_anomalies(auctions: DataFrame, column: str = "bid_to_cover_ratio",
                     group: str = "security_type", threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` deviations from their group mean."""
    scored = zscore(auctions.dropna(subset=[column, group]), column, [group])
    return scored.withColumn("z_score", F.abs("z_score")).filter(F.col("z_score") > threshold)


def market_stress_index(weekly: DataFrame) -> DataFrame:
    """Mean of negated demand, yield and volatility z-scores over weeks."""
    sources = {"btc_zscore": "avg_btc", "yield_zscore": "avg_yield", "volatility_zscore": "std_btc"}
    # One row per week: a window over the weeks, so that the auctions are read once.
    everything = Window.partitionBy(F.lit(1))
    moments = [f(F.col(c)).over(everything) for c in sources.values() for f in (F.avg, F.stddev_samp)]
    scored = weekly.withColumns({
        name: F.try_divide(F.col(c) - moments[2 * i], moments[2 * i + 1])
        for i, (name, c) in enumerate(sources.items())
    })
    return scored.withColumn(
        "stress_index",
        (-F.col("btc_zscore") + F.col("yield_zscore") + F.col("volatility_zscore")) / 3)
