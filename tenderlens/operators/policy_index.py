"""Daily article counts and normalised policy indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rate column -> (article count behind it, index made of it).
RATES = {
    "rate": ("fiscal_articles", "fiscal_policy_index"),
    "tariff_rate": ("tariff_fiscal_articles", "tariff_fiscal_index"),
    "non_tariff_rate": ("non_tariff_fiscal_articles", "non_tariff_fiscal_index"),
}


def daily_article_counts(articles: DataFrame) -> DataFrame:
    """Per day: articles, fiscal, tariff, and fiscal minus tariff.

    Trade articles need not be fiscal ones, so the difference can be negative.
    """
    fiscal = F.coalesce(F.sum(F.col("is_fiscal_article").cast("bigint")), F.lit(0))
    tariff = F.coalesce(F.sum(F.col("has_tariff").cast("bigint")), F.lit(0))
    return articles.dropna(subset=["date"]).groupBy("date").agg(
        F.count("article_id").alias("total_articles"),
        fiscal.alias("fiscal_articles"),
        tariff.alias("tariff_fiscal_articles"),
        (fiscal - tariff).alias("non_tariff_fiscal_articles"))


def normalized_index(daily: DataFrame) -> DataFrame:
    """Rates per article and indices whose mean over all days is 100."""
    rated = daily.withColumns({
        rate: F.try_divide(F.col(count).cast("double"), F.col("total_articles").cast("double"))
        for rate, (count, _) in RATES.items()})
    # One row per day, so its means come from a window over the days: articles are classified once.
    everything = Window.partitionBy(F.lit(1))
    means = [F.avg(rate).over(everything) for rate in RATES]
    return rated.withColumns({
        index: F.try_divide(F.col(rate), mean) * 100
        for mean, (rate, (_, index)) in zip(means, RATES.items())})


def normalized_index_v1(articles: DataFrame, digits: int = 4) -> DataFrame:
    """The first version of the index: rates and indices rounded, trade left out."""
    daily = articles.dropna(subset=["date"]).groupBy("date").agg(
        F.coalesce(F.sum(F.col("is_fiscal_article").cast("bigint")), F.lit(0)).alias("is_fiscal_article"),
        F.count(F.lit(1)).alias("total_articles"))
    rated = daily.withColumn(
        "rate", F.bround(F.col("is_fiscal_article").cast("double") / F.col("total_articles"), digits))
    mean = F.avg("rate").over(Window.partitionBy(F.lit(1)))
    return rated.withColumn(
        "fiscal_policy_index", F.bround(F.try_divide(F.col("rate"), mean) * 100, digits))


def overall_share(daily: DataFrame) -> DataFrame:
    """Totals over all days and the fiscal share in percent."""
    fiscal, total = F.sum("fiscal_articles"), F.sum("total_articles")
    share = F.try_divide(fiscal.cast("double"), total.cast("double")) * 100
    return daily.agg(
        fiscal.alias("fiscal_articles"), F.sum("tariff_fiscal_articles").alias("tariff_articles"),
        total.alias("total_articles"), F.bround(share, 2).alias("fiscal_share_pct"))
