"""Time-dependent token prices and per-query search prices.

The rate tables are a few rows, which Spark broadcasts by its own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import fixed

c = F.col


def model_rates(spark: SparkSession, rates=None) -> DataFrame:
    return spark.createDataFrame(
        rates or fixed.MODEL_RATES,
        "model string, tier string, input_cache_hit double, input_cache_miss double, output double",
    )


def pricing_tier(ts: Column, weekdays=None, windows=None) -> Column:
    """``peak`` inside a weekday window (start inclusive, end exclusive, UTC), else ``off_peak``."""
    clock = F.date_format(ts, "HH:mm:ss.SSSSSS")
    inside = F.lit(False)
    for start, end in windows or fixed.PEAK_WINDOWS:
        inside = inside | ((clock >= F.lit(start + ":00.000000")) & (clock < F.lit(end + ":00.000000")))
    peak = F.weekday(ts).isin(weekdays or fixed.PEAK_WEEKDAYS) & inside
    return F.when(peak, "peak").otherwise("off_peak")


def price_usage(usage: DataFrame, rates: DataFrame, version: str = fixed.PRICING_VERSION) -> DataFrame:
    """Adds ``tier`` and ``usd``: cached and uncached prompt tokens have their own rates.

    A model without rates is an error, never a NULL price.
    """
    priced = usage.withColumn("tier", pricing_tier(c("ts"))).join(rates, ["model", "tier"], "left")
    miss = c("prompt_tokens") - c("cache_hit_prompt_tokens")
    usd = (
        c("cache_hit_prompt_tokens") * c("input_cache_hit")
        + miss * c("input_cache_miss")
        + c("completion_tokens") * c("output")
    ) / 1_000_000
    unknown = F.raise_error(F.concat(F.lit("no pricing for model "), c("model")))
    return priced.withColumn("usd", F.when(c("output").isNull(), unknown).otherwise(usd)).drop(
        "input_cache_hit", "input_cache_miss", "output"
    ).withColumn("pricing_version", F.lit(version))


def search_rates(spark: SparkSession, rates=None) -> DataFrame:
    return spark.createDataFrame(
        rates or fixed.SEARCH_RATES, "provider string, usd_per_query double, pricing_version string"
    )


def price_searches(searches: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``usd`` = queries x provider rate, with the provider's own version."""
    joined = searches.join(rates, "provider", "left")
    unknown = F.raise_error(F.concat(F.lit("no search pricing for provider "), c("provider")))
    negative = F.raise_error(F.lit("queries must be non-negative"))
    return joined.withColumn(
        "usd",
        F.when(c("usd_per_query").isNull(), unknown)
        .when(c("queries") < 0, negative)
        .otherwise(c("queries") * c("usd_per_query")),
    ).drop("usd_per_query")
