"""Roll-up of a log of model calls: tokens, cache hits, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Price per million tokens (input, output) of a model without a price,
# and what cache writes and reads cost relative to input.
DEFAULT_PRICE = (5.0, 25.0)
CACHE_WRITE_FACTOR, CACHE_READ_FACTOR = 1.25, 0.10

TOKENS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")


def cost_usd(prices: dict[str, tuple[float, float]]) -> Column:
    """Cost of one call. The price list is a literal map, so no join is needed."""

    def price(part: int) -> Column:
        if not prices:
            return F.lit(DEFAULT_PRICE[part])
        entries = [F.lit(x) for m, p in prices.items() for x in (m, float(p[part]))]
        return F.coalesce(F.create_map(*entries)[F.col("model")], F.lit(DEFAULT_PRICE[part]))

    into, out = price(0), price(1)
    return (
        F.col("input_tokens") * into
        + F.col("output_tokens") * out
        + F.col("cache_write_tokens") * into * CACHE_WRITE_FACTOR
        + F.col("cache_read_tokens") * into * CACHE_READ_FACTOR
    ) / 1_000_000


def run_statistics(
    calls: DataFrame, prices: dict[str, tuple[float, float]], by: str = "run"
) -> DataFrame:
    """One row per run; combined map-side, so one huge run does not skew."""
    return (
        calls.withColumn("cost_usd", cost_usd(prices))
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            *[F.sum(t).alias(t) for t in TOKENS],
            F.count_if(F.col("cache_read_tokens") > 0).alias("cache_hit_calls"),
            F.bround(F.sum("cost_usd"), 5).alias("total_cost_usd"),
            F.sum("duration_ms").alias("duration_ms"),
        )
    )
