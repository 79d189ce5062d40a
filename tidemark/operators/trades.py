"""Option trades: minute aggregates, merging of parts, and attaching to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import ratio


def trade_minutes(trades: DataFrame, *, keys: list[str], ts: str = "ts", price: str = "price",
                  size: str = "size") -> DataFrame:
    """Per key and minute; every measure is algebraic, so it combines before the shuffle."""
    money = F.col(price) * F.col(size)
    return trades.groupBy(*keys, F.date_trunc("minute", F.col(ts)).alias("minute")).agg(
        F.count(size).alias("trade_count"),
        F.sum(size).alias("trade_volume"),
        F.sum(money).alias("trade_dollar_volume"),
        F.max(size).alias("max_trade_size"),
        F.sum(money).alias("trade_price_x_size"),
        F.sum(F.col(price) * money).alias("trade_price_sq_x_size"),
    )


def merge_trade_parts(parts: DataFrame, *, keys: list[str]) -> DataFrame:
    """Fold minute aggregates of several parts; the largest trade is a maximum."""
    merged = parts.groupBy(*keys, "minute").agg(
        F.sum("trade_count").alias("trade_count"),
        F.sum("trade_volume").alias("trade_volume"),
        F.sum("trade_dollar_volume").alias("trade_dollar_volume"),
        F.max("max_trade_size").alias("max_trade_size"),
        F.sum("trade_price_x_size").alias("trade_price_x_size"),
        F.sum("trade_price_sq_x_size").alias("trade_price_sq_x_size"),
    )
    return merged.withColumn("trade_vwap", ratio(F.col("trade_price_x_size"), F.col("trade_volume")))


def attach_trades(bars: DataFrame, minutes: DataFrame, *, keys: list[str], ts: str = "ts") -> DataFrame:
    """Left join on (contract, minute).  The right side is unique per key, and AQE
    splits a skewed contract."""
    return bars.withColumn("minute", F.date_trunc("minute", F.col(ts))).join(
        minutes, [*keys, "minute"], "left")


def attach_open_interest(bars: DataFrame, snapshots: DataFrame, *, keys: list[str], order: str,
                         columns: dict[str, str]) -> DataFrame:
    """Left join of the newest snapshot per key; ``columns`` maps source to output names."""
    newest = snapshots.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in columns]), F.col(order)).alias("_s"))
    renamed = newest.select(*keys, *[F.col(f"_s.{c}").alias(n) for c, n in columns.items()])
    return bars.join(renamed, keys, "left")
