"""Vendor JSON payloads flattened to columns with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The payload fields read.
NEWS_JSON = ("struct<published_utc:string,title:string,description:string,publisher:struct<name:string>,tickers:array<string>,"
             "insights:array<struct<sentiment:string>>,article_url:string>")
CHAIN_JSON = ("struct<details:struct<ticker:string,contract_type:string,expiration_date:string,strike_price:double>,"
              "last_quote:struct<bid_price:double,ask_price:double>,last_trade:struct<price:double>,"
              "greeks:struct<delta:double,gamma:double,theta:double,vega:double>,underlying_asset:struct<price:double>,"
              "day:struct<close:double,volume:double>,implied_volatility:double,open_interest:bigint>")
BARS_JSON = "struct<results:array<struct<o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint,t:bigint>>>"


def flatten_news(frame: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Article fields, tickers joined, distinct sentiments in order."""
    d = frame.withColumn("_j", F.from_json(column, NEWS_JSON))
    moods = F.array_sort(F.array_distinct(F.filter(F.transform("_j.insights", lambda i: i["sentiment"]), lambda s: s.isNotNull() & (s != ""))))
    return d.select(*keep, F.try_to_timestamp("_j.published_utc").alias("published_utc"), "_j.title", "_j.description",
                    F.col("_j.publisher.name").alias("publisher"), F.array_join("_j.tickers", ",").alias("tickers"),
                    F.array_join(moods, ",").alias("sentiment"), "_j.article_url")


def flatten_chain(frame: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Contract snapshot; mid from quotes, else last trade, else the day's close."""
    d = frame.withColumn("_j", F.from_json(column, CHAIN_JSON))
    bid, ask = F.col("_j.last_quote.bid_price"), F.col("_j.last_quote.ask_price")
    return d.select(
        *keep, F.col("_j.details.ticker").alias("contract"), F.col("_j.details.contract_type").alias("option_type"),
        F.try_to_date("_j.details.expiration_date").alias("expiry"), F.col("_j.details.strike_price").alias("strike"),
        bid.alias("bid"), ask.alias("ask"), F.coalesce((bid + ask) / 2, "_j.last_trade.price", "_j.day.close").alias("mid"),
        F.col("_j.implied_volatility").alias("iv"), "_j.open_interest", "_j.greeks.delta", "_j.greeks.gamma", "_j.greeks.theta",
        "_j.greeks.vega", F.col("_j.day.volume").alias("day_volume"), F.col("_j.underlying_asset.price").alias("underlying_price"))


def flatten_bars(frame: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per bar of an aggregates payload; epoch milliseconds to UTC."""
    d = frame.select(*keep, F.inline(F.from_json(column, BARS_JSON)["results"]))
    return d.select(*keep, F.timestamp_millis("t").alias("ts"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
                    F.col("c").alias("close"), F.col("v").alias("volume"), F.col("vw").alias("vwap"), F.col("n").alias("transactions"))
