"""Queries over bars, trades and option rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators, signals
from tidemark.operators import trades as trade_ops
from tidemark.workloads.adapters import BARS, TICKS, TRADES, bars, r, rounded, stamp, ticks, trades
from tidemark.workloads.registry import workload

DAY = ["ticker", "day"]

_LOG = """
lr as (select *, ln(nullif(close, 0)) - lag(ln(nullif(close, 0))) over w as lr from bars
       window w as (partition by ticker, day order by ts))
"""


@workload("rolling_stats", sql=f"""
with {BARS}, {_LOG}
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
  round(case when count(lr) over w30 >= 8 then stddev_samp(lr) over w30 * sqrt(98280) end, 6) as realized_vol_30m,
  round(case when count(lr) over w60 >= 15 then stddev_samp(lr) over w60 * sqrt(98280) end, 6) as realized_vol_60m,
  round(case when count(close) over w10 >= 3 then close / avg(close) over w10 - 1 end, 6) as sma_10_ratio,
  round(case when count(close) over w30 >= 8 then close / avg(close) over w30 - 1 end, 6) as sma_30_ratio,
  round(case when count(volume) over w30 >= 8 then
        (volume - avg(volume) over w30) / nullif(stddev_samp(volume) over w30, 0) end, 6) as stock_volume_z30,
  round((high - low) / nullif(close, 0), 6) as intraday_range
from lr
window w10 as (partition by ticker, day order by ts rows between 9 preceding and current row),
       w30 as (partition by ticker, day order by ts rows between 29 preceding and current row),
       w60 as (partition by ticker, day order by ts rows between 59 preceding and current row)
""")
def rolling_stats(t):
    """Realised volatility, moving-average ratios, volume z-score and range per bar."""
    names = ["realized_vol_30m", "realized_vol_60m", "sma_10_ratio", "sma_30_ratio", "stock_volume_z30", "intraday_range"]
    d = indicators.rolling_stats(bars(t), keys=DAY)
    return d.select("ticker", stamp(F.col("ts")).alias("ts"), *rounded(d, names))


@workload("lag_returns", sql=f"""
with {BARS}
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
  round(close / nullif(lag(close, 1) over w, 0) - 1, 6) as stock_return_1m,
  round(close / nullif(lag(close, 5) over w, 0) - 1, 6) as stock_return_5m,
  round(close / nullif(lag(close, 30) over w, 0) - 1, 6) as stock_return_30m,
  round(close / nullif(lag(close, 60) over w, 0) - 1, 6) as stock_return_60m
from bars window w as (partition by ticker, day order by ts)
""")
def lag_returns(t):
    """Returns over 1, 5, 30 and 60 bars."""
    d = indicators.lag_returns(bars(t), keys=DAY)
    return d.select("ticker", stamp(F.col("ts")).alias("ts"),
                    *rounded(d, [f"stock_return_{k}m" for k in (1, 5, 30, 60)]))


_RSI = """
mv as (select *, close - lag(close) over (partition by ticker, day order by ts) as mv from bars),
rs as (select ticker, ts, count(mv) over w as n,
         avg(case when mv is null then null when mv > 0 then mv else 0 end) over w as up,
         avg(case when mv is null then null when mv < 0 then -mv else 0 end) over w as dn
       from mv window w as (partition by ticker, day order by ts rows between 13 preceding and current row))
"""


@workload("rsi14", sql=f"""
with {BARS}, {_RSI}
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
       round(case when n >= 5 then 100 - 100 / (1 + up / nullif(dn, 0)) end, 6) as rsi14
from rs
""")
def rsi14(t):
    """Relative strength over 14 bars by simple means."""
    return indicators.rsi(bars(t), keys=DAY).select("ticker", stamp(F.col("ts")).alias("ts"), r("rsi14").alias("rsi14"))


@workload("macd", sql=f"""
with recursive {BARS},
numbered as (select ticker, day, ts, close, row_number() over (partition by ticker, day order by ts) as rn from bars),
ema as (
  select ticker, day, ts, rn, close, close as fast, close as slow from numbered where rn = 1
  union all
  select n.ticker, n.day, n.ts, n.rn, n.close,
         n.close * (2.0::double / 13) + e.fast * (1 - 2.0::double / 13),
         n.close * (2.0::double / 27) + e.slow * (1 - 2.0::double / 27)
  from ema e join numbered n on n.ticker = e.ticker and n.day = e.day and n.rn = e.rn + 1)
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, round((fast - slow) / nullif(close, 0), 6) as macd_ratio
from ema
""")
def macd(t):
    """Difference of a fast and a slow exponential mean relative to the price."""
    return indicators.macd(bars(t), keys=DAY).select(
        "ticker", stamp(F.col("ts")).alias("ts"), r("macd_ratio").alias("macd_ratio"))


_FLAGGED = f"""
{BARS}, {_LOG},
feat as (
  select ticker, ts, close,
    close / nullif(lag(close, 30) over w, 0) - 1 as move30, close / nullif(lag(close, 5) over w, 0) - 1 as move5,
    case when count(lr) over w30 >= 8 then stddev_samp(lr) over w30 * sqrt(98280) end as rv,
    case when count(volume) over w30 >= 8 then
        (volume - avg(volume) over w30) / nullif(stddev_samp(volume) over w30, 0) end as z
  from lr
  window w as (partition by ticker, day order by ts),
         w30 as (partition by ticker, day order by ts rows between 29 preceding and current row)),
flags as (
  select ticker, ts, close, move30, rv, z,
    coalesce(move30 >= 0.015, false)::double as event_stock_breakout_up_30m,
    coalesce(move30 <= -0.015, false)::double as event_stock_breakdown_30m,
    coalesce(rv >= 0.7, false)::double as event_high_realized_vol,
    coalesce(z >= 2, false)::double as event_stock_volume_spike,
    coalesce(move5 >= 0.1, false)::double as event_option_jump_up,
    coalesce(move5 <= -0.1, false)::double as event_option_jump_down,
    (day(ts) % 30 between 10 and 15)::double as event_earnings_within_5d
  from feat)
"""


def _flagged(t):
    d = indicators.lag_returns(bars(t), keys=DAY)
    d = indicators.rolling_stats(d, keys=DAY)
    # The bar doubles as the option bar, and a made-up release falls on the 15th.
    d = d.withColumn("option_return_5m", F.col("stock_return_5m")) \
         .withColumn("days_to_earnings", F.lit(15.0) - F.dayofmonth("ts") % 30)
    return indicators.event_flags(d)


@workload("event_flags", sql=f"""
with {_FLAGGED}
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, event_stock_breakout_up_30m, event_stock_breakdown_30m,
       event_high_realized_vol, event_stock_volume_spike, event_option_jump_up, event_option_jump_down,
       event_earnings_within_5d
from flags
""")
def event_flags(t):
    """Seven event flags per bar."""
    return _flagged(t).select("ticker", stamp(F.col("ts")).alias("ts"), *signals.EVENT_FLAGS)


@workload("event_engine", sql=f"""
with {_FLAGGED},
hits as (select * from flags where greatest(event_stock_breakout_up_30m, event_stock_breakdown_30m,
   event_high_realized_vol, event_stock_volume_spike, event_option_jump_up, event_option_jump_down,
   event_earnings_within_5d) > 0)
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as minute,
  round(max(coalesce(rv, 0)), 6) as realized_vol_30m, round(max(coalesce(z, 0)), 6) as stock_volume_z30,
  round(avg(coalesce(move30, 0)), 6) as stock_return_30m, round(avg(close), 6) as close_stock,
  concat_ws('|',
    case when max(event_stock_breakout_up_30m) > 0 then 'stock_breakout_up_30m' end,
    case when max(event_stock_breakdown_30m) > 0 then 'stock_breakdown_30m' end,
    case when max(event_high_realized_vol) > 0 then 'high_realized_vol' end,
    case when max(event_stock_volume_spike) > 0 then 'stock_volume_spike' end,
    case when max(event_option_jump_up) > 0 then 'option_jump_up' end,
    case when max(event_option_jump_down) > 0 then 'option_jump_down' end,
    case when max(event_earnings_within_5d) > 0 then 'earnings_within_5d' end) as event_labels
from hits group by ticker, ts
""")
def event_engine(t):
    """Minutes with any event, their measures and a readable label list."""
    d = signals.detect_events(_flagged(t).withColumn("close_stock", F.col("close")), keys=["ticker"])
    return d.select("ticker", stamp(F.col("minute")).alias("minute"), "event_labels",
                    *rounded(d, ["realized_vol_30m", "stock_volume_z30", "stock_return_30m", "close_stock"]))


_TRADE_MEASURES = """count(size) as trade_count, sum(size) as trade_volume,
  round(sum(price * size), 2) as trade_dollar_volume, max(size) as max_trade_size,
  round(sqrt(sum(price * price * size) / sum(size)), 6) as trade_rms_price"""


@workload("trade_minute", sql=f"""
with {TRADES}
select ticker, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') as minute, {_TRADE_MEASURES}
from trades group by ticker, date_trunc('minute', ts)
""")
def trade_minute(t):
    """Trades folded per ticker and minute."""
    d = trade_ops.trade_minutes(trades(t), keys=["ticker"])
    return d.select("ticker", stamp(F.col("minute")).alias("minute"), "trade_count", "trade_volume", "max_trade_size",
                    r("trade_dollar_volume", 2).alias("trade_dollar_volume"),
                    r(F.sqrt(F.col("trade_price_sq_x_size") / F.col("trade_volume"))).alias("trade_rms_price"))


@workload("trade_vwap", sql=f"""
with {TRADES}
select ticker, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') as minute, count(size) as trade_count,
       max(size) as max_trade_size, round(sum(price * size) / sum(size), 6) as trade_vwap
from trades group by ticker, date_trunc('minute', ts)
""")
def trade_vwap(t):
    """Minute aggregates of several parts merged, with the volume-weighted price."""
    parts = trade_ops.trade_minutes(trades(t), keys=["ticker", "part"])
    d = trade_ops.merge_trade_parts(parts, keys=["ticker"])
    return d.select("ticker", stamp(F.col("minute")).alias("minute"), "trade_count", "max_trade_size",
                    r("trade_vwap").alias("trade_vwap"))


@workload("trade_left_join", sql=f"""
with {BARS}, {TICKS},
m as (select side as ticker, date_trunc('minute', ts) as minute, count(*) as trade_count, sum(value) as trade_volume
      from ticks group by all),
oi as (select side as ticker, arg_max(value, event_id) as oi from ticks group by side)
select ticker, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, close, m.trade_count,
       round(m.trade_volume, 4) as trade_volume, oi as oi_open_interest
from bars left join m on m.ticker = bars.ticker and m.minute = bars.ts
          left join oi on oi.ticker = bars.ticker
""".replace("select ticker, strftime(ts", "select bars.ticker, strftime(bars.ts"))
def trade_left_join(t):
    """Bars with their minute's trades (kept when there are none) and open interest."""
    side = ticks(t).withColumnRenamed("side", "ticker")
    minutes = side.groupBy("ticker", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("value").alias("trade_volume"))
    d = trade_ops.attach_trades(bars(t), minutes, keys=["ticker"])
    d = trade_ops.attach_open_interest(
        d, ticks(t).withColumnRenamed("side", "ticker"), keys=["ticker"], order="event_id",
        columns={"value": "oi_open_interest"})
    return d.select("ticker", stamp(F.col("ts")).alias("ts"), "close", "trade_count",
                    r("trade_volume", 4).alias("trade_volume"), "oi_open_interest")
