"""Bar indicators.  Every window is one ticker-day, so no partition is larger than
the minutes of a day whatever the history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schema import flag, ratio

# Lag steps, rolling frames (rows, rows needed) and the year in minutes.
RETURN_LAGS = (1, 5, 30, 60)
OPTION_RETURN_LAGS = (1, 5, 30)
VOLATILITY_FRAMES = {"realized_vol_30m": (30, 8), "realized_vol_60m": (60, 15)}
AVERAGE_FRAMES = {"sma_10_ratio": (10, 3), "sma_30_ratio": (30, 8)}
VOLUME_FRAME = (30, 8)
RSI_FRAME = (14, 5)
MACD_SPANS = (12, 26)
MARKET_MINUTES_PER_YEAR = 390 * 252


def day_window(keys: list[str], order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(column: Column, function, window: WindowSpec, rows: int, needed: int) -> Column:
    """Row-frame statistic, null until ``needed`` values are in the frame."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) >= needed, function(column).over(frame))


def lag_returns(bars: DataFrame, *, keys: list[str], order: str = "ts", price: str = "close",
                lags: tuple[int, ...] = RETURN_LAGS, prefix: str = "stock_return_") -> DataFrame:
    """Return over the last k *rows*; a missing price repeats the last known one."""
    w = day_window(keys, order)
    filled = bars.withColumn("_px", F.last(price, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = [(ratio(F.col("_px"), F.lag("_px", k).over(w)) - 1).alias(f"{prefix}{k}m") for k in lags]
    return filled.select("*", *steps).drop("_px")


def rolling_stats(bars: DataFrame, *, keys: list[str], order: str = "ts") -> DataFrame:
    w = day_window(keys, order)
    log_price = F.ln(F.nullif("close", F.lit(0.0)))
    d = bars.withColumn("_lr", log_price - F.lag(log_price).over(w))
    out = [(rolling(F.col("_lr"), F.stddev_samp, w, n, k) * F.lit(math.sqrt(MARKET_MINUTES_PER_YEAR))).alias(name)
           for name, (n, k) in VOLATILITY_FRAMES.items()]
    out += [(ratio(F.col("close"), rolling(F.col("close"), F.avg, w, n, k)) - 1).alias(name)
            for name, (n, k) in AVERAGE_FRAMES.items()]
    spread = F.nullif(rolling(F.col("volume"), F.stddev_samp, w, *VOLUME_FRAME), F.lit(0.0))
    out.append(ratio(F.col("volume") - rolling(F.col("volume"), F.avg, w, *VOLUME_FRAME), spread)
               .alias("stock_volume_z30"))
    out.append(ratio(F.col("high") - F.col("low"), F.col("close")).alias("intraday_range"))
    return d.select("*", *out).drop("_lr")


def rsi(bars: DataFrame, *, keys: list[str], order: str = "ts", out: str = "rsi14") -> DataFrame:
    """Relative strength by simple rolling means; no loss in the frame gives null."""
    w = day_window(keys, order)
    d = bars.withColumn("_move", F.col("close") - F.lag("close").over(w))
    up = F.when(F.col("_move") > 0, F.col("_move")).when(F.col("_move").isNotNull(), F.lit(0.0))
    down = F.when(F.col("_move") < 0, -F.col("_move")).when(F.col("_move").isNotNull(), F.lit(0.0))
    d = d.withColumn("_up", up).withColumn("_down", down)
    strength = ratio(rolling(F.col("_up"), F.avg, w, *RSI_FRAME),
                     F.nullif(rolling(F.col("_down"), F.avg, w, *RSI_FRAME), F.lit(0.0)))
    return d.withColumn(out, 100 - 100 / (1 + strength)).drop("_move", "_up", "_down")


# Natural logarithms of decay within which weights are summed together.
STRETCH = 300


def ewm_mean(frame: DataFrame, column: str, span: int, *, keys: list[str], order: str, out: str) -> DataFrame:
    """Recursive exponential mean as two window sums instead of a row loop.

    With decay ``d = (1-a)^gap`` since the last value, the mean is the linear
    recurrence ``m = (d*m' + a*x) / (d + a)``, which unrolls to a running product
    of the ``d/(d+a)`` factors times a running sum.  A missing value keeps
    decaying the old weight and repeats the mean.
    """
    alpha = 2.0 / (span + 1.0)
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.col(column).isNotNull()
    d = frame.withColumn("_rn", F.row_number().over(w))
    previous = F.last(F.when(known, F.col("_rn")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_gap", F.when(known, F.col("_rn") - previous))
    decay = F.pow(F.lit(1 - alpha), F.col("_gap"))
    d = d.withColumn("_log_keep", F.coalesce(F.ln(decay / (decay + alpha)), F.lit(0.0)))
    d = d.withColumn("_fresh", F.when(known & F.col("_gap").isNull(), F.col(column))
                     .when(known, F.col(column) * alpha / (decay + alpha)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_log_product", F.sum("_log_keep").over(so_far))
    # Rows of one stretch decay by less than exp(STRETCH), so nothing overflows; of what came
    # before only the stretch just before still counts, anything older is below exp(-STRETCH).
    d = d.withColumn("_stretch", F.floor(-F.col("_log_product") / STRETCH))
    local = F.col("_log_product") + F.col("_stretch") * STRETCH
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order)
    d = d.withColumn("_own", F.exp(local) * F.sum(F.col("_fresh") * F.exp(-local)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag(F.struct("_stretch", "_own", "_log_product")).over(w)
    d = d.withColumn("_before", before).withColumn("_before", F.first("_before").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    carried = F.when(F.col("_before._stretch") == F.col("_stretch") - 1, F.col("_before._own") * F.exp(F.col("_log_product") - F.col("_before._log_product")))
    return d.withColumn(out, F.col("_own") + F.coalesce(carried, F.lit(0.0))).drop(
        "_rn", "_gap", "_log_keep", "_fresh", "_log_product", "_stretch", "_own", "_before")


def macd(bars: DataFrame, *, keys: list[str], order: str = "ts", out: str = "macd_ratio") -> DataFrame:
    fast, slow = MACD_SPANS
    d = ewm_mean(bars, "close", fast, keys=keys, order=order, out="_fast")
    d = ewm_mean(d, "close", slow, keys=keys, order=order, out="_slow")
    return d.withColumn(out, ratio(F.col("_fast") - F.col("_slow"), F.col("close"))).drop("_fast", "_slow")


def stock_features(bars: DataFrame, *, keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """All bar indicators; the windows share one sort on (ticker, day)."""
    keys = keys or ["ticker", "day"]
    d = lag_returns(bars, keys=keys, order=order)
    d = rolling_stats(d, keys=keys, order=order)
    d = macd(d, keys=keys, order=order)
    return rsi(d, keys=keys, order=order)


# Event thresholds.
STOCK_MOVE_30M = 0.015
HIGH_VOLATILITY = 0.70
VOLUME_SPIKE_Z = 2.0
OPTION_MOVE_5M = 0.10
EARNINGS_WITHIN_DAYS = 5


def event_flags(frame: DataFrame) -> DataFrame:
    """The seven market event flags as 0.0/1.0; a missing input never raises one.
    Inputs the frame lacks count as missing."""
    def of(name):
        return F.col(name) if name in frame.columns else F.lit(None).cast("double")
    move, option_move = of("stock_return_30m"), of("option_return_5m")
    to_earnings = of("days_to_earnings")
    return frame.withColumns({
        "event_stock_breakout_up_30m": flag(move >= STOCK_MOVE_30M),
        "event_stock_breakdown_30m": flag(move <= -STOCK_MOVE_30M),
        "event_high_realized_vol": flag(of("realized_vol_30m") >= HIGH_VOLATILITY),
        "event_stock_volume_spike": flag(of("stock_volume_z30") >= VOLUME_SPIKE_Z),
        "event_option_jump_up": flag(option_move >= OPTION_MOVE_5M),
        "event_option_jump_down": flag(option_move <= -OPTION_MOVE_5M),
        "event_earnings_within_5d": flag((to_earnings >= 0) & (to_earnings <= EARNINGS_WITHIN_DAYS)),
    })
