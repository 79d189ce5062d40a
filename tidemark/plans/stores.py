"""End-to-end jobs: feature store, pair store, scoring.

Each is one DataFrame program over every (ticker, day) at once; the only exchanges
are on (ticker, day) or (contract, day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import earnings, indicators, newswindows, options, rates, signals, targets
from tidemark.operators import trades as trade_ops
from tidemark.operators.asof import Source, asof_many
from tidemark.schema import OPTION_BARS, QUOTE_COLUMNS, STOCK_BARS, conform
from tidemark.session import cut

# How old stock features may be on an option row, and the target horizon.
STOCK_TOLERANCE_SECONDS = 120
TARGET_MINUTES, TARGET_TOLERANCE_MINUTES = 30, 5
STOCK_FEATURES = ("stock_return_1m", "stock_return_5m", "stock_return_30m", "stock_return_60m", "realized_vol_30m", "realized_vol_60m",
                  "sma_10_ratio", "sma_30_ratio", "macd_ratio", "rsi14", "stock_volume_z30", "intraday_range")


def moments(option_rows: DataFrame, stock_bars: DataFrame, *, reports: DataFrame | None = None, report_tie: str | None = None,
            articles: DataFrame | None = None, article_tie: tuple[str, ...] = ()) -> DataFrame:
    """(underlying, ts, everything known of the underlying then) for the instants of option rows.

    There are a few hundred contracts to an instant, so stock features, reports and
    news are looked up here once, in one time line, and contracts join by equality.
    """
    stock = indicators.stock_features(conform(stock_bars, STOCK_BARS, keep_extra=False))
    stock = stock.select(F.col("ticker").alias("underlying"), F.col("ts").alias("stock_ts"), F.col("close").alias("close_stock"), *STOCK_FEATURES)
    sources = [Source(stock, "stock_ts", ("close_stock", *STOCK_FEATURES), tolerance_seconds=STOCK_TOLERANCE_SECONDS)]
    if reports is not None:
        sources.append(Source(earnings.feature_points(reports, keys=["underlying"], tie=report_tie), "t", earnings.PIT_STATE))
    if articles is not None:
        states = newswindows.news_states(articles, keys=["underlying"], published="published_utc")
        sources.append(Source(states, "published_utc", newswindows.NEWS_FEATURES, tie=("published_utc", *article_tie)))
    d = asof_many(option_rows.select("underlying", "ts").distinct(), sources, keys=["underlying"], left_time="ts")
    return earnings.feature_columns(d, ts="ts") if reports is not None else d


def feature_store(option_bars: DataFrame, stock_bars: DataFrame, *, trade_minutes: DataFrame | None = None, open_interest: DataFrame | None = None,
                  reports: DataFrame | None = None, report_tie: str | None = None, articles: DataFrame | None = None, article_tie: tuple[str, ...] = (),
                  quotes: tuple[str, ...] = (), horizon_minutes: int = TARGET_MINUTES) -> DataFrame:
    """One row per contract and minute with everything known at that minute, and the
    later value of the same contract as target.

    Returns and targets of a contract are worked out on its narrow rows; what the
    underlying adds is joined last, by equality on (underlying, ts), so no wide
    contract row is ever sorted.  ``quotes`` names quote columns that the bars carry.
    """
    d = conform(option_bars, OPTION_BARS, keep_extra=bool(quotes)).filter(F.col("ts").isNotNull() & F.col("ticker").isNotNull() & F.col("close").isNotNull())
    d = options.parse_symbol(d.drop("underlying"), "ticker").select(
        "ticker", "underlying", "expiry", "option_type", "strike", "ts", "day", F.col("close").alias("close_option"),
        F.col("volume").alias("option_volume"), F.col("transactions").alias("option_transactions"), *quotes)
    known = cut(moments(d, stock_bars, reports=reports, report_tie=report_tie, articles=articles, article_tie=article_tie))
    # Instants of an underlying are few against its contracts' rows: each task builds its share as a table.
    d = d.join(known.select("underlying", "ts", "close_stock").hint("shuffle_hash"), ["underlying", "ts"], "left")
    d = options.economics(d, spot="close_stock", strike="strike", price="close_option", option_type="option_type",
                          dte=options.days_to_expiry(F.col("expiry"), F.col("ts")))
    d = indicators.lag_returns(d, keys=["ticker", "day"], price="close_option", lags=indicators.OPTION_RETURN_LAGS, prefix="option_return_")
    future = d.select("ticker", "ts", F.col("close_option").alias("future_option_close"), F.col("extrinsic").alias("future_extrinsic"))
    d = targets.forward_target(d, future, keys=["ticker"], ts="ts", minutes=horizon_minutes, tolerance_minutes=TARGET_TOLERANCE_MINUTES,
                               take=["future_option_close", "future_extrinsic"], tie=["future_option_close"])
    d = d.withColumns({
        "horizon_minutes": F.lit(horizon_minutes),
        "target_option_return": targets.return_between(F.col("close_option"), F.col("future_option_close")),
        "target_extrinsic_return": targets.return_between(F.col("extrinsic"), F.col("future_extrinsic"), bounded=True),
    }).drop("future_option_close", "future_extrinsic", "target_ts")
    if trade_minutes is not None:
        d = trade_ops.attach_trades(d, trade_minutes, keys=["ticker"]).drop("minute")
    if open_interest is not None:
        d = d.join(open_interest, ["ticker", "day"], "left")
    d = d.join(known.drop("close_stock").hint("shuffle_hash"), ["underlying", "ts"], "left")
    return conform(indicators.event_flags(d), QUOTE_COLUMNS)


def event_store(features: DataFrame) -> DataFrame:
    """Minutes on which something happened, per underlying."""
    return signals.detect_events(features, keys=["underlying", "day"])


_SIDE = ("close_option", "extrinsic", "option_volume", "option_return_5m")


def pair_store(features: DataFrame, rate_series: DataFrame) -> DataFrame:
    """Calls and puts of one strike and expiry per minute, valued and compared."""
    keys = ["underlying", "day", "minute", "expiry", "strike"]
    context = [c for c in ("close_stock", *STOCK_FEATURES) if c in features.columns]
    rows = features.withColumn("minute", F.date_trunc("minute", "ts")).filter(F.col("extrinsic").isNotNull())
    # Volatility and rates read the pairs anew; written, the features behind them are worked out once.
    d = cut(options.pair(rows, keys=keys, option_type="option_type", order=["ts"], measures=list(_SIDE), context=context))
    d = d.withColumn("dte", options.days_to_expiry(F.col("expiry"), F.col("minute")))
    d = options.benchmark_sigma(d, keys=["underlying", "day"], long="realized_vol_60m", short="realized_vol_30m")
    days = rates.rate_for_days(d.select("day").distinct(), rate_series, day="day", date="date", rate="rate", out="risk_free_rate")
    d = d.join(days, "day")
    d = options.valuation(d, spot="close_stock", strike="strike", dte="dte", rate="risk_free_rate", sigma="benchmark_sigma",
                          call_actual="call_extrinsic", put_actual="put_extrinsic")
    d = options.pair_ratios(d, call_return="call_option_return_5m", put_return="put_option_return_5m",
                            volumes={"call_put_volume_ratio": ("call_option_volume", "put_option_volume")}, extrinsics=("call_extrinsic", "put_extrinsic"))
    return d.withColumn("put_call_parity_residual", options.parity_residual(
        F.col("call_close_option"), F.col("put_close_option"), F.col("close_stock"), F.col("strike"), F.col("dte"), F.col("risk_free_rate")))


def pair_targets(pairs: DataFrame) -> DataFrame:
    """Every pair at every intraday horizon with the later values of the same pair."""
    d = targets.intraday_targets(pairs, keys=["underlying", "expiry", "strike"], ts="minute", tie=[],
                                 take={"call_extrinsic": "target_call", "put_extrinsic": "target_put", "close_stock": "target_stock"})
    d = d.withColumns({"future_call_extrinsic_return": targets.return_between(F.col("call_extrinsic"), F.col("target_call")),
                       "future_put_extrinsic_return": targets.return_between(F.col("put_extrinsic"), F.col("target_put")),
                       "future_stock_return": targets.return_between(F.col("close_stock"), F.col("target_stock"))})
    d = d.withColumn("future_stock_up", F.coalesce(F.col("future_stock_return") > 0, F.lit(False)).cast("double"))
    return targets.horizon_columns(d).drop("target_call", "target_put", "target_stock")
