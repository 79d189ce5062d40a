"""The stores end to end on a small day, and no look-ahead in them."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import stores
from tidemark.session import cut


def day(spark, minutes):
    t = pd.date_range("2025-01-02 14:30", periods=minutes, freq="min")
    price = 100 + np.sin(np.arange(minutes) / 5)
    stock = pd.DataFrame({"ticker": "NVDA", "ts": t, "day": t.date, "open": price, "high": price + .1, "low": price - .1, "close": price, "volume": 100.0})
    option = pd.concat([pd.DataFrame({"ticker": f"O:NVDA260101{s}00100000", "ts": t, "day": t.date, "close": 5 + o + price / 100, "volume": 10.0, "transactions": 1.0})
                        for s, o in (("C", 1), ("P", 0))])
    return spark.createDataFrame(option), spark.createDataFrame(stock)


def test_feature_and_pair_store(spark):
    f = cut(stores.feature_store(*day(spark, 50)))
    rows = f.filter("option_type = 'call'").orderBy("ts").collect()
    assert len(rows) == 50 and rows[0]["target_option_return"] is not None and rows[-1]["target_option_return"] is None
    assert rows[40]["stock_return_30m"] is not None and rows[0]["bid"] is None and rows[0]["strike"] == 100.0
    rates = spark.createDataFrame([("2025-01-01", .04)], "date string, rate double").withColumn("date", F.to_date("date"))
    p = cut(stores.pair_store(f, rates))
    one = p.first()
    assert p.count() == 50 and one["risk_free_rate"] == .04 and one["bs_call_price"] > one["bs_put_price"] > 0
    t = stores.pair_targets(p)
    assert t.count() == 250 and t.filter("target_horizon = 'M15' and future_call_extrinsic_return is not null").count() == 35
    assert stores.event_store(f).count() >= 0


def test_later_bars_do_not_change_earlier_rows(spark):
    columns = ["ticker", "ts", "close_stock", "rsi14", "macd_ratio", "realized_vol_30m", "option_return_5m"]
    short, long = (stores.feature_store(*day(spark, n)).select(*columns).toPandas().sort_values(["ticker", "ts"]) for n in (30, 40))
    long = long[long.ts < pd.Timestamp("2025-01-02 15:00")]
    pd.testing.assert_frame_equal(short.reset_index(drop=True), long.reset_index(drop=True))


def test_pairs_are_written_once(spark):
    """Volatility, days and the result read the written pairs, not the features behind them."""
    at = dt.datetime(2024, 1, 2, 15, 0)
    rows = [("U", at.date(), at, dt.date(2024, 2, 16), 10.0 * n, side, 1.0 + n, 0.5, 3.0, 0.1, 12.0, 0.3, 0.2) for n in (1, 2) for side in ("call", "put")]
    d = spark.createDataFrame(rows, "underlying string, day date, ts timestamp, expiry date, strike double, option_type string, close_option double, extrinsic double, option_volume double, "
                                    "option_return_5m double, close_stock double, realized_vol_30m double, realized_vol_60m double")
    out = stores.pair_store(d, spark.createDataFrame([(at.date(), 0.02)], "date date, rate double"))
    assert "option_type" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["strike"] for r in out.collect()) == [10.0, 20.0]


def test_reports_of_some_tickers_equal_all_reports_filtered(spark, tmp_path):
    from tidemark.workloads.earnings import _combined, _matched
    from tidemark.workloads.registry import Tables
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * n)
    rows = [(n % 70 if n % 11 else None, at(n % 90), n % 13 if n % 17 else None, ("view", "click", "purchase")[n % 3], float(n % 23), '{"k": 3}') for n in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    some = lambda d: sorted(map(str, d.filter("ticker between 1 and 5").drop("revision_number", "fiscal_end").collect()))
    assert some(_combined(t, 1, 5)) == some(_combined(t)) != []
    spark.createDataFrame([(1000 + n, at(n), 50 + n, "view", 1.0, '{"k": 3}') for n in range(40)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert _matched(t, 1, 5)[0].filter("ticker >= 50").count() == 0 < _matched(t)[0].filter("ticker >= 50").count()
