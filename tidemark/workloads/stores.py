"""Queries that build the whole feature and pair stores from bars, trades, open interest, reports, news and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import targets
from tidemark.operators import trades as trade_ops
from tidemark.plans import stores
from tidemark.session import cut
from tidemark.workloads.adapters import NEWS_TICKERS, day_text, k_of, r, rounded, stamp
from tidemark.workloads.earnings import COMBINED, _combined
from tidemark.workloads.registry import workload

TS = "'%Y-%m-%d %H:%M:%S.%f'"
NAMES = tuple(n.upper() for n in NEWS_TICKERS)


def _clocked(t):
    """events on the market's clock: 390 minutes a session from 14:30 UTC, forty sessions."""
    at = F.lit(1704205800) + F.col("event_id") % 390 * 60 + F.floor(F.col("event_id") / 3900) % 40 * 86_400
    return t.events.select("event_id", F.upper("event_type").alias("u"), "user_id", "value", k_of().alias("k"), F.timestamp_seconds(at).alias("ts"))


def _contract():
    """Symbol of an event's option: side by event, strike and expiry by user."""
    expiry = F.when(F.col("user_id") % 2 == 0, "240216").otherwise("240315")
    side = F.when(F.floor(F.col("event_id") / 2) % 2 == 0, "C").otherwise("P")
    strike = F.lpad(((F.lit(1) + F.floor(F.col("user_id") / 75) % 400) * 10_000).cast("string"), 8, "0")
    return F.concat(F.lit("O:"), "u", expiry, side, strike)


def _market(t):
    """(stock bars, option bars, trade minutes, open interest) of the clocked events."""
    e = cut(_clocked(t).withColumn("contract", _contract()))
    last = lambda c: F.max_by(c, "event_id")
    stock = e.groupBy(F.col("u").alias("ticker"), "ts").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                                                            last("value").alias("close"), F.sum("k").alias("volume")).withColumn("day", F.to_date("ts"))
    bid = F.when(F.col("k") % 10 == 0, F.lit("n/a")).otherwise((F.col("value") / 10).cast("string"))
    option = e.groupBy(F.col("contract").alias("ticker"), "ts").agg(last(F.col("value") / 10).alias("close"), F.sum("k").alias("volume"), F.count(F.lit(1)).cast("double").alias("transactions"),
                                                                    last(bid).alias("bid")).withColumn("day", F.to_date("ts"))
    minutes = trade_ops.trade_minutes(e.select(F.col("contract").alias("ticker"), "ts", (F.col("value") / 10).alias("price"), F.col("k").alias("size")), keys=["ticker"])
    interest = e.filter(F.col("k") > 20).groupBy(F.col("contract").alias("ticker"), F.to_date("ts").alias("day")).agg(F.sum("k").alias("oi_open_interest"))
    return stock, option, minutes, interest


MARKET = """
clocked as (
  select event_id, upper(event_type) as u, user_id, value, cast(json_extract_string(props, '$.k') as double) as k,
         timestamp '2024-01-02 14:30:00' + to_minutes(cast(event_id % 390 as bigint)) + to_days(cast(event_id // 3900 % 40 as integer)) as ts,
         case when user_id % 2 = 0 then date '2024-02-16' else date '2024-03-15' end as expiry,
         case when event_id // 2 % 2 = 0 then 'call' else 'put' end as side, 10.0::double * (1 + user_id // 75 % 400) as strike
  from events),
sbars as (select u, ts, date_trunc('day', ts) as day, max(value) as high, min(value) as low, arg_max(value, event_id) as close, sum(k) as volume from clocked group by u, ts),
slr as (select *, ln(nullif(close, 0)) - lag(ln(nullif(close, 0))) over (partition by u, day order by ts) as lr from sbars),
stock as (
  select u, ts as stock_ts, close as close_stock, close / nullif(lag(close, 5) over w, 0) - 1 as stock_return_5m, close / nullif(lag(close, 30) over w, 0) - 1 as stock_return_30m,
    case when count(lr) over w30 >= 8 then stddev_samp(lr) over w30 * sqrt(98280) end as realized_vol_30m, case when count(lr) over w60 >= 15 then stddev_samp(lr) over w60 * sqrt(98280) end as realized_vol_60m,
    case when count(close) over w10 >= 3 then close / avg(close) over w10 - 1 end as sma_10_ratio,
    case when count(volume) over w30 >= 8 then (volume - avg(volume) over w30) / nullif(stddev_samp(volume) over w30, 0) end as stock_volume_z30, (high - low) / nullif(close, 0) as intraday_range
  from slr window w as (partition by u, day order by ts), w10 as (partition by u, day order by ts rows between 9 preceding and current row),
    w30 as (partition by u, day order by ts rows between 29 preceding and current row), w60 as (partition by u, day order by ts rows between 59 preceding and current row)),
obars as (
  select u, expiry, side, strike, ts, date_trunc('day', ts) as day, arg_max(value / 10, event_id) as px, sum(k) as volume, count(*) as trades, max(k) as largest,
    nullif(arg_max(case when k % 10 = 0 then -1 else value / 10 end, event_id), -1) as bid from clocked group by all),
interest as (select u, expiry, side, strike, date_trunc('day', ts) as day, sum(k) as oi from clocked where k > 20 group by all),
instants as (select distinct u, ts from obars),
known as (
  select i.u, i.ts, s.* exclude (u, stock_ts) from instants i
  left join (select i.u as iu, i.ts as its, s.* from instants i asof join stock s on i.u = s.u and i.ts >= s.stock_ts where epoch_us(i.ts) - epoch_us(s.stock_ts) <= 120000000) s on s.iu = i.u and s.its = i.ts),
opt as (
  select o.*, k.* exclude (u, ts, iu, its), greatest(case when side = 'call' then close_stock - strike else strike - close_stock end, 0) as intrinsic0 from obars o join known k on o.u = k.u and o.ts = k.ts),
opt2 as (
  select *, case when close_stock is not null then intrinsic0 end as intrinsic, case when close_stock is not null then greatest(px - intrinsic0, 0) end as extrinsic,
    px / nullif(lag(px, 1) over w, 0) - 1 as option_return_1m, px / nullif(lag(px, 5) over w, 0) - 1 as option_return_5m
  from opt window w as (partition by u, expiry, side, strike, day order by ts))
"""

_NEWS = f"""
art as (
  select doc_id, ({list(NAMES)})[cast(doc_id % 5 + 1 as integer)] as u, timestamp '2024-01-02 14:30:00' + to_minutes(cast(doc_id % 390 as bigint)) + to_days(cast(doc_id // 390 % 40 as integer)) as p,
    case when doc_id % 7 = 0 then 0 else n_chars % 100 / 100.0::double end as s, (n_chars % 7 = 0)::integer as bull, (doc_id % 3 = 0)::integer as earn from documents),
win as (
  select *, count(*) over w15 as c15, count(*) over w60 as c60, avg(s) over w60 as s60, sum(bull) over w60 as b60, sum(earn) over w60 as e60 from art
  window w15 as (partition by u order by p range between interval 15 minute preceding and current row), w60 as (partition by u order by p range between interval 60 minute preceding and current row)),
wlast as (select *, row_number() over (partition by u, p order by doc_id desc) as k from win),
news as (select i.u as nu, i.ts as nts, n.s, n.c15, n.c60, n.s60, n.b60, n.e60 from instants i asof join (select * from wlast where k = 1) n on i.u = n.u and i.ts >= n.p)
"""


def _articles(t):
    names = F.array(*[F.lit(n) for n in NAMES])
    at = F.lit(1704205800) + F.col("doc_id") % 390 * 60 + F.floor(F.col("doc_id") / 390) % 40 * 86_400
    return t.documents.select(
        "doc_id", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("underlying"), F.timestamp_seconds(at).alias("published_utc"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") % 100 / 100.0).alias("gpu_sentiment_score"), F.lit(9.0).alias("sentiment_score"),
        (F.col("n_chars") % 7 == 0).cast("double").alias("bullish_signal"), F.when(F.col("doc_id") % 3 == 0, "earnings").otherwise("other").alias("event_category"))


def _reports(t):
    """Combined reports of the first five tickers under the names of the underlyings."""
    names = F.array(*[F.lit(n) for n in NAMES])
    d = _combined(t, 1, 5).filter(F.col("ticker").between(1, 5)).withColumns({"liabilities": F.lit(None).cast("double"), "cash_flow": F.lit(None).cast("double")})
    return d.withColumn("underlying", F.element_at(names, F.col("ticker").cast("int"))).drop("ticker")


def _features(t):
    stock, option, minutes, interest = _market(t)
    return stores.feature_store(option, stock, trade_minutes=minutes, open_interest=interest, reports=_reports(t), report_tie="fid",
                                articles=_articles(t), article_tie=("doc_id",), quotes=("bid",))


@workload("feature_store_e2e", sql=f"""
with {COMBINED}, {MARKET}, {_NEWS},
reports as (select *, ({list(NAMES)})[cast(ticker as integer)] as u from comb where ticker between 1 and 5),
sch as (select i.u, i.ts, c.ed, c.fobs, row_number() over (partition by i.u, i.ts, c.event_id order by c.ed, c.fobs) as k from instants i join reports c on c.u = i.u and c.ed is not null and c.fobs <= i.ts),
due as (select u as eu, ts as ets, min(ed) filter (where ed >= ts::date) as nx, max(ed) filter (where ed <= ts::date) as ls from sch where k = 1 group by all),
tgt as (
  select o.u as tu, o.expiry as te, o.side as td, o.strike as tk, o.ts as tts, f.px as fpx, f.extrinsic as fex from opt2 o
  asof join opt2 f on o.u = f.u and o.expiry = f.expiry and o.side = f.side and o.strike = f.strike and o.ts + interval 30 minute <= f.ts where f.ts <= o.ts + interval 35 minute)
select 'O:' || o.u || strftime(o.expiry, '%y%m%d') || upper(left(o.side, 1)) || lpad(cast(cast(o.strike * 1000 as bigint) as varchar), 8, '0') as ticker, o.u as underlying, strftime(o.ts, {TS}) as ts,
  round((epoch_us(o.expiry::timestamp) - epoch_us(o.ts)) / 86400000000.0::double, 6) as dte, round(px, 6) as close_option, round(close_stock, 6) as close_stock, round(intrinsic, 6) as intrinsic,
  round(extrinsic, 6) as extrinsic, round(ln(nullif(close_stock, 0) / o.strike), 6) + 0 as log_moneyness, round(option_return_1m, 6) + 0 as option_return_1m, round(option_return_5m, 6) + 0 as option_return_5m,
  round(stock_return_5m, 6) + 0 as stock_return_5m, round(stock_return_30m, 6) + 0 as stock_return_30m, round(realized_vol_30m, 6) as realized_vol_30m, round(realized_vol_60m, 6) as realized_vol_60m,
  round(sma_10_ratio, 6) + 0 as sma_10_ratio, round(stock_volume_z30, 6) + 0 as stock_volume_z30, round(intraday_range, 6) as intraday_range,
  o.trades as trade_count, o.volume as trade_volume, o.largest as max_trade_size, i.oi as oi_open_interest,
  date_diff('day', o.ts::date, d.nx)::double as days_to_earnings, date_diff('day', d.ls, o.ts::date)::double as days_since_earnings, coalesce(d.nx = o.ts::date, false)::double as earnings_event_today,
  round(n.s, 6) as sentiment_latest, round(n.s60, 6) as sentiment_60m, n.c15 as news_count_15m, n.c60 as news_count_60m, n.b60::double as bullish_signal_60m, n.e60::double as earnings_news_60m,
  coalesce(stock_return_30m >= 0.015, false)::double as event_stock_breakout_up_30m, coalesce(realized_vol_30m >= 0.7, false)::double as event_high_realized_vol,
  coalesce(option_return_5m >= 0.1, false)::double as event_option_jump_up, coalesce(date_diff('day', o.ts::date, d.nx) between 0 and 5, false)::double as event_earnings_within_5d,
  round(o.bid, 6) as bid, cast(null as double) as ask, round(t.fpx / nullif(o.px, 0) - 1, 6) + 0 as target_option_return,
  round(case when t.fex / nullif(o.extrinsic, 0) - 1 < -3 then -3 when t.fex / nullif(o.extrinsic, 0) - 1 > 3 then 3 else t.fex / nullif(o.extrinsic, 0) - 1 end, 6) + 0 as target_extrinsic_return
from opt2 o left join interest i on i.u = o.u and i.expiry = o.expiry and i.side = o.side and i.strike = o.strike and i.day = o.day
  left join due d on d.eu = o.u and d.ets = o.ts left join news n on n.nu = o.u and n.nts = o.ts
  left join tgt t on t.tu = o.u and t.te = o.expiry and t.td = o.side and t.tk = o.strike and t.tts = o.ts
""")
def feature_store_e2e(t):
    """Every option bar with all that was known at its minute and its own later value."""
    d = _features(t)
    plain = ["ticker", "underlying", "trade_count", "trade_volume", "max_trade_size", "oi_open_interest", "days_to_earnings", "days_since_earnings", "earnings_event_today", "news_count_15m",
             "news_count_60m", "bullish_signal_60m", "earnings_news_60m", "event_stock_breakout_up_30m", "event_high_realized_vol", "event_option_jump_up", "event_earnings_within_5d", "ask"]
    return d.select(*plain, stamp(F.col("ts")).alias("ts"), *rounded(d, [
        "dte", "close_option", "close_stock", "intrinsic", "extrinsic", "log_moneyness", "option_return_1m", "option_return_5m", "stock_return_5m", "stock_return_30m", "realized_vol_30m",
        "realized_vol_60m", "sma_10_ratio", "stock_volume_z30", "intraday_range", "sentiment_latest", "sentiment_60m", "bid", "target_option_return", "target_extrinsic_return"]))


_PAIRED = MARKET + """,
rated as (select distinct day, day(day) % 5 / 100.0::double as rate from sbars where day(day) % 2 = 0),
pairs as (
  select c.u, c.day, c.ts as minute, c.expiry, c.strike, c.extrinsic as ce, p.extrinsic as pe, c.px as cp, p.px as pp, c.volume as cv, p.volume as pv, c.option_return_5m as cr, p.option_return_5m as pr,
    c.close_stock, c.realized_vol_30m as v30, c.realized_vol_60m as v60, count(c.realized_vol_60m) over (partition by c.u, c.day) as n60
  from opt2 c join opt2 p on p.u = c.u and p.ts = c.ts and p.expiry = c.expiry and p.strike = c.strike and c.side = 'call' and p.side = 'put' and c.extrinsic is not null and p.extrinsic is not null),
priced as (
  select pairs.*, (epoch_us(expiry::timestamp) - epoch_us(minute)) / 86400000000.0::double as dte, coalesce(r.rate, 0) as rfr,
    case when n60 > 0 then v60 else v30 end as v
  from pairs left join (select p.day, r.rate from (select distinct day from pairs) p asof join rated r on p.day >= r.day) r on r.day = pairs.day)
"""


def _rates(t):
    days = _clocked(t).select(F.to_date("ts").alias("date")).distinct()
    return days.filter(F.dayofmonth("date") % 2 == 0).withColumn("rate", F.dayofmonth("date") % 5 / 100.0)


@workload("pair_store_e2e", sql=f"""
with {_PAIRED}
select u as underlying, strftime(minute, {TS}) as minute, strftime(expiry, '%Y-%m-%d') as expiry, strike, round(ce, 6) as call_extrinsic, round(pe, 6) as put_extrinsic, round(dte, 6) as dte, rfr as risk_free_rate,
  round(case when v is null then 0.35 when v < 0.08 then 0.08 when v > 3 then 3.0 else v end, 6) as benchmark_sigma, round(cr - pr, 6) + 0 as call_put_return_divergence_5m, round((ce + 1e-8) / (pe + 1e-8), 6) as call_put_extrinsic_ratio,
  round((cv + 1) / (pv + 1), 6) as call_put_volume_ratio, round(cp - pp - (close_stock - strike * exp(-rfr * dte / 365)), 6) + 0 as put_call_parity_residual
from priced
""")
def pair_store_e2e(t):
    """Calls and puts of one strike, expiry and minute with volatility, rate, ratios and parity."""
    d = stores.pair_store(_features(t), _rates(t))
    return d.select("underlying", stamp(F.col("minute")).alias("minute"), day_text(F.col("expiry")).alias("expiry"), "strike", "risk_free_rate", *rounded(d, [
        "call_extrinsic", "put_extrinsic", "dte", "benchmark_sigma", "call_put_return_divergence_5m", "call_put_extrinsic_ratio", "call_put_volume_ratio", "put_call_parity_residual"]))


@workload("pair_session_targets", sql=f"""
with {_PAIRED},
days as (select distinct u, day from pairs),
ahead as (select u, day, unnest([struct_pack(h := 'D1', d := lead(day, 1) over w, g := 4), struct_pack(h := 'D2', d := lead(day, 2) over w, g := 5),
  struct_pack(h := 'D3', d := lead(day, 3) over w, g := 7), struct_pack(h := 'W1', d := lead(day, 5) over w, g := 10)]) as s from days window w as (partition by u order by day)),
cal as (select u, day, s.h as h, s.d as target_day from ahead where s.d is not null and date_diff('day', day, s.d) <= s.g),
px as (select *, hour(minute) * 60 + minute(minute) as mm from pairs),
a as (select px.*, cal.h, cal.target_day from px join cal on cal.u = px.u and cal.day = px.day),
b as (select a.*, q.minute as bts, q.ce as bce, q.mm as bmm from a asof left join px q on a.u = q.u and a.expiry = q.expiry and a.strike = q.strike and a.target_day = q.day and a.mm >= q.mm),
f as (select b.*, q.minute as fts, q.ce as fce, q.mm as fmm from b asof left join px q on b.u = q.u and b.expiry = q.expiry and b.strike = q.strike and b.target_day = q.day and b.mm <= q.mm),
c as (select *, bmm is null or fmm - mm < mm - bmm as later, case when bmm is null or fmm - mm < mm - bmm then fmm - mm else mm - bmm end as gap from f)
select u as underlying, strftime(minute, {TS}) as minute, strftime(expiry, '%Y-%m-%d') as expiry, strike, h as target_horizon, strftime(target_day, '%Y-%m-%d') as target_day,
  case when gap <= 10 then strftime(case when later then fts else bts end, {TS}) end as target_ts,
  round(case when gap <= 10 then case when later then fce else bce end end / nullif(ce, 0) - 1, 6) + 0 as future_call_extrinsic_return from c
""")
def pair_session_targets(t):
    """Pairs one, two, three and five observed sessions later at the nearest market minute."""
    pairs = cut(stores.pair_store(_features(t), _rates(t)).select("underlying", "day", "minute", "expiry", "strike", "call_extrinsic"))
    d = targets.session_minute_targets(pairs, keys=["underlying", "expiry", "strike"], calendar_keys=["underlying"], ts="minute", day="day", take={"call_extrinsic": "target_call"}, tie=[])
    d = d.withColumn("future_call_extrinsic_return", targets.return_between(F.col("call_extrinsic"), F.col("target_call")))
    return d.select("underlying", stamp(F.col("minute")).alias("minute"), day_text(F.col("expiry")).alias("expiry"), "strike", "target_horizon", day_text(F.col("target_day")).alias("target_day"),
                    stamp(F.col("target_ts")).alias("target_ts"), r("future_call_extrinsic_return").alias("future_call_extrinsic_return"))
