"""Queries over the as-of joins, news windows and time-based targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import newswindows, targets
from tidemark.operators.asof import asof
from tidemark.workloads.adapters import (
    BARS, NEWS, OPTIONS_PX, SESSIONS, TICKS, bars, day_text, news, options_px, r, rounded, sessions, stamp, ticks,
)
from tidemark.workloads.registry import workload

TS = "'%Y-%m-%d %H:%M:%S.%f'"


@workload("asof_backward", sql=f"""
with {TICKS},
l as (select event_id, contract % 5 as g, ts from ticks where event_id % 2 = 0),
q as (select event_id, contract % 5 as g, ts, value from ticks where event_id % 2 = 1),
m as (select l.event_id, l.ts, q.event_id as matched_id, q.value, epoch_us(l.ts) - epoch_us(q.ts) as gap
      from l asof left join q on l.g = q.g and l.ts >= q.ts)
select event_id, strftime(ts, {TS}) as ts, case when gap <= 7200000000 then matched_id end as matched_id,
       case when gap <= 7200000000 then value end as matched_value,
       case when gap <= 7200000000 then round(gap / 1000000.0, 6)::double end as gap_seconds
from m
""")
def asof_backward(t):
    """Each call print with the latest quote of its group within two hours."""
    d = ticks(t).withColumn("g", F.col("contract") % 5)
    left = d.filter(F.col("event_id") % 2 == 0).select("event_id", "g", "ts")
    right = d.filter(F.col("event_id") % 2 == 1).select(
        "g", "ts", F.col("event_id").alias("matched_id"), F.col("value").alias("matched_value"))
    out = asof(left, right, keys=["g"], left_time="ts", right_time="ts", tolerance_seconds=7200,
               tie=["matched_id"], take=["matched_id", "matched_value"], gap="gap_seconds")
    return out.select("event_id", stamp(F.col("ts")).alias("ts"), "matched_id", "matched_value",
                      r("gap_seconds").alias("gap_seconds"))


@workload("asof_forward_target", sql=f"""
with {TICKS},
l as (select event_id, contract, ts, ts + interval 6 hour as wanted, value from ticks),
m as (select l.event_id, l.value, q.event_id as target_id, q.value as future_value, epoch_us(q.ts) - epoch_us(l.wanted) as gap
      from l asof left join ticks q on l.contract = q.contract and l.wanted <= q.ts)
select event_id, case when gap <= 18000000000 then target_id end as target_id,
       case when gap <= 18000000000 then round(future_value / nullif(value, 0) - 1, 6) end as future_return
from m
""")
def asof_forward_target(t):
    """Same-contract price six hours later, the first within five hours after."""
    d = ticks(t).select("event_id", "contract", "ts", "value")
    future = d.select("contract", "ts", "event_id", F.col("event_id").alias("target_id"),
                      F.col("value").alias("future_value"))
    out = targets.forward_target(d, future, keys=["contract"], ts="ts", minutes=360, tolerance_minutes=300,
                                 take=["target_id", "future_value"], tie=["event_id"])
    return out.select("event_id", "target_id", r(targets.return_between(F.col("value"), F.col("future_value")))
                      .alias("future_return"))


@workload("asof_nearest", sql=f"""
with {TICKS},
l as (select event_id, contract, ts from ticks where event_id % 2 = 0),
q as (select event_id, contract, ts, value from ticks where event_id % 2 = 1),
b as (select l.event_id, l.ts, l.contract, q.event_id as bid, q.value as bval, epoch_us(l.ts) - epoch_us(q.ts) as bgap
      from l asof left join q on l.contract = q.contract and l.ts >= q.ts),
f as (select b.*, q.event_id as fid, q.value as fval, epoch_us(q.ts) - epoch_us(b.ts) as fgap
      from b asof left join q on b.contract = q.contract and b.ts <= q.ts),
c as (select event_id, case when bgap is null or fgap < bgap then fid else bid end as matched_id,
             case when bgap is null or fgap < bgap then fval else bval end as matched_value,
             case when bgap is null or fgap < bgap then fgap else bgap end as gap from f)
select event_id, case when gap <= 43200000000 then matched_id end as matched_id,
       case when gap <= 43200000000 then matched_value end as matched_value,
       case when gap <= 43200000000 then round(gap / 1000000.0, 6)::double end as gap_seconds
from c
""")
def asof_nearest(t):
    """Nearest put print to each call print of a contract within twelve hours."""
    d = ticks(t)
    left = d.filter(F.col("event_id") % 2 == 0).select("event_id", "contract", "ts")
    right = d.filter(F.col("event_id") % 2 == 1).select(
        "contract", "ts", F.col("event_id").alias("matched_id"), F.col("value").alias("matched_value"))
    out = asof(left, right, keys=["contract"], left_time="ts", right_time="ts", direction="nearest",
               tolerance_seconds=43200, tie=["matched_id"], take=["matched_id", "matched_value"], gap="gap_seconds")
    return out.select("event_id", "matched_id", "matched_value", r("gap_seconds").alias("gap_seconds"))


@workload("asof_news_latest", sql=f"""
with {BARS}, {NEWS}
select b.ticker, strftime(b.ts, {TS}) as ts, n.doc_id,
       round(n.n_chars % 100 / 100.0::double, 6) as sentiment_latest,
       round((epoch_us(b.ts) - epoch_us(n.published)) / 60000000.0::double, 6) as age_minutes
from bars b asof left join news n on b.ticker = n.ticker and b.ts >= n.published
""")
def asof_news_latest(t):
    """Latest article known at each bar, without a maximum age."""
    articles = news(t).select("ticker", "published", "doc_id", (F.col("n_chars") % 100 / 100.0).alias("sentiment_latest"))
    d = newswindows.attach_latest(bars(t).select("ticker", "ts"), articles, keys=["ticker"], ts="ts",
                                  published="published", take=["doc_id", "sentiment_latest"], tie=["doc_id"],
                                  gap="age_seconds")
    return d.select("ticker", stamp(F.col("ts")).alias("ts"), "doc_id", r("sentiment_latest").alias("sentiment_latest"),
                    r(F.col("age_seconds") / 60).alias("age_minutes"))


@workload("news_rolling_asof", sql=f"""
with {BARS}, {NEWS},
w as (select ticker, published, doc_id,
        avg(n_chars % 100 / 100.0::double) over w60 as s60, count(*) over w60 as c60,
        avg(n_chars % 100 / 100.0::double) over w720 as s720, count(*) over w720 as c720,
        sum((n_chars % 7 = 0)::double) over w720 as bull720
      from news
      window w60 as (partition by ticker order by published range between interval 60 minutes preceding and current row),
             w720 as (partition by ticker order by published range between interval 720 minutes preceding and current row))
select b.ticker, strftime(b.ts, {TS}) as ts, round(s60, 6) as sentiment_60m, c60 as news_count_60m,
       round(s720, 6) as sentiment_720m, c720 as news_count_720m, bull720 as bullish_signal_720m
from bars b asof left join w on b.ticker = w.ticker and b.ts >= w.published
""")
def news_rolling_asof(t):
    """Rolling news statistics as of the last article, carried onto the bars."""
    d = news(t).select("ticker", "published", "doc_id", (F.col("n_chars") % 100 / 100.0).alias("sentiment_score"),
                       (F.col("n_chars") % 7 == 0).cast("double").alias("bullish_signal"))
    d = newswindows.rolling_news(d, keys=["ticker"], published="published", minutes=60,
                                 means={"sentiment": "sentiment_score"}, count="sentiment_score")
    d = newswindows.rolling_news(d, keys=["ticker"], published="published", minutes=720,
                                 means={"sentiment": "sentiment_score"}, sums={"bullish_signal": "bullish_signal"},
                                 count="sentiment_score")
    take = ["sentiment_60m", "news_count_60m", "sentiment_720m", "news_count_720m", "bullish_signal_720m"]
    out = newswindows.attach_latest(bars(t).select("ticker", "ts"), d, keys=["ticker"], ts="ts",
                                    published="published", take=take, tie=["doc_id"])
    return out.select("ticker", stamp(F.col("ts")).alias("ts"), "news_count_60m", "news_count_720m",
                      *rounded(out, ["sentiment_60m", "sentiment_720m", "bullish_signal_720m"]))


_INTRADAY = f"""
{TICKS},
h(code, minutes, tolerance, equivalent) as (values ('M15', 15, 5, 15), ('M30', 30, 5, 30), ('H1', 60, 7, 60),
                                             ('H2', 120, 14, 120), ('H4', 240, 28, 240)),
l as (select event_id, side, ts, value, code, equivalent, tolerance, ts + to_minutes(minutes) as wanted from ticks, h),
m as (select l.*, q.event_id as qid, q.value as qval, epoch_us(q.ts) - epoch_us(l.wanted) as gap
      from l asof left join ticks q on l.side = q.side and l.wanted <= q.ts)
"""


@workload("multi_horizon_intraday", sql=f"""
with {_INTRADAY}
select event_id, code as target_horizon, case when gap <= tolerance * 60000000 then qid end as target_id,
       case when gap <= tolerance * 60000000 then round(qval / nullif(value, 0) - 1, 6) end as future_return,
       round(ln(1 + equivalent), 6) as horizon_log_minutes
from m
""")
def multi_horizon_intraday(t):
    """Each print at five intraday horizons with its tolerance-bound future value."""
    d = ticks(t).select("event_id", "side", "ts", "value")
    out = targets.intraday_targets(d, keys=["side"], ts="ts", tie=["event_id"],
                                   take={"value": "future_value", "event_id": "target_id"})
    out = targets.horizon_columns(out)
    return out.select("event_id", "target_horizon", "target_id",
                      r(targets.return_between(F.col("value"), F.col("future_value"))).alias("future_return"),
                      r("horizon_log_minutes").alias("horizon_log_minutes"))


_LATER = f"""
{SESSIONS},
h(code, n, gap) as (values ('D1', 1, 4), ('D2', 2, 5), ('D3', 3, 7), ('W1', 5, 10)),
idx as (select *, row_number() over (partition by ticker order by day) as i from sessions),
j as (select a.ticker, a.day, h.code, b.day as target_day, a.px, b.px as future_px
      from idx a join h on true join idx b on b.ticker = a.ticker and b.i = a.i + h.n
      where date_diff('day', a.day, b.day) <= h.gap)
"""


@workload("session_target", sql=f"""
with {_LATER}
select ticker, strftime(day, '%Y-%m-%d') as day, code as target_horizon, strftime(target_day, '%Y-%m-%d') as target_day,
       round(future_px / px - 1, 6) as future_return
from j
""")
def session_target(t):
    """Value on the n-th later observed session of a ticker, data gaps excluded."""
    d = sessions(t).select("ticker", "day", "px")
    out = targets.session_targets(d, keys=["ticker"], day="day", take={"px": "future_px"})
    return out.select("ticker", day_text(F.col("day")).alias("day"), "target_horizon",
                      day_text(F.col("target_day")).alias("target_day"),
                      r(targets.return_between(F.col("px"), F.col("future_px"))).alias("future_return"))


@workload("union_horizons", sql=f"""
with {_INTRADAY}, {_LATER.replace('h(code, n, gap)', 'h2(code, n, gap)').replace('join h on', 'join h2 h on')}
select target_horizon, count(*) as rows, count(event_id) as intraday_rows, count(target_day) as session_rows,
       round(avg(future_return), 6) as mean_return
from (select code as target_horizon, event_id, null as target_day, qval / nullif(value, 0) - 1 as future_return
      from m where gap <= tolerance * 60000000
      union all
      select code, null, target_day, future_px / px - 1 from j)
group by target_horizon
""")
def union_horizons(t):
    """Intraday and session targets stacked; columns one side lacks are null."""
    ticks_ = ticks(t).select("event_id", "side", "ts", "value")
    intraday = targets.intraday_targets(ticks_, keys=["side"], ts="ts", tie=["event_id"], take={"value": "future_value"})
    intraday = intraday.filter(F.col("target_ts").isNotNull()).select(
        "target_horizon", "event_id", targets.return_between(F.col("value"), F.col("future_value")).alias("future_return"))
    daily = targets.session_targets(sessions(t).select("ticker", "day", "px"), keys=["ticker"], day="day",
                                    take={"px": "future_px"})
    daily = daily.select("target_horizon", "target_day",
                         targets.return_between(F.col("px"), F.col("future_px")).alias("future_return"))
    return targets.stack_horizons([intraday, daily]).groupBy("target_horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.count("event_id").alias("intraday_rows"),
        F.count("target_day").alias("session_rows"), r(F.avg("future_return")).alias("mean_return"))


@workload("close_anchor", sql=f"""
with {TICKS},
z as (select *, side as s, contract % 10 as g,
        cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) as local_day from ticks),
c as (select *, ((local_day + interval 16 hour) at time zone 'America/New_York') at time zone 'UTC' as close_at from z),
p as (select *, row_number() over (partition by s, g, local_day order by ts desc, event_id desc) as rn
      from c where ts <= close_at)
select side, g, strftime(local_day, '%Y-%m-%d') as local_day, event_id, value, strftime(close_at, {TS}) as ts,
       round((epoch_us(close_at) - epoch_us(ts)) / 60000000.0::double, 6) as staleness_minutes
from p where rn = 1 and epoch_us(close_at) - epoch_us(ts) <= 1800000000
""")
def close_anchor(t):
    """Last pre-close print per contract group and day, at most 30 minutes old."""
    d = ticks(t).select("event_id", "side", (F.col("contract") % 10).alias("g"), "ts", "value")
    out = targets.close_anchor(d, keys=["side", "g"], ts="ts", tie=["event_id"])
    return out.select("side", "g", day_text(F.col("local_day")).alias("local_day"), "event_id", "value",
                      stamp(F.col("ts")).alias("ts"), r("source_staleness_minutes").alias("staleness_minutes"))


@workload("close_rows", sql=f"""
with {TICKS}
select contract, strftime(day, '%Y-%m-%d') as day, event_id, value from (
  select *, row_number() over (partition by contract, day order by ts desc, event_id desc) as rn from ticks)
where rn = 1
""")
def close_rows(t):
    """Last print per contract and day."""
    d = targets.close_rows(ticks(t), keys=["contract", "day"], order=["ts", "event_id"])
    return d.select("contract", day_text(F.col("day")).alias("day"), "event_id", "value")


@workload("daily_median", sql=f"""
with {TICKS}
select contract, strftime(day, '%Y-%m-%d') as day, round(median(value), 6) as value,
       strftime(max(ts), {TS}) as ts
from ticks group by contract, day
""")
def daily_median(t):
    """Median price per contract-day and the last instant it covers."""
    d = targets.daily_median(ticks(t), keys=["contract", "day"], values=["value"], latest="ts")
    return d.select("contract", day_text(F.col("day")).alias("day"), r("value").alias("value"),
                    stamp(F.col("ts")).alias("ts"))


@workload("near_atm", sql=f"""
with {OPTIONS_PX}
select g, l_orderkey, l_linenumber, round(strike, 2) as strike, dte from (
  select o.*, l_orderkey % 500 as g, row_number() over (partition by l_orderkey % 500 order by
     abs(strike / nullif(spot, 0) - 1), dte, l_orderkey, l_linenumber) as rn
  from options_px o where dte > 0) where rn = 1
""")
def near_atm(t):
    """The contract nearest to the money, then nearest to expiry, per group."""
    d = options_px(t).withColumn("g", F.col("l_orderkey") % 500)
    out = targets.near_the_money(d, keys=["g"], strike="strike", spot="spot", dte="dte",
                                 tie=["l_orderkey", "l_linenumber"])
    return out.select("g", "l_orderkey", "l_linenumber", r("strike", 2).alias("strike"), "dte")


@workload("topn_per_group", sql=f"""
with {TICKS}
select side, event_id, value, rank from (
  select side, event_id, value, row_number() over (partition by side order by value desc, event_id) as rank from ticks)
where rank <= 25
""")
def topn_per_group(t):
    """Best 25 rows per horizon; each task keeps only its own best before the shuffle."""
    from tidemark.operators.ranking import top_per_group
    d = top_per_group(ticks(t).select("side", "event_id", "value"), keys=["side"],
                      order=[F.col("value").desc(), F.col("event_id").asc()], n=25, out="rank")
    return d.select("side", "event_id", "value", "rank")


@workload("even_sample", sql=f"""
with {TICKS},
n as (select *, row_number() over (partition by side, day order by ts, event_id) - 1 as i,
      count(*) over (partition by side, day) as c from ticks),
w as (select side, day, cast(trunc(k * (c - 1) / 19.0::double) as bigint) as i
      from (select distinct side, day, c from n), range(20) g(k) where c > 20 group by all)
select n.side, strftime(n.day, '%Y-%m-%d') as day, n.event_id, n.value from n left join w on w.side = n.side and w.day = n.day and w.i = n.i
where c <= 20 or w.i is not null
""")
def even_sample(t):
    """Twenty rows evenly spread over each day (a debugging aid)."""
    from tidemark.operators.ranking import even_sample as sample
    d = sample(ticks(t), keys=["side", "day"], order=["ts", "event_id"], size=20)
    return d.select("side", day_text(F.col("day")).alias("day"), "event_id", "value")


@workload("tail_limit", sql=f"""
with {TICKS}
select event_id, side, value, strftime(ts, {TS}) as ts from ticks
where ts >= timestamp '2024-01-10' order by ts desc, event_id desc limit 500
""")
def tail_limit(t):
    """The last 500 rows after a date, oldest first."""
    d = ticks(t).filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    last = d.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).orderBy("ts", "event_id")
    return last.select("event_id", "side", "value", stamp(F.col("ts")).alias("ts"))


@workload("dedup_keep_last", sql=f"""
with {TICKS}
select contract, side, event_id, value from (
  select *, row_number() over (partition by contract, side order by ts desc, event_id desc) as rn from ticks) where rn = 1
""")
def dedup_keep_last(t):
    """One row per contract and side, the newest kept."""
    d = targets.close_rows(ticks(t), keys=["contract", "side"], order=["ts", "event_id"])
    return d.select("contract", "side", "event_id", "value")
