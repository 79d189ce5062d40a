"""Queries over option contracts, pairs, valuation, clocks and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions.pricing import ERF_COEFFICIENTS, ERF_P
from tidemark.operators import options as ops
from tidemark.operators import rates
from tidemark.workloads.adapters import (
    OPTIONS_PX, PAIRS, day_text, options_px, pair_rows, r, rounded, stamp,
)
from tidemark.workloads.registry import workload

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def sql_phi(x: str) -> str:
    """Normal distribution by the same polynomial, as SQL text."""
    z = f"(({x}) / sqrt(2.0::double))"
    t = f"(1.0::double / (1.0::double + {ERF_P}::double * abs({z})))"
    poly = "0.0::double"
    for a in reversed(ERF_COEFFICIENTS):
        poly = f"(({poly} + ({a})::double) * {t})"
    return f"(0.5::double * (1.0::double + sign({z}) * (1.0::double - {poly} * exp(-{z} * {z}))))"


@workload("occ_contract_dim", sql="""
with s as (select 'O:' || upper(p_type) || strftime(o_orderdate, '%y%m%d')
              || case when l_linenumber % 2 = 1 then 'C' else 'P' end
              || lpad(cast(cast(round(p_retailprice * 1000) as bigint) as varchar), 8, '0') as symbol
           from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)
select symbol, count(*) as rows, regexp_extract(symbol, '^O:([A-Z0-9.\\-]+?)(\\d{6})([CP])(\\d{8})$', 1) as underlying,
       strftime(strptime(regexp_extract(symbol, '^O:([A-Z0-9.\\-]+?)(\\d{6})([CP])(\\d{8})$', 2), '%y%m%d'), '%m-%d') as expiry_day,
       case when regexp_extract(symbol, '^O:([A-Z0-9.\\-]+?)(\\d{6})([CP])(\\d{8})$', 3) = 'C' then 'call' else 'put' end as option_type,
       round(cast(regexp_extract(symbol, '^O:([A-Z0-9.\\-]+?)(\\d{6})([CP])(\\d{8})$', 4) as double) / 1000, 3) as strike
from s group by symbol
""")
def occ_contract_dim(t):
    """Distinct option symbols parsed into underlying, expiry, type and strike."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    d = lines.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")) \
             .join(t.part.select("p_partkey", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    symbol = F.concat(F.lit("O:"), F.upper("p_type"), F.date_format("o_orderdate", "yyMMdd"),
                      F.when(F.col("l_linenumber") % 2 == 1, "C").otherwise("P"),
                      F.lpad(F.round(F.col("p_retailprice") * 1000).cast("long").cast("string"), 8, "0"))
    out = ops.contract_dimension(d.select(symbol.alias("symbol")), "symbol")
    return out.select("symbol", "rows", "underlying", F.date_format("expiry", "MM-dd").alias("expiry_day"),
                      "option_type", r("strike", 3).alias("strike"))


@workload("option_economics", sql=f"""
with {OPTIONS_PX},
i as (select *, case when option_type = 'call' then greatest(spot - strike, 0) else greatest(strike - spot, 0) end as intrinsic
      from options_px)
select l_orderkey, l_linenumber, round(avg(intrinsic), 6) as intrinsic, round(avg(greatest(price - intrinsic, 0)), 6) as extrinsic,
       round(avg(ln(nullif(spot, 0) / nullif(strike, 0))), 6) + 0 as log_moneyness, count(*) as rows
from i group by l_orderkey, l_linenumber
""")
def option_economics(t):
    """Intrinsic and extrinsic value and log-moneyness per option row."""
    d = ops.economics(options_px(t), spot="spot", strike="strike", price="price", option_type="option_type")
    return d.groupBy("l_orderkey", "l_linenumber").agg(
        r(F.avg("intrinsic")).alias("intrinsic"), r(F.avg("extrinsic")).alias("extrinsic"),
        r(F.avg("log_moneyness")).alias("log_moneyness"), F.count(F.lit(1)).alias("rows"))


_D = """
d as (select *, dte / 365 as ty, greatest(0.01, least(5.0, sigma)) as v from options_px),
d2 as (select *, (ln(spot / strike) + (rate + 0.5::double * v * v) * ty) / (v * sqrt(ty)) as d1 from d)
"""


@workload("bs_valuation", sql=f"""
with {OPTIONS_PX}, {_D},
v as (select *, spot * {sql_phi('d1')} - strike * exp(-rate * ty) * {sql_phi('d1 - v * sqrt(ty)')} as c,
        strike * exp(-rate * ty) * {sql_phi('-(d1 - v * sqrt(ty))')} - spot * {sql_phi('-d1')} as p from d2)
select l_orderkey, l_linenumber, count(*) as rows, round(avg(c), 5) + 0 as bs_call_price, round(avg(p), 5) + 0 as bs_put_price,
       round(avg(greatest(c - greatest(spot - strike, 0), 0)), 5) as bs_call_extrinsic,
       round(avg(greatest(p - greatest(strike - spot, 0), 0)), 5) as bs_put_extrinsic,
       round(avg(greatest(c - greatest(spot - strike, 0), 0) - price), 5) as call_expectation_gap
from v group by l_orderkey, l_linenumber
""")
def bs_valuation(t):
    """Theoretical call and put value per row; algebra only, no user function."""
    d = ops.valuation(options_px(t), spot="spot", strike="strike", dte="dte", rate="rate", sigma="sigma",
                      call_actual="price")
    return d.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"), *[
        r(F.avg(c), 5).alias(c) for c in ("bs_call_price", "bs_put_price", "bs_call_extrinsic",
                                          "bs_put_extrinsic", "call_expectation_gap")])


def _paired(t):
    return ops.pair(pair_rows(t), keys=["contract", "day"], option_type="option_type", order=["ts", "event_id"],
                    measures=["value", "volume", "ts"])


@workload("pair_join", sql=f"""
with {PAIRS}
select contract, strftime(day, '%Y-%m-%d') as day, call_value, put_value, call_volume, put_volume from pairs
""")
def pair_join(t):
    """Call and put of the same contract-day side by side."""
    d = _paired(t)
    return d.select("contract", day_text(F.col("day")).alias("day"), "call_value", "put_value",
                    "call_volume", "put_volume")


@workload("pair_ratios", sql=f"""
with {PAIRS},
x as (select *, call_value / nullif(lag(call_value) over w, 0) - 1 as c5, put_value / nullif(lag(put_value) over w, 0) - 1 as p5
      from pairs window w as (partition by contract order by day))
select contract, strftime(day, '%Y-%m-%d') as day, round(c5 - p5, 6) as call_put_return_divergence_5m,
  coalesce(c5 > 0 and p5 < 0, false)::integer as call_up_put_down_5m,
  coalesce(c5 < 0 and p5 > 0, false)::integer as call_down_put_up_5m,
  coalesce(c5 > 0 and p5 > 0, false)::integer as both_options_up_5m,
  coalesce(c5 < 0 and p5 < 0, false)::integer as both_options_down_5m,
  round((call_volume + 1) / (put_volume + 1), 6) as call_put_volume_ratio,
  round((call_value + 1e-8) / (put_value + 1e-8), 6) as call_put_extrinsic_ratio,
  round(call_value - put_value - (200 - 190 * exp(-0.03::double * 30 / 365)), 6) as put_call_parity_residual
from x
""")
def pair_ratios(t):
    """Joint moves, volume and time-value ratios and the parity residual of a pair."""
    from pyspark.sql import Window
    from tidemark.schema import ratio
    w = Window.partitionBy("contract").orderBy("day")
    d = _paired(t).withColumns({
        "c5": ratio(F.col("call_value"), F.lag("call_value").over(w)) - 1,
        "p5": ratio(F.col("put_value"), F.lag("put_value").over(w)) - 1})
    d = ops.pair_ratios(d, call_return="c5", put_return="p5", extrinsics=("call_value", "put_value"),
                        volumes={"call_put_volume_ratio": ("call_volume", "put_volume")})
    d = d.withColumn("put_call_parity_residual", ops.parity_residual(
        F.col("call_value"), F.col("put_value"), F.lit(200.0), F.lit(190.0), F.lit(30.0), F.lit(0.03)))
    return d.select("contract", day_text(F.col("day")).alias("day"), "call_up_put_down_5m", "call_down_put_up_5m",
                    "both_options_up_5m", "both_options_down_5m",
                    *rounded(d, ["call_put_return_divergence_5m", "call_put_volume_ratio",
                                 "call_put_extrinsic_ratio", "put_call_parity_residual"]))


@workload("chain_enrich", sql=f"""
with {OPTIONS_PX},
c as (select *, case when l_linenumber % 3 = 0 then null else price * 0.98::double end as bid,
             case when l_linenumber % 3 = 0 then null else price * 1.02::double end as ask,
             case when l_linenumber % 6 = 0 then null else price * 1.01::double end as last from options_px),
m as (select *, coalesce((bid + ask) / 2, last, price) as mid,
             case when option_type = 'call' then greatest(spot - strike, 0) else greatest(strike - spot, 0) end as intrinsic from c)
select l_orderkey, l_linenumber, count(*) as rows, round(avg(mid), 6) as mid, round(avg(intrinsic), 6) as intrinsic,
       round(avg(greatest(mid - intrinsic, 0)), 6) as time_value, round(avg((ask - bid) / nullif(mid, 0) * 100), 6) as spread_pct
from m group by l_orderkey, l_linenumber
""")
def chain_enrich(t):
    """Mid price with fall-backs, intrinsic, time value and relative spread."""
    line = F.col("l_linenumber")
    d = options_px(t).withColumns({
        "bid": F.when(line % 3 != 0, F.col("price") * 0.98), "ask": F.when(line % 3 != 0, F.col("price") * 1.02),
        "last": F.when(line % 6 != 0, F.col("price") * 1.01)})
    d = ops.enrich_chain(d, spot="spot", strike="strike", option_type="option_type", bid="bid", ask="ask",
                         last="last", close="price")
    return d.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"), *[
        r(F.avg(c)).alias(c) for c in ("mid", "intrinsic", "time_value", "spread_pct")])


_RATES = """
obs as (select date_trunc('day', o_orderdate) as date, avg(o_totalprice) / 100000 as raw
        from orders group by 1),
rates as (select date, case when day(date) % 4 = 0 then null else raw end as rate from obs),
filled as (select date, last_value(rate ignore nulls) over (order by date rows unbounded preceding) / 100 as rate from rates)
"""


def _rates(t):
    d = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / 100000).alias("raw"))
    return d.select("date", F.when(F.dayofmonth("date") % 4 != 0, F.col("raw")).alias("rate"))


@workload("rate_ffill", sql=f"""
with {_RATES} select strftime(date, '%Y-%m-%d') as date, round(rate, 12) as rate from filled
""")
def rate_ffill(t):
    """Daily rate with gaps filled forward, as a fraction."""
    d = rates.fill_forward(_rates(t), date="date", rate="rate")
    return d.select(day_text(F.col("date")).alias("date"), r("rate", 12).alias("rate"))


@workload("rate_asof", sql=f"""
with {_RATES}, known as (select * from filled where rate is not null),
days as (select date_trunc('day', l_shipdate) as day, count(*) as rows from lineitem group by 1)
select strftime(day, '%Y-%m-%d') as day, rows, round(coalesce(known.rate, 0), 12) as risk_free_rate
from days asof left join known on days.day >= known.date
""")
def rate_asof(t):
    """Last known rate on or before each session; zero before the first."""
    days = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    d = rates.rate_for_days(days, rates.fill_forward(_rates(t), date="date", rate="rate"), day="day", date="date",
                            rate="rate", out="risk_free_rate")
    return d.select(day_text(F.col("day")).alias("day"), "rows", r("risk_free_rate", 12).alias("risk_free_rate"))


@workload("market_close_dst", sql=f"""
with d as (select date_trunc('day', o_orderdate) as day, count(*) as orders from orders group by 1)
select strftime(day, '%Y-%m-%d') as day, orders,
       strftime(((day + interval 16 hour) at time zone 'America/New_York') at time zone 'UTC', {TS}) as close_utc
from d
""")
def market_close_dst(t):
    """UTC instant of the New York close for every order date."""
    d = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return d.select(day_text(F.col("day")).alias("day"), "orders", stamp(clock.market_close(F.col("day"))).alias("close_utc"))


@workload("ts_unit_infer", sql=f"""
with c as (select u.kind, event_id, case kind when 's' then epoch_us(ts) // 1000000 when 'ms' then epoch_us(ts) // 1000
                                       else epoch_us(ts) * 1000 end as raw
           from events, (values ('s'), ('ms'), ('ns')) u(kind)),
m as (select kind, case when median(raw) > 1e16 then 'ns' when median(raw) > 1e11 then 'ms' else 's' end as unit from c group by kind)
select kind, unit, count(*) as rows, strftime(min(t), {TS}) as first_ts, strftime(max(t), {TS}) as last_ts
from (select c.kind, m.unit, make_timestamp(case unit when 'ns' then raw // 1000 when 'ms' then raw * 1000 else raw * 1000000 end) as t
      from c join m using (kind)) group by kind, unit
""")
def ts_unit_infer(t):
    """Epoch columns of three feeds, their unit judged by the median magnitude."""
    us = F.unix_micros("ts")
    feeds = F.array(F.struct(F.lit("s").alias("kind"), F.floor(us / 1000000).cast("long").alias("raw")),
                    F.struct(F.lit("ms").alias("kind"), F.floor(us / 1000).cast("long").alias("raw")),
                    F.struct(F.lit("ns").alias("kind"), (us * 1000).alias("raw")))
    d = t.events.select("event_id", F.inline(feeds))
    d = rates.infer_timestamps(d, keys=["kind"], raw="raw", out="t")
    return d.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("rows"), stamp(F.min("t")).alias("first_ts"),
                                         stamp(F.max("t")).alias("last_ts"))
