"""Queries over costs, decisions, risk limits, paper trades, monitoring and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audits, regimes, risk, splits
from tidemark.operators import metrics as m
from tidemark.workloads.adapters import SCORES, SESSIONS, day_text, r, research_scores, rounded, sessions
from tidemark.session import cut
from tidemark.workloads.metrics import _CAL, _FOLDS
from tidemark.workloads.registry import workload


def candidates(t):
    """supplier x part as trade candidates with their portfolio state."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(
        (F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 1000).alias("option_price"),
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.sum("l_quantity").cast("long").alias("qty"))
    part, supplier = F.col("part"), F.col("supplier")
    return g.select(
        "supplier", "part", "option_price", "disc", "tax",
        (F.col("disc") * 6).alias("expected_return"), (F.col("tax") / 2 + 0.01).alias("expected_cost_return"),
        (F.col("tax") * 6).alias("uncertainty"), F.lit(100).cast("long").alias("contract_multiplier"),
        F.when(part % 9 != 0, F.col("disc") + 0.0213).alias("relative_spread"),
        (F.col("qty") * 3).alias("open_interest"), F.when(part % 11 != 0, F.col("qty")).alias("daily_volume"),
        (supplier % 22).cast("double").alias("data_age_minutes"),
        (part % 13 != 0).alias("feature_complete"), (part % 17 != 0).alias("leakage_valid"), (part % 19 != 0).alias("model_valid"),
        (supplier % 23 != 0).alias("system_healthy"), (part % 29 == 0).alias("drift_alert"),
        F.lit(100000.0).alias("equity"), ((supplier % 31) * 1000).cast("double").alias("gross_exposure"),
        ((part % 8) * 1000).cast("double").alias("ticker_exposure"), ((part % 19) * 1000).cast("double").alias("sector_exposure"),
        (-(part % 210) * 10).cast("double").alias("daily_pnl"), ((supplier % 13) / 100.0).alias("drawdown_pct"),
        ((part % 89) / 100.0).alias("correlated_exposure_pct"))


CAND = """
g as (select l_suppkey as supplier, l_partkey as part, avg(l_extendedprice / l_quantity) / 1000 as option_price, avg(l_discount) as disc,
        avg(l_tax) as tax, cast(sum(l_quantity) as bigint) as qty from lineitem group by all),
cand as (select supplier, part, option_price, disc, tax, disc * 6 as expected_return, tax / 2 + 0.01::double as expected_cost_return, tax * 6 as uncertainty,
  case when part % 9 <> 0 then disc + 0.0213::double end as relative_spread, qty * 3 as open_interest, case when part % 11 <> 0 then qty end as daily_volume,
  (supplier % 22)::double as age, (supplier % 31) * 1000.0::double as gross, (part % 8) * 1000.0::double as tick, (part % 19) * 1000.0::double as sect,
  -(part % 210) * 10.0::double as pnl, (supplier % 13) / 100.0::double as ddn, (part % 89) / 100.0::double as corr from g)
"""

_DECIDED = CAND + """,
e as (select *, expected_return - greatest(0, expected_cost_return) as edge, 0.005::double + greatest(0, uncertainty) * 0.25::double as required,
  list_filter([case when supplier % 23 = 0 then 'systeemfout' end, case when part % 13 = 0 then 'onvolledige_features' end,
    case when part % 17 = 0 then 'leakage_audit_mislukt' end, case when part % 19 = 0 then 'model_ongeldig' end,
    case when part % 29 = 0 then 'model_of_feature_drift' end, case when pnl <= -2000 then 'maximaal_dagverlies' end,
    case when ddn >= 0.12::double then 'maximale_drawdown' end, case when age > 20 then 'verouderde_data' end], lambda x: x is not null) as kill from cand),
s as (select *, list_sort(list_distinct(list_concat(kill, list_filter([case when relative_spread is null then 'spread_onbekend' end,
    case when relative_spread > 0.12::double then 'spread_te_hoog' end, case when open_interest < 50 then 'onvoldoende_open_interest' end,
    case when daily_volume is null or daily_volume < 20 then 'onvoldoende_liquiditeit' end, case when uncertainty > 0.35::double then 'modelonzekerheid_te_hoog' end,
    case when edge <= required then 'edge_niet_boven_kosten_en_marge' end, case when gross >= 30000 then 'maximale_portefeuille_exposure' end,
    case when tick >= 100000 * 0.07::double then 'tickerconcentratie' end, case when sect >= 18000 then 'sectorconcentratie' end,
    case when corr >= 0.85::double then 'correlatieconcentratie' end], lambda x: x is not null)))) as alls,
  cast(floor(greatest(0, least(30000 - gross, 100000 * 0.07::double - tick, 18000 - sect, 500)) / (greatest(0.01::double, option_price) * 100)) as bigint) as fit from e),
decided as (select *, len(alls) = 0 and fit >= 1 as allowed, case when len(alls) = 0 then fit else 0 end as contracts, len(kill) > 0 as kill_switch,
  case when len(alls) = 0 and fit < 1 then 'positie_binnen_risicolimieten_te_klein' else array_to_string(alls, '|') end as reasons from s)
"""


@workload("risk_decision", sql=f"""
with {_DECIDED}
select supplier, part, case when allowed then 'TRADE' else 'NO_TRADE' end as decision, contracts, kill_switch, reasons,
       round(edge, 6) as expected_edge_return, round(required, 6) as required_edge_return from decided
""")
def risk_decision(t):
    """Decision, size and reasons for every candidate."""
    d = risk.evaluate_risk(candidates(t))
    return d.select("supplier", "part", "decision", "contracts", "kill_switch", F.array_join("reasons", "|").alias("reasons"),
                    *rounded(d, ["expected_edge_return", "required_edge_return"]))


_SETTLED = _DECIDED + """,
st as (select d.supplier, d.part, d.contracts, d.edge, (p_retailprice / 487 - option_price) * contracts * 100 as gross_pnl,
   (p_retailprice / 487 - option_price) * contracts * 100 - p_size / 10.0::double as net_pnl,
   (p_retailprice / 487 - option_price) / option_price - p_size / 10.0::double / greatest(option_price * contracts * 100, 1e-12) as ret
   from decided d join part on p_partkey = d.part where allowed and option_price > 0)
"""


def _settled(t):
    exits = t.part.select(F.col("p_partkey").alias("part"), (F.col("p_retailprice") / 487).alias("exit_price"),
                          (F.col("p_size") / 10.0).alias("actual_cost"))
    return risk.settle(risk.evaluate_risk(candidates(t)), exits, on=["part"])


@workload("paper_settle", sql=f"""
with {_SETTLED}
select supplier, part, contracts, round(gross_pnl, 4) as gross_pnl, round(net_pnl, 4) as net_pnl, round(ret, 6) as actual_net_return,
       net_pnl > 0 as positive_outcome from st
""")
def paper_settle(t):
    """Open signals settled at their exit price; rejected ones never are."""
    d = _settled(t)
    return d.select("supplier", "part", "contracts", "positive_outcome", r("gross_pnl", 4).alias("gross_pnl"),
                    r("net_pnl", 4).alias("net_pnl"), r("actual_net_return").alias("actual_net_return"))


@workload("paper_status", sql=f"""
with {_SETTLED}
select supplier, count(*) as settled_trades, round(sum(net_pnl), 4) as net_pnl, round(avg(net_pnl), 5) as expected_value_per_trade,
  round(avg((net_pnl > 0)::integer), 6) as win_rate,
  round(coalesce(sum(net_pnl) filter (net_pnl > 0), 0) / nullif(abs(sum(net_pnl) filter (net_pnl <= 0)), 0), 6) as profit_factor,
  round(avg(ret), 6) as mean_net_return from st group by supplier
""")
def paper_status(t):
    """Profit, win rate and profit factor per supplier book."""
    d = risk.paper_status(_settled(t), keys=["supplier"])
    return d.select("supplier", "settled_trades", r("net_pnl", 4).alias("net_pnl"),
                    r("expected_value_per_trade", 5).alias("expected_value_per_trade"),
                    *rounded(d, ["win_rate", "profit_factor", "mean_net_return"]))


@workload("cost_model", sql=f"""
with {CAND},
q as (select *, case when part % 5 <> 0 then option_price * (1 - disc / 2) end as bid, case when part % 5 <> 0 then option_price * (1 + tax / 2) end as ask,
        case when part % 7 <> 0 then option_price end as fb from cand)
select supplier, part, round(case when bid is not null then greatest(ask - bid, 0.01::double) / option_price else 0.08 end
     + coalesce(1.36::double / (option_price * 100), 0.02) + 0.0018, 6) as expected_cost_return,
     not (bid is not null and fb is not null and part % 2 = 0) as costs_provisional from q
""")
def cost_model(t):
    """Round-trip cost per candidate and whether it rests on full quotes."""
    part, px = F.col("part"), F.col("option_price")
    d = candidates(t).withColumns({
        "call_close_option": px, "call_bid": F.when(part % 5 != 0, px * (1 - F.col("disc") / 2)),
        "call_ask": F.when(part % 5 != 0, px * (1 + F.col("tax") / 2)), "future_call_bid": F.when(part % 7 != 0, px),
        "future_call_ask": F.when(part % 7 != 0, px), "call_bid_size": F.when(part % 2 == 0, F.lit(10.0)),
        "call_ask_size": F.when(part % 2 == 0, F.lit(10.0))})
    d = risk.roundtrip_costs(d, "call")
    return d.select("supplier", "part", r("expected_cost_return").alias("expected_cost_return"), "costs_provisional")


@workload("trade_decision", sql=f"""
with {SCORES}
select ticker, strftime(day, '%Y-%m-%d') as day, round(expected_return - cost, 6) + 0 as net_expected_edge,
  case when expected_return > cost + 0.005::double + f_tax / 4 * 0.25::double then 'TRADE' else 'NO_TRADE' end as decision,
  round(case when expected_return > cost + 0.005::double + f_tax / 4 * 0.25::double then actual_return - cost else 0 end, 6) + 0 as actual_net_return from scores
""")
def trade_decision(t):
    """TRADE or NO_TRADE per row and the net return it earned."""
    d = research_scores(t).withColumn("sigma", F.col("f_tax") / 4)
    d = risk.decide(d, predicted="expected_return", cost="cost", uncertainty="sigma", actual="actual_return")
    return d.select("ticker", day_text(F.col("day")).alias("day"), "decision",
                    r("net_expected_edge").alias("net_expected_edge"), r("actual_net_return").alias("actual_net_return"))


def _records(t):
    return candidates(t).select(
        "supplier", "part", F.floor(F.col("part") / 256).alias("block"), (F.col("disc") - 0.04).alias("expected_net_return"),
        (F.col("tax") - 0.045 + (F.col("part") % 7 - 3) / 100.0).alias("actual_net_return"),
        (F.col("disc") * 8).alias("probability_positive"), (F.col("part") % 3 == 0).cast("double").alias("positive_outcome"),
        "expected_cost_return", (F.col("disc") / 4 + 0.003).alias("actual_cost_return"), "relative_spread",
        F.col("open_interest").cast("double").alias("open_interest"))


@workload("monitor", sql=f"""
with {CAND},
rec as (select supplier, part, disc - 0.04::double as e, tax - 0.045::double + (part % 7 - 3) / 100.0::double as a, greatest(0, least(1, disc * 8)) as p,
  (part % 3 = 0)::integer as y, expected_cost_return as qc, disc / 4 + 0.003::double as pc, relative_spread as sp, open_interest as oi from cand),
cv as (select supplier, part, exp(sum(ln(1 + greatest(a, -0.999))) over (partition by supplier order by part rows unbounded preceding)) as c from rec),
pk as (select *, max(c) over (partition by supplier order by part rows unbounded preceding) as k from cv),
dd as (select supplier, max((k - c) / greatest(k, 1e-12)) as dd from pk group by supplier),
ag as (select supplier, count(*) as rows, avg(e) as em, avg(a) as am, avg(a - e) as er, avg(abs(a - e)) as mae, avg(a) / stddev_samp(a) * sqrt(252) as sharpe,
  avg(((e > 0) = (a > 0))::integer) as da, avg((p - y) ** 2) as brier, abs(avg(p) - avg(y)) as gap, sum(pc) / greatest(abs(sum(qc)), 1e-12) as cr,
  avg(sp) as ms, quantile_cont(sp, 0.95) as p95, median(oi) as moi, count(sp) as ns from rec group by supplier)
select ag.supplier, rows, round(em, 6) as expected_pnl_mean, round(am, 6) as actual_pnl_mean, round(er, 6) as pnl_forecast_error_mean,
  round(mae, 6) as pnl_forecast_mae, round(sharpe, 6) as actual_sharpe, round(da, 6) as direction_accuracy, round(brier, 6) as brier,
  round(gap, 6) as calibration_gap, round(cr, 6) as execution_cost_ratio, round(ms, 9) as mean_relative_spread, round(p95, 6) as p95_relative_spread,
  round(moi, 6) as median_open_interest, round(dd, 6) as maximum_drawdown,
  array_to_string(list_sort(list_filter([case when rows >= 30 and am < 0 then 'negatieve_live_ev' end, case when dd > 0.12 then 'drawdown_limiet' end,
    case when rows >= 50 and gap > 0.12 then 'slechte_kalibratie' end, case when rows >= 20 and cr > 1.5 then 'execution_kosten_afwijking' end,
    case when ns >= 20 and p95 > 0.15 then 'uitzonderlijke_spreads' end, case when moi < 30 then 'liquiditeit_verslechterd' end], lambda x: x is not null)), '|') as triggers
from ag join dd on dd.supplier = ag.supplier
""")
def monitor(t):
    """Expected against realised results per book with triggers."""
    d = risk.monitor(cut(_records(t)), keys=["supplier"], order=["part"], bucket="block")
    # spreads have two decimals, so their means can be exact ties at six digits
    return d.select("supplier", "rows", F.array_join("triggers", "|").alias("triggers"), r("mean_relative_spread", 9).alias("mean_relative_spread"), *rounded(d, [
        "expected_pnl_mean", "actual_pnl_mean", "pnl_forecast_error_mean", "pnl_forecast_mae", "actual_sharpe", "direction_accuracy",
        "brier", "calibration_gap", "execution_cost_ratio", "p95_relative_spread", "median_open_interest",
        "maximum_drawdown"]))


_EDGE = CAND + """,
x as (select *, option_price as cn, option_price * 0.9::double as pn, disc * 4 - 0.1537::double as cr, tax * 5 - 0.1237::double as prr,
  0.3137::double + disc * 5 as pc, 0.3537::double + tax * 5 as pp, (part % 7 + 1)::double as w1, (part % 5 + 1)::double as w2, (supplier % 6 + 1)::double as w3,
  (supplier % 4 + 1)::double as w4, part % 160 as cen, part % 130 as pen from cand),
y as (select *, w1 / (w1 + w2 + w3 + w4) as s1, w2 / (w1 + w2 + w3 + w4) as s2, w3 / (w1 + w2 + w3 + w4) as s3, w4 / (w1 + w2 + w3 + w4) as s4,
  (cn * (1 + cr) - cn) / cn as ce, (pn * (1 + prr) - pn) / pn as pe from x),
z as (select *, greatest(ce, 0) * pc as cs, greatest(pe, 0) * pp as ps, greatest(pc, pp) > 0.5 and (case when pc >= pp then ce else pe end) > 0 as pcase from y)
"""


@workload("edge_signal", sql=f"""
with {_EDGE}
select supplier, part, round(ce * cn * 100, 4) + 0 as call_edge_per_contract, round(pe, 6) + 0 as put_gross_edge_pct,
  case when pc >= pp then 'CALL' else 'PUT' end as best_profit_side, pcase as paper_profit_case,
  pcase and (case when pc >= pp then cen else pen end) >= 50 and (case when pc >= pp then pc - 0.02::double else pp - 0.02::double end) > 0.5 as paper_profit_empirically_supported,
  pcase and (case when pc >= pp then cen else pen end) >= 100 and (case when pc >= pp then pc - 0.1::double else pp - 0.1::double end) > 0.5 as paper_profit_strict_ci_supported,
  case greatest(s1, s2, s3, s4) when s1 then 'call_up_put_down' when s2 then 'call_down_put_up' when s3 then 'both_up' else 'both_down' end as most_likely_state,
  round(greatest(s1, s2, s3, s4), 6) as most_likely_state_probability,
  case when ce > 0 and pc >= 0.55 and cs >= ps then 'CALL_EDGE' when pe > 0 and pp >= 0.55 and ps > cs then 'PUT_EDGE' else 'NO_EDGE' end as paper_signal,
  round(case when ce > 0 and pc >= 0.55 and cs >= ps then cs when pe > 0 and pp >= 0.55 and ps > cs then ps else greatest(cs, ps, 0) end, 6) as paper_opportunity_score
from z
""")
def edge_signal(t):
    """Expected edges, best side, support flags and the paper signal per candidate."""
    part, supplier = F.col("part"), F.col("supplier")
    d = candidates(t).withColumns({
        "call_extrinsic": F.col("option_price"), "put_extrinsic": F.col("option_price") * 0.9,
        "call_return": F.col("disc") * 4 - 0.1537, "put_return": F.col("tax") * 5 - 0.1237,
        "prob_call_gross_profit": 0.3137 + F.col("disc") * 5, "prob_put_gross_profit": 0.3537 + F.col("tax") * 5,
        "_1": (part % 7 + 1).cast("double"), "_2": (part % 5 + 1).cast("double"),
        "_3": (supplier % 6 + 1).cast("double"), "_4": (supplier % 4 + 1).cast("double")})
    total = F.col("_1") + F.col("_2") + F.col("_3") + F.col("_4")
    d = d.withColumns({f"prob_{s}": F.col(f"_{i + 1}") / total for i, s in enumerate(risk.STATE_ORDER)})
    for side, n, p in (("call", 160, "prob_call_gross_profit"), ("put", 130, "prob_put_gross_profit")):
        d = d.withColumns({f"{side}_evidence_n": part % n, f"{side}_evidence_hit_rate": F.col(p) - 0.02,
                           f"{side}_evidence_ci_low": F.col(p) - 0.1})
    d = risk.edge_signals(d, threshold=0.55)
    return d.select("supplier", "part", "best_profit_side", "paper_profit_case", "paper_profit_empirically_supported",
                    "paper_profit_strict_ci_supported", "most_likely_state", "paper_signal",
                    r("call_edge_per_contract", 4).alias("call_edge_per_contract"),
                    *rounded(d, ["put_gross_edge_pct", "most_likely_state_probability", "paper_opportunity_score"]))


@workload("regimes", sql=f"""
with {SESSIONS},
x as (select *, (['NVDA','GOOGL','JPM','XOM','OTHER'])[ticker + 1] as symbol, abs(past_return) as vol from sessions),
y as (select *, case when count(vol) over w >= 30 then quantile_cont(vol, 0.33) over w end as lo, case when count(vol) over w >= 30 then quantile_cont(vol, 0.67) over w end as hi
  from x window w as (partition by ticker order by day rows between unbounded preceding and 1 preceding))
select symbol, strftime(day, '%Y-%m-%d') as day, case symbol when 'NVDA' then 'Technology' when 'GOOGL' then 'Communication' when 'JPM' then 'Financials' when 'XOM' then 'Energy' else 'Unknown' end as sector,
  case when past_return >= 0.01 then 'bull' when past_return <= -0.01 then 'bear' else 'sideways' end as market_regime,
  case when vol <= coalesce(lo, 0.3) then 'low' when vol >= coalesce(hi, 0.7) then 'high' else 'medium' end as volatility_regime,
  case when day(day) = 15 then 'earnings' when f_count % 4 > 0 then 'news' else 'none' end as event_type from y
""")
def regimes_(t):
    """Sector, trend, volatility tercile against the ticker's own past, event type."""
    symbol = F.element_at(F.array(*[F.lit(x) for x in ("NVDA", "GOOGL", "JPM", "XOM", "OTHER")]), (F.col("ticker") + 1).cast("int"))
    d = sessions(t).withColumns({"symbol": symbol, "vol": F.abs("past_return"), "due": (F.dayofmonth("day") == 15).cast("double"),
                                 "articles": F.col("f_count") % 4})
    d = regimes.prior_terciles(d, keys=["ticker"], order=["day"], value="vol")
    d = regimes.assign(d, ticker="symbol", trend="past_return", volatility="vol", earnings_today="due", news_count="articles")
    return d.select("symbol", day_text(F.col("day")).alias("day"), "sector", "market_regime", "volatility_regime", "event_type")


@workload("regimes_all_tickers", sql=f"""
with {SESSIONS},
x as (select *, case when ticker = 3 and day(day) % 4 = 0 then null else abs(past_return) end as vol from sessions),
y as (select *, case when count(vol) over w >= 30 then quantile_cont(vol, 0.33) over w end as lo, case when count(vol) over w >= 30 then quantile_cont(vol, 0.67) over w end as hi
  from x window w as (order by day, ticker rows between unbounded preceding and 1 preceding))
select ticker, strftime(day, '%Y-%m-%d') as day, round(lo, 9) as low_mark, round(hi, 9) as high_mark,
  case when vol <= coalesce(lo, 0.3) then 'low' when vol >= coalesce(hi, 0.7) then 'high' else 'medium' end as volatility_regime from y
""")
def regimes_all_tickers(t):
    """Volatility terciles against the past of all tickers together."""
    vol = F.when(~((F.col("ticker") == 3) & (F.dayofmonth("day") % 4 == 0)), F.abs("past_return"))
    d = regimes.prior_terciles_over_all(sessions(t).withColumns({"vol": vol, "zero": F.lit(0.0)}), bucket="day", order=["day", "ticker"], value="vol", least_block=64)
    d = d.withColumns({"low_mark": F.col("_low"), "high_mark": F.col("_high")})
    d = regimes.assign(d, ticker="ticker", trend="past_return", volatility="vol", earnings_today="zero", news_count="zero")
    return d.select("ticker", day_text(F.col("day")).alias("day"), r("low_mark", 9).alias("low_mark"), r("high_mark", 9).alias("high_mark"), "volatility_regime")


_LEAK_COLUMNS = ("px", "f_discount", "f_tax", "f_quantity", "f_count", "future_return", "past_return")
_LEAK_LONG = " union all ".join(f"select '{c}' as \"column\", cast({c} as double) as v from sessions" for c in _LEAK_COLUMNS) \
    + " union all select 'constant', 1.0::double from sessions"


@workload("leak_columns", sql=f"""
with {SESSIONS},
c as ({_LEAK_LONG})
select "column", "column" like '%future_%' as forbidden, count(v) as non_null, coalesce(min(v) < max(v), false) as varies,
       not ("column" like '%future_%') and count(v) >= greatest(30, floor(count(*) * 0.2)) and coalesce(min(v) < max(v), false) as usable
from c group by "column"
""")
def leak_columns(t):
    """Which columns may feed a model: names, coverage and variation."""
    d = sessions(t).withColumn("constant", F.lit(1.0))
    return audits.audit_columns(d, [*_LEAK_COLUMNS, "constant"])


@workload("leak_pit_audit", sql="""
with x as (select l_suppkey as ticker, case when l_orderkey % 101 = 0 then null else l_shipdate end as as_of,
   o_orderdate + to_days(cast(l_linenumber * 20 as integer)) as available, l_shipdate + to_days(cast(l_linenumber - 1 as integer)) as target
   from lineitem join orders on o_orderkey = l_orderkey)
select ticker, count(*) as rows, count(*) filter (as_of is null) as missing_as_of, count(*) filter (available > as_of) as future_available,
  count(*) filter (target is not null and as_of is not null) as targets_checked, count(*) filter (target <= as_of) as non_future_targets from x group by ticker
""")
def leak_pit_audit(t):
    """Counts of rows that use something not yet known, per ticker."""
    d = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c, n: F.timestamp_seconds(F.unix_seconds(c) + n * 86400)
    d = d.select(F.col("l_suppkey").alias("ticker"), F.when(F.col("l_orderkey") % 101 != 0, F.col("l_shipdate")).alias("as_of"),
                 day("o_orderdate", F.col("l_linenumber") * 20).alias("available"),
                 day("l_shipdate", F.col("l_linenumber") - 1).alias("target"))
    return audits.audit_point_in_time(d, as_of="as_of", available=["available"], target="target", keys=["ticker"])


@workload("leak_purge_audit", sql=f"""
with {SESSIONS}, {_CAL}, {_FOLDS},
x as (select fold, role, s.day, s.day + to_days(case when fold % 2 = 0 then 10 else 3 end) as label_end from sessions s join roles using (day))
select fold, strftime(max(day) filter (role = 'train'), '%Y-%m-%d') as last_train_as_of, strftime(max(label_end) filter (role = 'train'), '%Y-%m-%d') as last_train_label,
  strftime(min(day) filter (role = 'test'), '%Y-%m-%d') as first_test_as_of, max(label_end) filter (role = 'train') < min(day) filter (role = 'test') as valid
from x group by fold
""")
def leak_purge_audit(t):
    """Whether every training label ends before its test period; even folds get a
    label horizon longer than the purge and must fail."""
    d = splits.walk_forward_folds(sessions(t).select("ticker", "day"), day="day")
    d = d.withColumn("label_end", F.date_add("day", F.when(F.col("fold") % 2 == 0, 10).otherwise(3)))
    out = audits.audit_purge(d, as_of="day", label_end="label_end")
    return out.select(F.col("fold").cast("long").alias("fold"), "valid",
                      *[day_text(F.col(c)).alias(c) for c in ("last_train_as_of", "last_train_label", "first_test_as_of")])


@workload("scorecard", sql=f"""
with {SCORES},
e as (select strftime(date_trunc('month', day), '%Y-%m') as run, ticker, count(*) filter (trade) as trades, avg(actual_return - cost) filter (trade) as ev
      from scores group by 1, 2),
runs as (select run from e group by run)
select run, ticker, trades, round(ev, 6) as expected_value_per_trade from e join runs using (run) where trades > 0
""")
def scorecard(t):
    """All runs flattened to the experiments that opened a holdout, best first."""
    d = research_scores(t).groupBy(F.date_format("day", "yyyy-MM").alias("run"), "ticker").agg(
        F.count_if("trade").alias("trades"), F.avg(F.when(F.col("trade"), F.col("actual_return") - F.col("cost"))).alias("ev"))
    runs = d.groupBy("run").agg(F.collect_list(F.struct(
        "ticker", F.when(F.col("trades") > 0, F.struct("trades", "ev")).alias("holdout"))).alias("experiments"))
    from tidemark.sources.results import scorecard as flatten
    out = flatten(runs, run="run", created="run")
    return out.select("run", "ticker", "trades", r("ev").alias("expected_value_per_trade"))
