"""Queries over metrics, splits, drift and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators import splits
from tidemark.workloads.adapters import SCORES, SESSIONS, day_text, r, research_scores, rounded, sessions
from tidemark.workloads.registry import workload

ECON = ["trade_rate", "expected_value_per_trade", "ev_formula", "ev_net", "gross_expected_value", "average_cost_return",
        "sharpe", "sortino", "profit_factor", "win_rate", "average_win", "average_loss", "payoff_ratio",
        "mean_expected_return", "maximum_drawdown", "net_return"]


def sql_economics(source: str, key: str) -> str:
    """The economic metrics of ``source(<key>, day, ticker, ...)`` grouped by ``key``."""
    return f"""
net as (select {key}, day, ticker, expected_return, cost, trade, actual_return, case when trade then actual_return - cost end as net,
          case when trade then actual_return end as gross from {source}),
curve as (select {key}, day, ticker, exp(sum(ln(1 + greatest(net, -0.999))) over w) as curve,
          row_number() over w as i from net where trade window w as (partition by {key} order by day, ticker rows unbounded preceding)),
peak as (select *, max(curve) over (partition by {key} order by day, ticker rows unbounded preceding) as peak from curve),
dd as (select {key}, max((peak - curve) / greatest(peak, 1e-12)) as maximum_drawdown, arg_max(curve, i) - 1 as net_return from peak group by {key}),
a as (select {key}, count(*) as observations, count(net) as number_of_trades, avg(trade::integer) as trade_rate, avg(net) as mean,
   stddev_samp(net) as sd, stddev_samp(net) filter (net < 0) as dn, count(*) filter (net > 0) as wins,
   coalesce(avg(net) filter (net > 0), 0) as aw, abs(coalesce(avg(net) filter (net <= 0), 0)) as al,
   coalesce(sum(net) filter (net > 0), 0) as sw, abs(sum(net) filter (net <= 0)) as sl,
   count(*) filter (gross > 0) as gw, coalesce(avg(gross) filter (gross > 0), 0) as gaw,
   abs(coalesce(avg(gross) filter (gross <= 0), 0)) as gal, avg(gross) as gm, avg(cost) filter (trade) as ac,
   avg(expected_return) filter (trade) as me from net group by {key})
select a.{key}, observations, number_of_trades, round(trade_rate, 6) as trade_rate,
  round(coalesce(mean, 0), 6) as expected_value_per_trade,
  round(coalesce(wins / nullif(number_of_trades, 0), 0) * aw - (1 - coalesce(wins / nullif(number_of_trades, 0), 0)) * al, 6) as ev_formula,
  round(coalesce(gw / nullif(number_of_trades, 0), 0) * gaw - (1 - coalesce(gw / nullif(number_of_trades, 0), 0)) * gal - coalesce(ac, 0), 6) as ev_net,
  round(coalesce(gm, 0), 6) as gross_expected_value, round(coalesce(ac, 0), 6) as average_cost_return,
  round(case when sd > 0 then mean / sd * sqrt(252) end, 6) as sharpe, round(case when dn > 0 then mean / dn * sqrt(252) end, 6) as sortino,
  round(case when sl > 0 then sw / sl end, 6) as profit_factor, round(coalesce(wins / nullif(number_of_trades, 0), 0), 6) as win_rate,
  round(aw, 6) as average_win, round(-al, 6) + 0 as average_loss, round(case when al > 0 then aw / al end, 6) as payoff_ratio,
  round(coalesce(me, 0), 6) as mean_expected_return, round(coalesce(maximum_drawdown, 0), 6) as maximum_drawdown,
  round(coalesce(net_return, 0), 6) as net_return
from a left join dd on a.{key} = dd.{key}
"""


def _with_month(d):
    return d.withColumn("month", F.date_trunc("month", "day"))


@workload("economic_metrics", sql=f"with {SCORES}, {sql_economics('scores', 'ticker')}")
def economic_metrics(t):
    """Trading metrics after cost per ticker."""
    d = m.economic_metrics(_with_month(research_scores(t)), keys=["ticker"], order=["day", "ticker"], bucket="month")
    return d.select("ticker", "observations", "number_of_trades", *rounded(d, ECON))


_DIMS = """
dims as (
  select 'ticker' as dim, cast(ticker as varchar) as value, * exclude (ticker), ticker from scores union all
  select 'period', cast(year(day) as varchar), * exclude (ticker), ticker from scores union all
  select 'regime', case when past_return >= 0.01 then 'bull' when past_return <= -0.01 then 'bear' else 'sideways' end, * exclude (ticker), ticker from scores),
keyed as (select dim || '=' || value as slice, * from dims)
"""


@workload("breakdown_grouping_sets", sql=f"with {SCORES}, {_DIMS}, {sql_economics('keyed', 'slice')}")
def breakdown_grouping_sets(t):
    """The same metrics per period, ticker and market regime in one pass."""
    d = _with_month(research_scores(t)).withColumns({
        "period": F.year("day"),
        "regime": F.when(F.col("past_return") >= 0.01, "bull").when(F.col("past_return") <= -0.01, "bear").otherwise("sideways")})
    d = m.breakdown_rows(d, {"ticker": "ticker", "period": "period", "regime": "regime"})
    d = d.withColumn("slice", F.concat_ws("=", "dim", "value"))
    out = m.economic_metrics(d, keys=["slice"], order=["day", "ticker"], bucket="month")
    return out.select("slice", "observations", "number_of_trades", *rounded(out, ECON))


@workload("predictive_metrics", sql=f"""
with {SCORES}
select ticker, count(*) as n, round(avg(abs(actual_return - expected_return)), 6) as mae,
  round(sqrt(avg((actual_return - expected_return) ** 2)), 6) as rmse,
  round(avg(((expected_return > 0) = (actual_return > 0))::integer), 6) as direction_accuracy,
  round(avg((probability - (actual_return > 0)::integer) ** 2), 6) as brier,
  round(abs(avg(probability) - avg((actual_return > 0)::integer)), 6) as calibration_gap
from scores group by ticker
""")
def predictive_metrics(t):
    """Error, direction and calibration of the forecast per ticker."""
    d = m.predictive_metrics(research_scores(t), keys=["ticker"])
    return d.select("ticker", "n", *rounded(d, ["mae", "rmse", "direction_accuracy", "brier", "calibration_gap"]))


@workload("drawdown", sql=f"""
with {SCORES},
c as (select ticker, day, exp(sum(ln(1 + greatest(actual_return, -0.999))) over (partition by ticker order by day rows unbounded preceding)) as curve from scores),
p as (select *, max(curve) over (partition by ticker order by day rows unbounded preceding) as peak from c)
select ticker, strftime(day, '%Y-%m-%d') as day, round(curve, 6) as curve, round((peak - curve) / greatest(peak, 1e-12), 6) as drawdown from p
""")
def drawdown(t):
    """Compounded curve and drawdown per ticker and session."""
    d = m.equity_curve(_with_month(research_scores(t)), keys=["ticker"], order=["day"], bucket="month", net="actual_return")
    return d.select("ticker", day_text(F.col("day")).alias("day"), *rounded(d, ["curve", "drawdown"]))


_EDGES = "[" + ", ".join(f"{i * 0.1!r}::double" for i in range(11)) + "]"
_BINS = f"""
binned as (select *, least(len(list_filter({_EDGES}, lambda e: e <= probability)) - 1, 9) as bin,
             (actual_return > 0)::integer as hit from scores),
bins as (select bin, count(*) as n, avg(probability) as mp, sum(hit) as hits, avg(actual_return) as mr,
           avg(actual_return) filter (actual_return > 0) as mpos, avg(actual_return) filter (actual_return <= 0) as mneg
         from binned group by bin),
wil as (select *, hits / n as p, 1 + 1.96 * 1.96 / n as den from bins),
ci as (select *, greatest(0, (p + 1.96 * 1.96 / (2 * n)) / den - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n) / den) as lo,
              least(1, (p + 1.96 * 1.96 / (2 * n)) / den + 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n) / den) as hi from wil)
"""


def _bins(t):
    d = research_scores(t).withColumn("hit", F.col("actual_return") > 0)
    return d, m.evidence_bins(d, keys=[], probability="probability", hit="hit", realised="actual_return")


@workload("evidence_bins", sql=f"""
with {SCORES}, {_BINS}
select round(({_EDGES})[bin + 1], 6) as bin_low, n, cast(hits as bigint) as hits, round(mp, 6) as mean_predicted_probability,
       round(p, 6) as observed_positive_rate, round(lo, 6) as ci95_low, round(hi, 6) as ci95_high,
       round(mr, 6) as mean_realized_return, round(mpos, 6) as mean_positive_return, round(mneg, 6) as mean_nonpositive_return
from ci
""")
def evidence_bins(t):
    """Hit rate with interval and mean returns per probability bin."""
    _, d = _bins(t)
    return d.select("n", "hits", *rounded(d, [
        "bin_low", "mean_predicted_probability", "observed_positive_rate", "ci95_low", "ci95_high",
        "mean_realized_return", "mean_positive_return", "mean_nonpositive_return"]))


@workload("evidence_lookup", sql=f"""
with {SCORES}, {_BINS},
b as (select bin, ({_EDGES})[bin + 1] as lo_edge, ({_EDGES})[bin + 2] as hi_edge, mp, n, p from ci),
j as (select s.ticker, s.day, b.*, (s.probability * 0.6::double) as prob,
        (prob >= lo_edge and (prob < hi_edge or (hi_edge >= 0.999999 and prob <= 1))) as inside from scores s, b),
k as (select *, row_number() over (partition by ticker, day order by inside desc, case when inside then 0 else abs(mp - prob) end, lo_edge) as rn from j)
select ticker, strftime(day, '%Y-%m-%d') as day, n as evidence_n, round(p, 6) as evidence_observed_positive_rate from k where rn = 1
""")
def evidence_lookup(t):
    """Historical evidence for each row's probability, nearest bin when none holds it."""
    d, bins = _bins(t)
    rows = d.select("ticker", "day", (F.col("probability") * 0.6).alias("prob"))
    out = m.lookup_evidence(rows, bins, probability="prob", take=["n", "observed_positive_rate"])
    return out.select("ticker", day_text(F.col("day")).alias("day"), "evidence_n",
                      r("evidence_observed_positive_rate").alias("evidence_observed_positive_rate"))


@workload("model_scores", sql=f"""
with {SCORES},
rk as (select ticker, actual_return > 0 as pos, rank() over (partition by ticker order by probability)
        + (count(*) over (partition by ticker, probability) - 1) / 2.0::double as rk from scores),
auc as (select ticker, (sum(rk) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0::double)
        / (count(*) filter (pos) * count(*) filter (not pos)) as auc from rk group by ticker),
s as (select ticker, count(*) as n, avg(abs(actual_return - expected_return)) as mae,
  sqrt(avg((actual_return - expected_return) ** 2)) as rmse,
  1 - sum((actual_return - expected_return) ** 2) / (var_pop(actual_return) * count(*)) as r2, corr(actual_return, expected_return) as corr,
  avg(((actual_return > 0) = (expected_return > 0))::integer) as da,
  avg((probability - (actual_return > 0)::integer) ** 2) as brier, avg(((probability >= 0.5) = (actual_return > 0))::integer) as acc
  from scores group by ticker)
select ticker, n, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2, round(corr, 6) as corr,
       round(da, 6) as direction_accuracy, round(brier, 6) as brier, round(acc, 6) as accuracy, round(auc, 6) as auc
from s join auc using (ticker)
""")
def model_scores(t):
    """Regression and classification scores per ticker with an exact ROC area."""
    d = m.model_scores(research_scores(t), keys=["ticker"], actual="actual_return", expected="expected_return", probability="probability")
    return d.select("ticker", "n", *rounded(d, ["mae", "rmse", "r2", "corr", "direction_accuracy", "brier", "accuracy", "auc"]))


@workload("paired_ttest", sql=f"""
with {SCORES},
x as (select ticker, case when trade then actual_return - cost else 0 end as c,
             case when expected_return > 0 then actual_return - cost else 0 end as b from scores)
select ticker, count(*) as n, round(avg(c - b), 8) as mean_difference, round(avg(c - b) / (stddev_samp(c - b) / sqrt(count(*))), 6) as t_statistic
from x group by ticker
""")
def paired_ttest(t):
    """Two decision rules compared on the same ticker-days."""
    d = research_scores(t)
    net = lambda on: F.when(on, F.col("actual_return") - F.col("cost")).otherwise(F.lit(0.0)).alias("net")
    candidate = d.select("ticker", "day", net(F.col("trade")))
    baseline = d.select("ticker", "day", net(F.col("expected_return") > 0))
    out = m.paired_test(candidate, baseline, on=["ticker", "day"], value="net", keys=["ticker"])
    return out.select("ticker", "n", r("mean_difference", 8).alias("mean_difference"), r("t_statistic").alias("t_statistic"))


@workload("bh_fdr", sql=f"""
with {SCORES},
h as (select ticker, date_trunc('month', day) as month, avg(actual_return) / nullif(stddev_samp(actual_return) / sqrt(count(*)), 0) as z from scores group by all),
p as (select *, case when z is null then null else 1 / (1 + abs(z) ** 3) end as p from h),
k as (select *, row_number() over (partition by ticker order by p) as rk, count(*) over (partition by ticker) as m from p where p is not null),
q as (select *, min(p * m / rk) over (partition by ticker order by p rows between current row and unbounded following) as q from k)
select ticker, strftime(month, '%Y-%m-%d') as month, round(p, 8) as p, round(least(1, q), 8) as q from q
union all select ticker, strftime(month, '%Y-%m-%d'), null, null from p where p is null
""")
def bh_fdr(t):
    """False-discovery rates of one hypothesis per month, a family per ticker."""
    d = research_scores(t).groupBy("ticker", F.date_trunc("month", "day").alias("month")).agg(
        F.try_divide(F.avg("actual_return"), F.stddev_samp("actual_return") / F.sqrt(F.count(F.lit(1)))).alias("z"))
    d = d.withColumn("p", 1 / (1 + F.pow(F.abs("z"), 3)))
    out = m.benjamini_hochberg(d, keys=["ticker"], p="p")
    return out.select("ticker", day_text(F.col("month")).alias("month"), r("p", 8).alias("p"), r("q", 8).alias("q"))


_PSI_SQL = f"""
with {SESSIONS},
long as (unpivot (select ticker, day, f_discount, f_tax, f_quantity, f_count, px from sessions) on f_discount, f_tax, f_quantity, f_count, px into name feature value value),
lab as (select feature, value, year(day) < 1997 as ref from long),
e as (select feature, list_sort(list_distinct([{', '.join(f'quantile_cont(value, {i / 10})' for i in range(11))}])) as edges from lab where ref group by feature),
i as (select feature, case when len(edges) >= 3 then edges[2:len(edges) - 1] else [] end as inner_edges from e),
b as (select feature, ref, len(list_filter(inner_edges, lambda x: x <= value)) as bin from lab join i using (feature)),
g as (select feature, unnest(range(len(inner_edges) + 1)) as bin from i),
hc as (select feature, bin, count(*) filter (ref) as rc, count(*) filter (not ref) as cc from b group by all),
t as (select feature, sum(rc) as rn, sum(cc) as cn from hc group by feature),
s as (select g.feature, t.rn, t.cn, greatest(coalesce(rc, 0) / rn, 1e-6) as rs, greatest(coalesce(cc, 0) / cn, 1e-6) as cs
      from g left join hc on hc.feature = g.feature and hc.bin = g.bin join t on t.feature = g.feature)
select feature, cast(max(rn) as bigint) as reference_n, cast(max(cn) as bigint) as current_n, round(sum((cs - rs) * ln(cs / rs)), 6) as psi
from s group by feature
"""


@workload("psi", sql=_PSI_SQL)
def psi(t):
    """Drift of each feature after 1996 against the years before."""
    names = ["f_discount", "f_tax", "f_quantity", "f_count", "px"]
    d = sessions(t).select("day", *names).unpivot(["day"], names, "feature", "value")
    d = d.withColumn("reference", F.year("day") < 1997)
    out = m.stability_index(d, keys=["feature"], value="value", is_reference="reference")
    return out.select("feature", "reference_n", "current_n", r("psi").alias("psi"))


_CAL = "cal as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from sessions))"


@workload("holdout_split", sql=f"""
with {SESSIONS}, {_CAL},
c as (select day, case when i >= n - greatest(20, ceil(n * 0.15)) then 'holdout' when i < n - greatest(20, ceil(n * 0.15)) - 5 then 'research' else 'purged' end as part from cal)
select ticker, strftime(day, '%Y-%m-%d') as day, part from sessions join c using (day)
""")
def holdout_split(t):
    """Research, purged and untouched holdout sessions."""
    d = splits.holdout_split(sessions(t).select("ticker", "day"), day="day")
    return d.select("ticker", day_text(F.col("day")).alias("day"), "part")


_FOLDS = """
pc as (select max(n) as n, greatest(cast(floor((max(n) - 21 - 85) / 21.0::double) as bigint) + 1, 0) as cnt from cal),
picks as (select distinct cast(trunc(k * (cnt - 1) / 4.0::double) as bigint) as s from pc, range(5) g(k) where cnt > 5
          union select k from pc, range(1000) g(k) where cnt <= 5 and k < cnt),
folds as (select row_number() over (order by s) as fold, 85 + 21 * s as start from picks),
roles as (select day, fold, 'train' as role from cal, folds where i < start - 5
          union all select day, fold, 'test' from cal, folds where i >= start + 1 and i < start + 21)
"""


@workload("walk_forward_folds", sql=f"""
with {SESSIONS}, {_CAL}, {_FOLDS}
select fold, role, ticker, count(*) as rows, strftime(min(day), '%Y-%m-%d') as first_day, strftime(max(day), '%Y-%m-%d') as last_day
from sessions join roles using (day) group by all
""")
def walk_forward_folds(t):
    """Purged walk-forward folds: rows and span per fold, role and ticker."""
    d = splits.walk_forward_folds(sessions(t).select("ticker", "day"), day="day")
    return d.groupBy(F.col("fold").cast("long").alias("fold"), "role", "ticker").agg(
        F.count(F.lit(1)).alias("rows"), day_text(F.min("day")).alias("first_day"), day_text(F.max("day")).alias("last_day"))


@workload("time_partitions", sql=f"""
with {SESSIONS}, {_CAL},
c as (select day, case when i < floor(n * 0.55) then case when i < floor(n * 0.55) - 5 then 'train' else 'purged' end
   when i < floor(n * 0.7) then case when i < floor(n * 0.7) - 5 then 'validation' else 'purged' end
   when i < floor(n * 0.85) then case when i < floor(n * 0.85) - 5 then 'calibration' else 'purged' end else 'test' end as part from cal),
ix as (select s.ticker, s.day, row_number() over (order by s.day, s.ticker) as pos, count(*) over () as cnt from sessions s)
select ix.ticker, strftime(ix.day, '%Y-%m-%d') as day, part,
   case when pos <= floor(cnt * 0.6) then 'discovery' when pos <= floor(cnt * 0.8) then 'validation' else 'holdout' end as row_part
from ix join c using (day)
""")
def time_partitions(t):
    """Whole-session partitions with purge, and the row-share variant beside it."""
    d = sessions(t).select("ticker", "day")
    d = splits.time_partitions(d, day="day", purge=5,
                               shares={"train": 0.55, "validation": 0.15, "calibration": 0.15, "test": 0.15})
    d = splits.row_share_splits(d.withColumn("month", F.date_trunc("month", "day")), order=["day", "ticker"], bucket="month",
                                shares={"discovery": 0.6, "validation": 0.2, "holdout": 0.2}, out="row_part")
    return d.select("ticker", day_text(F.col("day")).alias("day"), "part", "row_part")


@workload("baseline_mean", sql=f"""
with {SESSIONS}, {_CAL}, {_FOLDS},
j as (select fold, role, future_return from sessions join roles using (day) where future_return is not null),
tr as (select fold, avg(future_return) as mean, stddev_samp(future_return) as sigma from j where role = 'train' group by fold)
select fold, round(any_value(mean), 6) as expected_return, round(any_value(sigma), 6) as residual_sigma, count(*) as test_rows,
       round(avg(abs(future_return - mean)), 6) as mae
from j join tr using (fold) where role = 'test' group by fold
""")
def baseline_mean(t):
    """Historical-mean forecast per fold and its error on the test sessions."""
    from tidemark.operators.research import historical_mean
    folds = splits.walk_forward_folds(sessions(t).select("ticker", "day", "future_return"), day="day")
    d = historical_mean(folds, target="future_return")
    return d.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        r(F.first("expected_return")).alias("expected_return"), r(F.first("prediction_uncertainty")).alias("residual_sigma"),
        F.count(F.lit(1)).alias("test_rows"),
        r(F.avg(F.abs(F.col("future_return") - F.col("expected_return")))).alias("mae"))
