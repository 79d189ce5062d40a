"""Queries over the relationship scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.session import cut
from tidemark.workloads.adapters import SESSIONS, r, rounded, sessions
from tidemark.workloads.registry import workload

FEATURES = ["f_discount", "f_tax", "f_quantity", "f_count", "px", "past_return"]
_LONG = " union all ".join(f"select ticker, split, '{f}' as feature, {f} as x, future_return as y from sp where {f} is not null and future_return is not null" for f in FEATURES)
PAIRS = SESSIONS + f""",
cal as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from sessions)),
sp as (select s.*, case when i < floor(n * 0.7) - 1 then 'discovery' when i >= floor(n * 0.7) + 1 then 'confirmation' end as split from sessions s join cal using (day)),
lp as (select * from ({_LONG}) where split is not null)
"""


def _pairs(t):
    d = scan.split_rows(sessions(t), day="day")
    return cut(scan.long_pairs(d, features=FEATURES, target="future_return", keys=["split", "ticker"]))


@workload("spearman_scan", sql=f"""
with {PAIRS},
vw as (select feature, split, x, y, 'global' as view from lp union all
  select feature, split, x - avg(x) over (partition by feature, split, ticker), y - avg(y) over (partition by feature, split, ticker), 'within_ticker' from lp),
rk as (select *, rank() over (partition by feature, split, view order by x) + (count(*) over (partition by feature, split, view, x) - 1) / 2.0::double as rx,
  rank() over (partition by feature, split, view order by y) + (count(*) over (partition by feature, split, view, y) - 1) / 2.0::double as ry from vw)
select feature, split, view, count(*) as n, round(corr(rx, ry), 5) as rho from rk group by feature, split, view
""")
def spearman_scan(t):
    """Rank correlation per feature, split and view."""
    d = scan.rank_correlation(scan.with_views(_pairs(t), split="split", ticker="ticker"), keys=["feature", "split", "view"])
    return d.select("feature", "split", "view", "n", r("rho", 5).alias("rho"))


@workload("binned_mi", sql=f"""
with {PAIRS},
b as (select feature, split, floor((rank() over (partition by feature, split order by x) - 1) * 10 / count(*) over (partition by feature, split)) as bx,
  floor((rank() over (partition by feature, split order by y) - 1) * 10 / count(*) over (partition by feature, split)) as byy from lp),
j as (select feature, split, bx, byy, count(*) as n from b group by all),
m as (select *, sum(n) over (partition by feature, split, bx) as nx, sum(n) over (partition by feature, split, byy) as ny, sum(n) over (partition by feature, split) as nt from j)
select feature, split, cast(max(nt) as bigint) as n, round(sum(n / nt * ln(n * nt / (nx * ny))), 6) as mutual_information from m group by feature, split
""")
def binned_mi(t):
    """Information between each feature and the target by decile bins."""
    d = scan.binned_information(_pairs(t), keys=["feature", "split"])
    return d.select("feature", "split", "n", r("mutual_information").alias("mutual_information"))


_NORMAL_TAIL = "(0.39894228040143267794 * exp(-z * z / 2) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))"


def _family(source: str) -> str:
    """False-discovery rates of one family a view; with thousands of pairs the t tail is the normal tail to four digits."""
    return f"""select *, least(1, min(p * m / k) over (partition by view order by k desc rows unbounded preceding)) as q from (
      select *, row_number() over (partition by view order by p, feature) as k, count(*) over (partition by view) as m from (
        select *, 2 * {_NORMAL_TAIL} as p from (select *, 1 / (1 + 0.2316419 * z) as k from (
          select *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) as z from {source}))))"""


@workload("relationship_scan", sql=f"""
with {PAIRS},
vw as (select feature, split, x, y, 'global' as view from lp union all
  select feature, split, x - avg(x) over (partition by feature, split, ticker), y - avg(y) over (partition by feature, split, ticker), 'within_ticker' from lp),
rk as (select *, rank() over (partition by feature, split, view order by x) + (count(*) over (partition by feature, split, view, x) - 1) / 2.0::double as rx,
  rank() over (partition by feature, split, view order by y) + (count(*) over (partition by feature, split, view, y) - 1) / 2.0::double as ry from vw),
st as (select feature, split, view, count(*) as n, corr(rx, ry) as rho from rk group by feature, split, view),
dq as ({_family("(select * from st where split = 'discovery')")}),
chosen as (select feature from dq group by feature having max(n) filter (where view = 'global') >= 80 and min(q) <= 0.10),
cq as ({_family("(select * from st where split = 'confirmation' and feature in (select feature from chosen))")}),
g as (select c.feature, c.view, d.n as dn, d.rho as dr, c.n as cn, c.rho as cr, sign(c.rho) = sign(d.rho) and c.rho <> 0 and c.q <= 0.05 and c.n >= 40 as ok from cq c join dq d on d.feature = c.feature and d.view = c.view),
qt as (select feature, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from lp where split = 'confirmation' group by feature),
ef as (select lp.feature, avg(y) filter (where x >= q3) as hi, avg(y) filter (where x <= q1) as lo from lp join qt on qt.feature = lp.feature where split = 'confirmation' group by lp.feature)
select a.feature, a.ok and b.ok as confirmed, a.ok as confirmed_global, b.ok as confirmed_within_ticker, false as causal_claim, a.dn as discovery_n, a.cn as confirmation_n, round(a.dr, 5) as discovery_rho,
  round(a.cr, 5) as confirmation_rho, round(tanh(atanh(a.cr) - 1.96 / sqrt(a.cn - 3)), 5) as confirmation_low, round(tanh(atanh(a.cr) + 1.96 / sqrt(a.cn - 3)), 5) as confirmation_high,
  round(hi, 6) as high_mean, round(lo, 6) as low_mean, round(hi - lo, 6) as difference
from g a join g b on b.feature = a.feature and b.view = 'within_ticker' join ef on ef.feature = a.feature where a.view = 'global'
""")
def relationship_scan(t):
    """Hypotheses selected in discovery with their confirmation; two candidates carry nothing and are not tried."""
    d = cut(sessions(t).withColumns({"constant": F.lit(1.0), "sparse": F.when(F.dayofyear("day") == 7, F.col("px"))}))
    d = scan.relationship_scan(d, features=[*FEATURES, "constant", "sparse"], target="future_return", ticker="ticker", day="day")
    return d.select("feature", "confirmed", "confirmed_global", "confirmed_within_ticker", "causal_claim", "discovery_n", "confirmation_n", *rounded(d, [
        "discovery_rho", "confirmation_rho", "confirmation_low", "confirmation_high"], 5), *rounded(d, ["high_mean", "low_mean", "difference"]))
