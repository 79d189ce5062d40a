"""Queries over filings, estimates and point-in-time earnings features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.clock import stamp
from tidemark.operators import earnings as e
from tidemark.session import cut
from tidemark.workloads.adapters import day_text, r, rounded
from tidemark.workloads.registry import workload

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def filings(t):
    """orders as year-to-date quarterly filings of a nation (the company)."""
    d = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    q = d.groupBy(F.col("c_nationkey").alias("company"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("q")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    return q.filter(F.col("cents").isNotNull())


FILINGS = """
q as (select c_nationkey as company, cast(year(o_orderdate) as integer) as fy, cast(quarter(o_orderdate) as integer) as q, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, count(*) as n
      from orders join customer on o_custkey = c_custkey group by all having cents is not null),
ytd as (select *, cast(sum(cents) over (partition by company, fy order by q) as bigint) as cum from q),
base as (select *, case q when 4 then 'FY' else 'Q' || q end as fp, company || '-' || fy || '-' || q as accn, make_date(fy, 1, 1) as y0,
   make_date(fy, q * 3 - 2, 1) as q0, (make_date(fy, q * 3, 1) + interval 1 month - interval 1 day)::date as pe from ytd)
"""


def _facts_json(t):
    """The filings as one company-facts document per company."""
    from pyspark.sql import Window
    q = filings(t).withColumn("cum", F.sum("cents").over(Window.partitionBy("company", "fy").orderBy("q")))
    y0, q0 = F.make_date("fy", F.lit(1), F.lit(1)), F.make_date("fy", F.col("q") * 3 - 2, F.lit(1))
    pe = F.last_day(F.make_date("fy", F.col("q") * 3, F.lit(1)))
    fp = F.when(F.col("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), F.col("q").cast("string")))
    accn = F.concat_ws("-", "company", "fy", "q")
    d = q.withColumns({"y0": y0, "q0": q0, "pe": pe, "fp": fp, "accn": accn})
    form = F.when(F.col("q") == 4, "10-K").otherwise("10-Q")

    def fact(start, value, kind=form, period=F.col("fp")):
        return F.struct(start.cast("string").alias("start"), F.col("pe").cast("string").alias("end"), value.cast("double").alias("val"), F.col("accn").alias("accn"),
                        F.col("fy").alias("fy"), period.alias("fp"), kind.alias("form"), F.date_add("pe", 40).cast("string").alias("filed"), F.lit(None).cast("string").alias("frame"))
    none = F.lit(None).cast("string")
    def one(concept, unit, value):
        return F.struct(F.lit(concept).alias("c"), F.lit(unit).alias("u"), value.alias("f"))
    facts = F.array(
        one("Revenues", "USD", fact(F.col("y0"), F.col("cum") / 100)),
        one("SalesRevenueNet", "USD", fact(F.col("y0"), F.col("cum") / 90)),
        one("NetIncomeLoss", "EUR", fact(F.col("q0"), F.col("cents") / 900)),
        one("NetIncomeLoss", "USD", fact(F.col("y0"), F.col("cum") / 1000)),
        one("EarningsPerShareDiluted", "USD/shares", fact(F.when(F.col("q") == 4, F.col("y0")).otherwise(F.col("q0")), F.col("n") / 10.0)),
        one("Assets", "USD", fact(none, F.col("cents") / 10)),
        one("StockholdersEquity", "USD", fact(none, F.col("cents") / 25, form, F.when(F.col("n") % 5 == 0, "Q1").otherwise(F.col("fp")))),
        one("Assets", "USD", fact(none, F.col("cents") / 7, F.lit("8-K"))))
    d = d.select("company", F.inline(facts))
    units = d.groupBy("company", "c", "u").agg(F.collect_list("f").alias("fs"))
    concepts = units.groupBy("company", "c").agg(F.map_from_entries(F.collect_list(F.struct("u", "fs"))).alias("units"))
    return concepts.groupBy("company").agg(F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct(
        "c", F.struct("units"))))  .alias("us-gaap")).alias("facts"))).alias("json"))


def _sql_facts() -> str:
    def one(metric, concept, crank, unit, urank, start, value, fp="fp"):
        return (f"select company, '{metric}' as metric, '{concept}' as concept, {crank} as concept_rank, '{unit}' as unit, {urank} as unit_rank, {start} as start, pe, "
                f"{value} as value, accn, fy, {fp} as fp, q from base")
    rows = [one("revenue", "Revenues", 1, "USD", 0, "y0", "cum / 100"), one("revenue", "SalesRevenueNet", 2, "USD", 0, "y0", "cum / 90"),
            one("net_income", "NetIncomeLoss", 0, "EUR", 5, "q0", "cents / 900"), one("net_income", "NetIncomeLoss", 0, "USD", 0, "y0", "cum / 1000"),
            one("eps_actual_sec", "EarningsPerShareDiluted", 0, "USD/shares", 0, "case when q = 4 then y0 else q0 end", "n / 10.0::double"),
            one("assets", "Assets", 0, "USD", 0, "null::date", "cents / 10"),
            one("equity", "StockholdersEquity", 0, "USD", 0, "null::date", "cents / 25", "case when n % 5 = 0 then 'Q1' else fp end")]
    return FILINGS + ", facts as (" + " union all ".join(rows) + ")"


FACTS = _sql_facts()


def _facts(t):
    return e.explode_facts(_facts_json(t), keys=["company"], json="json")


@workload("facts_explode", sql=f"""
with {FACTS}
select company, metric, concept, concept_rank, unit, unit_rank, accn, fy, fp, date_diff('day', start, pe) + 1 as period_days, round(value, 3) as value, strftime(pe + 40, '%Y-%m-%d') as filed from facts
""")
def facts_explode(t):
    """Company facts as rows with metric, ranks and period length."""
    d = _facts(t)
    return d.select("company", "metric", "concept", "concept_rank", "unit", "unit_rank", "accn", "fy", "fp", F.col("period_days").cast("long").alias("period_days"),
                    r("value", 3).alias("value"), day_text(F.col("filed")).alias("filed"))


_MAJOR = FACTS + """,
v as (select company, accn, fp, count(*) as c from facts group by all),
major as (select company, accn, arg_max(fp, (c, -ascii(fp[1]), -ascii(fp[2]))) as fp from v group by company, accn)
"""


@workload("facts_majority", sql=f"""
with {_MAJOR}
select f.company, f.accn, any_value(m.fp) as fp, any_value(f.fy) as fy, count(*) as facts from facts f join major m on m.company = f.company and m.accn = f.accn group by f.company, f.accn
""")
def facts_majority(t):
    """Fiscal period and year per accession by majority."""
    return e.majority_period(_facts(t), keys=["company"]).select("company", "accn", "fp", "fy", "facts")


_PICK = _MAJOR + """,
sc as (select f.*, m.fp as mfp, date_diff('day', start, f.pe) + 1 as days from facts f join major m on m.company = f.company and m.accn = f.accn),
sd as (select *, case when metric in ('assets', 'equity') then 0 when mfp = 'FY' then abs(coalesce(days, 9999) - 365)
   when days between 60 and 130 then abs(days - 91) else abs(coalesce(days, 9999) - 91 * (case mfp when 'Q1' then 1 when 'Q2' then 2 when 'Q3' then 3 else 1 end)) + 100 end as s from sc),
picked as (select * from (select *, row_number() over (partition by company, accn, metric order by s, unit_rank, concept_rank) as rn from sd) where rn = 1)
"""


def _picked(t):
    facts = cut(_facts(t))
    return e.pick_facts(facts, e.majority_period(facts, keys=["company"]), keys=["company"])


@workload("facts_pick", sql=f"""
with {_PICK}
select company, accn, mfp as fp, fy, metric, concept, unit, days as period_days, round(value, 3) as value from picked
""")
def facts_pick(t):
    """Best fact per accession and metric."""
    d = _picked(t)
    return d.select("company", "accn", "fp", "fy", "metric", "concept", "unit", F.col("period_days").cast("long").alias("period_days"), r("value", 3).alias("value"))


@workload("ytd_quarterize", sql=f"""
with {_PICK},
f as (select company, fy, metric, accn, q as true_q, case mfp when 'FY' then 4 else ascii(mfp[2]) - 48 end as q, value, days, pe from picked where metric in ('revenue', 'net_income', 'eps_actual_sec')),
n1 as (select f.*, (select arg_max(p.value, p.pe) from f p where p.company = f.company and p.fy = f.fy and p.metric = f.metric and p.q = 1 and p.pe <= f.pe) as p1 from f),
v2 as (select *, case when q = 2 and metric <> 'eps_actual_sec' and coalesce(days, 999) > 130 and p1 is not null then value - p1 else value end as d2,
          q = 2 and metric <> 'eps_actual_sec' and coalesce(days, 999) > 130 and p1 is not null as x2 from n1),
n2 as (select v.*, (select arg_max(p.d2, p.pe) from v2 p where p.company = v.company and p.fy = v.fy and p.metric = v.metric and p.q = 2 and p.pe <= v.pe) as p2 from v2 v),
v3 as (select *, case when q = 3 and metric <> 'eps_actual_sec' and coalesce(days, 999) > 130 and p1 + p2 is not null then value - p1 - p2 else d2 end as d3,
          q = 3 and metric <> 'eps_actual_sec' and coalesce(days, 999) > 130 and p1 + p2 is not null as x3 from n2),
n3 as (select v.*, (select arg_max(p.d3, p.pe) from v3 p where p.company = v.company and p.fy = v.fy and p.metric = v.metric and p.q = 3 and p.pe <= v.pe) as p3 from v3 v)
select company, fy, metric, accn, round(case when metric = 'eps_actual_sec' then case when coalesce(days, 999) > 130 then null else value end
     when q = 4 and coalesce(days, 999) > 130 then value - p1 - p2 - p3 else d3 end, 3) as value,
  case when metric = 'eps_actual_sec' then case when coalesce(days, 999) > 130 then 'non_additive_period_rejected' else 'reported_quarter' end
    when q = 4 and coalesce(days, 999) > 130 then case when value - p1 - p2 - p3 is not null then 'derived_q4_from_annual' else 'q4_not_derivable' end
    when x2 or x3 then 'quarterized_ytd' else 'reported_quarter' end as derivation from n3
""")
def ytd_quarterize(t):
    """Quarterly flows from year-to-date filings; per-share values untouched."""
    d = e.quarterise(_picked(t), keys=["company"])
    return d.select("company", "fy", "metric", "accn", r("value", 3).alias("value"), "derivation")


LABELS = ("bmo", "After Market Close", None, "12:30")


@workload("earn_event_clock", sql=f"""
with d as (select cast(o_orderdate as date) as day, l.raw from (select distinct o_orderdate from orders), (values ('bmo'), ('After Market Close'), (null), ('12:30'), ('dmh')) l(raw)),
k as (select *, case raw when 'bmo' then 'before_market_open' when 'After Market Close' then 'after_market_close' when 'dmh' then 'during_market_hours' when '12:30' then '12:30' else 'unknown' end as label,
   case raw when 'bmo' then 480 when 'After Market Close' then 965 when '12:30' then 750 when 'dmh' then 720 end as m from d),
c as (select *, case when m is null then (day + 1)::timestamp else ((day::timestamp + to_minutes(m)) at time zone 'America/New_York') at time zone 'UTC' end as clock from k)
select strftime(day, '%Y-%m-%d') as day, label, strftime(clock, {TS}) as event_utc, strftime(case when m is null then day::timestamp else clock end, {TS}) as cutoff_utc from c
""")
def earn_event_clock(t):
    """Release instant and estimate cutoff for every date and label."""
    labels = F.array(*[F.lit(x) for x in ("bmo", "After Market Close", None, "12:30", "dmh")])
    d = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().select("day", F.explode(labels).alias("raw"))
    d = d.withColumn("label", e.release_label(F.col("raw")))
    return d.select(day_text(F.col("day")).alias("day"), "label", stamp(e.event_clock(F.col("day"), F.col("label"))).alias("event_utc"),
                    stamp(e.estimate_cutoff(F.col("day"), F.col("label"))).alias("cutoff_utc"))


def estimate_history(t):
    """events as observations of a user's weekly report, due on Friday."""
    kind, value = F.col("event_type"), F.col("value")
    day = F.date_add(F.to_date(F.date_trunc("week", "ts")), 4)
    at = F.col("user_id") % 4
    raw = F.when(at == 0, "bmo").when(at == 1, "amc").when(at == 2, "12:30")
    d = t.events.select(
        F.col("user_id").alias("ticker"), day.alias("earnings_date"), e.release_label(raw).alias("earnings_time"), F.col("ts").alias("observed_at"),
        F.when(kind.isin("view", "click"), value / 100).alias("eps_estimated"), F.when(kind == "view", value * 10).alias("revenue_estimated"),
        F.when(kind == "purchase", value / 90).alias("eps_actual"), F.when(kind == "purchase", value * 11).alias("revenue_actual"),
        F.when(F.col("user_id") % 3 == 0, F.date_sub(day, 43)).alias("fiscal_end"))
    return d.withColumn("cutoff", e.estimate_cutoff(F.col("earnings_date"), F.col("earnings_time")))


ESTIMATES = """
eh as (select user_id as ticker, (date_trunc('week', ts) + interval 4 day)::date as ed, case user_id % 4 when 0 then 'before_market_open' when 1 then 'after_market_close' when 2 then '12:30' else 'unknown' end as et,
  case user_id % 4 when 0 then 480 when 1 then 965 when 2 then 750 end as m, ts as obs, case when event_type in ('view', 'click') then value / 100 end as ee, case when event_type = 'view' then value * 10 end as re,
  case when event_type = 'purchase' then value / 90 end as ea, case when event_type = 'purchase' then value * 11 end as ra from events),
ec as (select *, case when m is null then ed::timestamp else ((ed::timestamp + to_minutes(m)) at time zone 'America/New_York') at time zone 'UTC' end as cutoff,
   case when ticker % 3 = 0 then ed - 43 end as fe from eh),
fl as (select *, row_number() over (partition by ticker, ed order by case when ee is not null and obs <= cutoff then 0 else 1 end, case when ee is not null and obs <= cutoff then -epoch_us(obs) end) as rp,
   row_number() over (partition by ticker, ed order by case when ee is not null then 0 else 1 end, obs) as rany, row_number() over (partition by ticker, ed order by obs) as rf,
   row_number() over (partition by ticker, ed order by case when ea is not null then 0 else 1 end, obs) as ract, row_number() over (partition by ticker, ed order by obs desc) as rl from ec),
es as (select ticker, ed, any_value(et) as et, any_value(fe) as fe, bool_or(ee is not null and obs <= cutoff) as safe, bool_or(ee is not null) as has_est, bool_or(ea is not null) as done,
   max(ee) filter (rp = 1) as pee, max(re) filter (rp = 1) as pre, max(obs) filter (rp = 1) as pobs, max(ee) filter (rany = 1) as aee, max(re) filter (rany = 1) as are, max(obs) filter (rany = 1) as aobs,
   max(obs) filter (rf = 1) as fobs, max(ea) filter (ract = 1) as xea, max(ra) filter (ract = 1) as xra, max(obs) filter (ract = 1) as xobs from fl group by ticker, ed),
est as (select ticker, ed, et, fe, case when safe then pee else aee end as ee, case when safe then pre else are end as re, case when safe then pobs when has_est then aobs else fobs end as eobs, fobs,
   case when done then xea end as ea, case when done then xra end as ra, case when done then xobs end as aobs2, safe,
   case when safe then 'observed_pre_event' when has_est then 'backfill_unverified' else 'estimate_missing' end as status, ticker * 100000 + date_diff('day', date '2000-01-01', ed) as eid from es)
"""


def _estimates(t, history=None):
    d = e.select_estimates(estimate_history(t) if history is None else history, keys=["ticker", "earnings_date"], extra=["earnings_time", "fiscal_end"])
    return d.withColumn("eid", F.col("ticker") * 100000 + F.datediff("earnings_date", F.lit("2000-01-01").cast("date")))


@workload("estimate_pit_select", sql=f"""
with {ESTIMATES}
select ticker, strftime(ed, '%Y-%m-%d') as earnings_date, round(ee, 6) as eps_estimated, round(re, 6) as revenue_estimated, round(ea, 6) as eps_actual, round(ra, 6) as revenue_actual,
  strftime(eobs, {TS}) as estimate_available, strftime(fobs, {TS}) as event_schedule_available, strftime(aobs2, {TS}) as actual_available, safe as estimate_safe, status as estimate_status from est
""")
def estimate_pit_select(t):
    """Per report the estimate really seen before it, and the first actual."""
    d = _estimates(t)
    return d.select("ticker", day_text(F.col("earnings_date")).alias("earnings_date"), *rounded(d, ["eps_estimated", "revenue_estimated", "eps_actual", "revenue_actual"]),
                    *[stamp(F.col(c)).alias(c) for c in ("estimate_available", "event_schedule_available", "actual_available")], "estimate_safe", "estimate_status")


def user_filings(t):
    """events as filings of a user."""
    d = t.events
    day = F.to_date("ts")
    return d.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("fid"), F.date_sub(day, 40).alias("period_end"), F.date_add(day, 2).alias("filing_date"),
                    (F.col("ts") + F.expr("interval 3 days")).alias("sec_available"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 80).alias("eps_actual_sec"),
                    F.when(F.col("event_id") % 3 != 0, F.col("value") * 12).alias("revenue_sec"), (F.col("value") * 2).alias("net_income"), (F.col("value") * 20).alias("assets"))


MATCH = ESTIMATES + """,
fi as (select user_id as ticker, event_id as fid, ts::date - 40 as pe, ts::date + 2 as fd, ts + interval 3 day as sa, case when event_id % 2 = 0 then value / 80 end as es, case when event_id % 3 <> 0 then value * 12 end as rs,
   value * 2 as ni, value * 20 as assets from events),
cand as (select fid, eid, 0 as kind, -date_diff('day', date '2000-01-01', ed) as score, ed from fi join est on est.ticker = fi.ticker and est.fe = fi.pe
   union all select fid, eid, 1, abs(date_diff('day', fd, ed)) * 10 + abs(date_diff('day', pe, ed)), ed from fi join est on est.ticker = fi.ticker
      and date_diff('day', pe, ed) between -7 and 190 and abs(date_diff('day', fd, ed)) <= 45),
best as (select fid, arg_min(eid, (kind, score, ed)) as eid, min(kind) as kind from cand group by fid),
mt as (select fi.*, best.eid, case when best.fid is null then 'sec_only' when kind = 0 then 'fiscal_period_end' else 'nearest_filing_and_period' end as method from fi left join best on best.fid = fi.fid
   union all select ticker, null, null, null, null, null, null, null, null, eid, 'fmp_only' from est where eid not in (select eid from best))
"""


def _matched(t, least=None, most=None):
    """Estimates and matched filings; given bounds, at least all that decide on the tickers between them."""
    history, filings = estimate_history(t), user_filings(t)
    if least is not None:
        # A filing's match is chosen by its id over all tickers that have the id, and dates far off share an event id with the next ticker.
        fids = cut(filings.filter(F.col("ticker").between(least - 1, most + 1)).select(F.col("fid").alias("asked")).distinct())
        filings = cut(filings.join(fids, F.col("fid").eqNullSafe(F.col("asked")), "left_semi"))
        history = history.join(cut(filings.select("ticker").distinct()), "ticker", "left_semi")
    est = cut(_estimates(t, history))
    return est, e.match_filings(filings, est, keys=["ticker"], filing_id="fid", event_id="eid")


@workload("best_match_join", sql=f"with {MATCH} select ticker, fid, eid, method as match_method from mt")
def best_match_join(t):
    """Filings with their best estimate event, and the events left over."""
    _, d = _matched(t)
    return d.select("ticker", "fid", "eid", "match_method")


COMBINED = MATCH + """,
cb as (select mt.ticker, fid, mt.eid, method, pe, fd, sa, ni, assets, ed, et, ee, re, eobs, fobs, aobs2, safe, coalesce(es, ea) as eps, coalesce(rs, ra) as rev,
   case when es is not null then 'SEC' when ea is not null then 'FMP' end as se, case when rs is not null then 'SEC' when ra is not null then 'FMP' end as sr
   from mt left join est on est.eid = mt.eid),
cc as (select *, greatest(case when se = 'SEC' then sa else aobs2 end, case when sr = 'SEC' then sa else aobs2 end) as aav, coalesce(ed, fd) as dt from cb),
cd as (select *, greatest(aav, eobs) as sav, greatest(sa, eobs, aav, fobs) as rav, ticker || '|' || strftime(dt, '%Y-%m-%d') as event_id from cc),
comb as (select *, eps - ee as es1, (eps - ee) / nullif(abs(ee), 0) * 100 as es2, rev - re as rs1, (rev - re) / nullif(abs(re), 0) * 100 as rs2,
   row_number() over (partition by event_id order by rav nulls last, fd nulls last, fid nulls last) as revision from cd)
"""


def _combined(t, least=None, most=None):
    est, matched = _matched(t, least, most)
    est = est.withColumnsRenamed({"eps_actual": "eps_actual_vendor", "revenue_actual": "revenue_vendor", "actual_available": "vendor_actual_available"})
    d = matched.join(est.drop("ticker"), "eid", "left").withColumns({"fiscal_year": F.lit(None).cast("int"), "fiscal_quarter": F.lit(None).cast("string")})
    return e.combine(d, keys=["ticker"], tie=["fid"])


@workload("earn_combine", sql=f"""
with {COMBINED}
select ticker, fid, eid, event_id, round(eps, 6) as eps_actual, round(rev, 6) as revenue_actual, se as actual_source_eps, sr as actual_source_revenue, round(es1, 6) + 0 as eps_surprise,
  round(es2, 4) + 0 as eps_surprise_pct, round(rs1, 6) + 0 as revenue_surprise, strftime(aav, {TS}) as actual_available, strftime(sav, {TS}) as surprise_available, strftime(rav, {TS}) as record_available,
  cast(revision as bigint) as revision_number from comb
""")
def earn_combine(t):
    """Combined reports with sources, surprises, clocks and revision numbers."""
    d = _combined(t)
    return d.select("ticker", "fid", "eid", "event_id", "actual_source_eps", "actual_source_revenue", *rounded(d, ["eps_actual", "revenue_actual", "eps_surprise", "revenue_surprise"]),
                    r("eps_surprise_pct", 4).alias("eps_surprise_pct"), *[stamp(F.col(c)).alias(c) for c in ("actual_available", "surprise_available", "record_available")],
                    F.col("revision_number").cast("long").alias("revision_number"))


@workload("earn_pit_features", sql=f"""
with {COMBINED},
rows as (select event_id as row_id, user_id as ticker, ts, ts::date as today from events),
sch as (select r.row_id, c.*, row_number() over (partition by r.row_id, c.event_id order by c.ed, c.fobs) as k, r.today, r.ts from rows r join comb c on c.ticker = r.ticker and c.ed is not null and c.fobs <= r.ts),
nx as (select row_id, arg_min(struct_pack(ed := ed, et := et, eobs := eobs, safe := safe, ee := ee, re := re), (ed, fobs)) as n from sch where k = 1 and ed >= today group by row_id),
ls as (select row_id, max(ed) as ed from sch where k = 1 and ed <= today group by row_id),
fa as (select r.row_id, arg_max(ni, (sa, fd, coalesce(fid, -1))) as ni, arg_max(assets, (sa, fd, coalesce(fid, -1))) as assets from rows r join comb c on c.ticker = r.ticker and c.sa <= r.ts group by r.row_id),
ac as (select r.row_id, arg_max(struct_pack(eps := eps, rev := rev), (ed, aav, coalesce(fid, -1))) as a from rows r join comb c on c.ticker = r.ticker and c.aav <= r.ts and c.ed <= r.today group by r.row_id),
su as (select r.row_id, arg_max(struct_pack(eps := eps, rev := rev, ee := ee, re := re, es1 := es1, es2 := es2, rs1 := rs1, sav := sav), (ed, sav, coalesce(fid, -1))) as s from rows r
   join comb c on c.ticker = r.ticker and c.sav <= r.ts and c.ed <= r.today and c.safe group by r.row_id)
select r.row_id, date_diff('day', today, n.ed)::double as days_to_earnings, date_diff('day', ls.ed, today)::double as days_since_earnings, coalesce(n.ed = today, false)::double as earnings_event_today,
  coalesce(n.et = 'before_market_open', false)::double as earnings_time_bmo, coalesce(n.et = 'after_market_close', false)::double as earnings_time_amc,
  round(case when s is not null then s.ee when n.eobs <= ts and n.safe then n.ee end, 6) as eps_estimated, round(case when s is not null then s.eps else a.eps end, 6) as eps_actual,
  round(s.es1, 6) + 0 as eps_surprise, round(s.es2, 4) + 0 as eps_surprise_pct, round(case when s is not null then s.rev else a.rev end, 6) as revenue_actual, round(s.rs1, 6) + 0 as revenue_surprise,
  round(fa.ni, 6) as net_income, round(fa.assets, 6) as assets, case when s is not null then 1.0 when coalesce(n.eobs <= ts and n.safe, false) then 1.0 else 0.0 end::double as earnings_point_in_time_safe,
  round((epoch_us(ts) - epoch_us(s.sav)) / 86400000000.0::double, 6) as earnings_data_age_days
from rows r left join nx on nx.row_id = r.row_id left join ls on ls.row_id = r.row_id left join fa on fa.row_id = r.row_id left join ac on ac.row_id = r.row_id left join su on su.row_id = r.row_id
""")
def earn_pit_features(t):
    """Earnings features known at every row, each behind its own clock."""
    records = cut(_combined(t).withColumns({"liabilities": F.lit(None).cast("double"), "cash_flow": F.lit(None).cast("double")}))
    rows = t.events.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("ticker"), "ts")
    d = e.attach_features(rows, records, keys=["ticker"], ts="ts", tie="fid")
    return d.select("row_id", "days_to_earnings", "days_since_earnings", "earnings_event_today", "earnings_time_bmo", "earnings_time_amc", "earnings_point_in_time_safe",
                    *rounded(d, ["eps_estimated", "eps_actual", "eps_surprise", "revenue_actual", "revenue_surprise", "net_income", "assets", "earnings_data_age_days"]),
                    r("eps_surprise_pct", 4).alias("eps_surprise_pct"))
