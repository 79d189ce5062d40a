"""Queries over condition flags, pattern mining and pattern priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import relationships as rel
from tidemark.operators import splits
from tidemark.operators.ordered import exact_quantiles
from tidemark.session import cut
from tidemark.workloads.adapters import SESSIONS, day_text, r, rounded, sessions
from tidemark.workloads.registry import workload


def research_pairs(t):
    """sessions with the column names of pair research rows."""
    d = sessions(t).filter(F.col("past_return").isNotNull() & F.col("future_return").isNotNull())
    c5 = F.col("past_return")
    p5 = F.col("past_return") * -0.8 + (F.col("f_discount") - 0.05) * 4
    of = lambda k: (F.col("f_count") % k == 0).cast("double")
    return d.select(
        "ticker", "day", c5.alias("call_option_return_5m"), p5.alias("put_option_return_5m"),
        F.col("f_discount").alias("call_expectation_gap"), F.col("f_tax").alias("put_expectation_gap"),
        ((F.col("f_quantity") - 25.5) / 5).alias("sentiment_60m"), (F.col("f_count") % 4).alias("news_count_60m"),
        (F.col("f_discount") * 6).alias("emotion_60m"), (F.col("f_tax") * 8).alias("surprise_60m"),
        of(5).alias("earnings_news_60m"), of(7).alias("guidance_news_60m"), of(3).alias("analyst_news_60m"),
        of(11).alias("legal_regulatory_news_60m"), (F.dayofmonth("day") - 10).cast("double").alias("days_to_earnings"),
        F.pow(F.col("f_quantity") / 25, 3).alias("call_put_volume_ratio"), (F.col("past_return") / 10).alias("stock_return_30m"),
        (c5 - p5).alias("call_put_return_divergence_5m"), (F.col("f_quantity") - 25.5).alias("put_call_parity_residual"),
        F.col("future_return").alias("future_stock_return"),
        (F.col("future_return") * 1.5 + F.col("f_discount") - 0.05).alias("future_call_extrinsic_return"),
        (F.col("future_return") * -1 + (F.col("f_tax") - 0.04) * 3).alias("future_put_extrinsic_return"))


OUTCOME = {"stock": "future_stock_return", "call": "future_call_extrinsic_return", "put": "future_put_extrinsic_return"}

RP = SESSIONS + """,
rp0 as (select ticker, day, past_return as c5, past_return * -0.8::double + (f_discount - 0.05::double) * 4 as p5, f_discount as cg, f_tax as pg,
   (f_quantity - 25.5::double) / 5 as s, f_count % 4 as nc, f_discount * 6 as em, f_tax * 8 as su, f_count as k,
   cast(day(day) - 10 as double) as due, pow(f_quantity / 25, 3) as vr, past_return / 10 as mo, f_quantity - 25.5::double as par,
   future_return as fs, future_return * 1.5::double + f_discount - 0.05::double as fc, future_return * -1 + (f_tax - 0.04::double) * 3 as fp
   from sessions where past_return is not null and future_return is not null),
calr as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from rp0)),
rp as (select rp0.*, c5 - p5 as dv, case when i < floor(n * 0.6) then 'discovery' when i < floor(n * 0.8) then 'validation' else 'holdout' end as part
       from rp0 join calr using (day)),
th as (select quantile_cont(cg, 0.8) as ch, quantile_cont(cg, 0.2) as cl, quantile_cont(pg, 0.8) as ph, quantile_cont(pg, 0.2) as pl,
         quantile_cont(dv, 0.8) as dh, quantile_cont(dv, 0.2) as dl, quantile_cont(abs(par), 0.9) as pa from rp where part = 'discovery'),
masked as (select rp.*, list_sum(list_transform([
   c5 > 0.01 and p5 < -0.01, c5 < -0.01 and p5 > 0.01, c5 > 0.01 and p5 > 0.01, c5 < -0.01 and p5 < -0.01,
   cg >= ch, cg <= cl, pg >= ph, pg <= pl, s >= 0.2, s <= -0.2, nc >= 2, em >= 0.35, su >= 0.35,
   k % 5 = 0, k % 7 = 0, k % 3 = 0, k % 11 = 0, due between 0 and 5, vr >= 2, vr <= 0.5, mo >= 0.005, mo <= -0.005,
   dv >= dh, dv <= dl, abs(par) >= pa], lambda b, i: case when b then (1::bigint << (i - 1)) else 0::bigint end))::bigint as mask,
   case when fc > 0 and fp <= 0 then 's1' when fc <= 0 and fp > 0 then 's2' when fc > 0 and fp > 0 then 's3' else 's4' end as state
   from rp, th)
"""


def _masked(t):
    d = splits.time_partitions(research_pairs(t), day="day", shares={"discovery": 0.6, "validation": 0.2, "holdout": 0.2})
    return cut(rel.add_conditions(d, rel.learn_thresholds(d.filter(F.col("part") == "discovery"))))


@workload("rel_conditions", sql=f"""
with {RP} select ticker, strftime(day, '%Y-%m-%d') as day, part, mask, cast(bit_count(mask) as bigint) as conditions from masked
""")
def rel_conditions(t):
    """25 condition flags per row as a bit mask, thresholds learned on discovery rows."""
    return _masked(t).select("ticker", day_text(F.col("day")).alias("day"), "part", "mask",
                             F.bit_count("mask").cast("long").alias("conditions"))


@workload("state_stats", sql=f"""
with {RP},
x as (select part, unnest(list_filter(range(25), lambda b: (mask & (1::bigint << b)) != 0)) as bit, fs, fc, fp, state from masked),
base as (select part, avg((fs > 0)::integer) as b from masked group by part),
g as (select part, bit, count(*) as n, count(*) filter (fs > 0) as up, avg(fs) as m, median(fs) as md, avg(fc) as mc, avg(fp) as mp,
        avg((state = 's1')::integer) as s1, avg((state = 's2')::integer) as s2, avg((state = 's3')::integer) as s3, avg((state = 's4')::integer) as s4 from x group by all),
w as (select *, up / n as p, 1 + 1.96 * 1.96 / n as den from g)
select w.part, bit, n as support, round(p, 6) as prob_stock_up,
  round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / den - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n) / den), 6) as ci_low,
  round(least(1, (p + 1.96 * 1.96 / (2 * n)) / den + 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n) / den), 6) as ci_high,
  round(p - b, 6) as lift, round(m, 6) as mean_stock_return, round(md, 6) as median_stock_return, round(mc, 6) as mean_call_return,
  round(mp, 6) as mean_put_return, round(s1, 6) as prob_call_up_put_down, round(s2, 6) as prob_call_down_put_up,
  round(s3, 6) as prob_both_up, round(s4, 6) as prob_both_down
from w join base on base.part = w.part
""")
def state_stats(t):
    """Outcome probabilities, interval, lift, mean and median return per condition."""
    d = _masked(t)
    base = d.groupBy("part").agg(F.avg((F.col("future_stock_return") > 0).cast("double")).alias("_base"))
    fanned = d.select("part", *OUTCOME.values(), F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(24)), lambda b: F.col("mask").bitwiseAND(
            F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(25)]), b + 1)) != 0)).alias("bit"))
    sums = rel.outcome_sums(fanned, keys=["part", "bit"], **OUTCOME).join(base, "part")
    stats = rel.outcome_stats(sums, keys=["part", "bit"], baseline=F.col("_base"))
    medians = exact_quantiles(fanned, keys=["part", "bit"], value="future_stock_return",
                              probabilities={"median_stock_return": 0.5}).drop("n")
    out = stats.join(medians, ["part", "bit"])
    return out.select("part", F.col("bit").cast("long").alias("bit"), "support", *rounded(out, [
        "prob_stock_up", "ci_low", "ci_high", "lift", "mean_stock_return", "median_stock_return", "mean_call_return",
        "mean_put_return", "prob_call_up_put_down", "prob_call_down_put_up", "prob_both_up", "prob_both_down"]))


_MINED = RP + """,
bits as (select ticker, day, part, fs, state, 1::bigint << unnest(list_filter(range(25), lambda b: (mask & (1::bigint << b)) != 0)) as v
         from masked where part <> 'holdout'),
subs as (select part, fs, state, v as pattern from bits union all
         select a.part, a.fs, a.state, a.v | b.v from bits a join bits b on a.ticker = b.ticker and a.day = b.day and b.v > a.v union all
         select a.part, a.fs, a.state, a.v | b.v | c.v from bits a join bits b on a.ticker = b.ticker and a.day = b.day and b.v > a.v
            join bits c on a.ticker = c.ticker and a.day = c.day and c.v > b.v),
agg as (select pattern, part, count(*) as n, avg((fs > 0)::integer) as p, avg(fs) as m, avg((state = 's1')::integer) as s1,
          avg((state = 's2')::integer) as s2, avg((state = 's3')::integer) as s3, avg((state = 's4')::integer) as s4 from subs group by all),
bp as (select avg((fs > 0)::integer) as b from masked where part = 'validation'),
mined as (select v.pattern, d.n as dn, v.n as support, v.p, v.m, v.p - b as lift, v.s1, v.s2, v.s3, v.s4,
   abs(v.p - b) * sqrt(v.n) + greatest(0, greatest(v.s1, v.s2, v.s3, v.s4) - 0.25) * sqrt(v.n) * 0.5 as score
   from agg v join agg d on d.pattern = v.pattern and d.part = 'discovery' and d.n >= 100, bp where v.part = 'validation' and v.n >= 40),
top as (select * from mined)
"""


def _mined(masked):
    return rel.mine_patterns(masked, part="part", **OUTCOME)


@workload("itemset_mining", sql=f"""
with {_MINED}
select pattern, cast(bit_count(pattern) as bigint) as "order", dn as discovery_support, support, round(p, 6) as prob_stock_up, round(lift, 6) as lift,
       round(m, 6) as mean_stock_return, case when m > 0 then 'up' when m < 0 then 'down' else 'flat' end as direction, round(score, 6) as score
from mined
""")
def itemset_mining(t):
    """Condition sets of up to three that hold in discovery and validation."""
    d = _mined(_masked(t))
    return d.select("pattern", F.col("order").cast("long").alias("order"), "discovery_support", "support", "direction",
                    *rounded(d, ["prob_stock_up", "lift", "mean_stock_return", "score"]))


@workload("pattern_priors", sql=f"""
with {_MINED},
j as (select m.ticker, m.day, t.*, sqrt(greatest(t.support, 1)) as w from masked m left join top t on (m.mask & t.pattern) = t.pattern)
select ticker, strftime(day, '%Y-%m-%d') as day, count(pattern) as relationship_match_count,
  round(coalesce(sum(s1 * w) / sum(w), 0.25), 6) as relationship_prior_call_up_put_down, round(coalesce(sum(s2 * w) / sum(w), 0.25), 6) as relationship_prior_call_down_put_up,
  round(coalesce(sum(s3 * w) / sum(w), 0.25), 6) as relationship_prior_both_up, round(coalesce(sum(s4 * w) / sum(w), 0.25), 6) as relationship_prior_both_down,
  round(coalesce(sum(p * w) / sum(w), 0.5), 6) as relationship_prior_stock_up, round(coalesce(sum(abs(lift) * w) / sum(w), 0), 6) as relationship_strength
from j group by ticker, day
""".replace("sum(w)", "sum(case when pattern is not null then w end)"))
def pattern_priors(t):
    """Empirical priors per row from its matched patterns."""
    masked = _masked(t)
    d = rel.add_pattern_priors(masked.select("ticker", "day", "mask"), rel.strongest(_mined(masked)))
    return d.select("ticker", day_text(F.col("day")).alias("day"), F.col("relationship_match_count").cast("long").alias("relationship_match_count"),
                    *rounded(d, [c for c in d.columns if c.startswith("relationship_prior") or c == "relationship_strength"]))


@workload("pattern_explain", sql=f"""
with {_MINED},
j as (select m.ticker, m.day, t.pattern, t.support, t.score, t.p,
        row_number() over (partition by m.ticker, m.day order by round(t.score, 9) desc, t.pattern) as position
      from masked m join top t on (m.mask & t.pattern) = t.pattern)
select ticker, strftime(day, '%Y-%m-%d') as day, position, pattern, support, round(score, 6) as score, round(p, 6) as prob_stock_up from j where position <= 8
""")
def pattern_explain(t):
    """The eight strongest matched patterns of every row: a report, so the caller asks for a number."""
    masked = _masked(t)
    d = rel.explain(masked.select("ticker", "day", "mask"), rel.strongest(_mined(masked)), limit=8)
    return d.select("ticker", day_text(F.col("day")).alias("day"), F.col("position").cast("long").alias("position"),
                    "pattern", "support", r("score").alias("score"), r("prob_stock_up").alias("prob_stock_up"))
