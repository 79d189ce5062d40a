"""Queries over saved models: fit, calibrate per horizon, save, load, score a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import scoring, splits, targets
from tidemark.operators.relationships import joint_state
from tidemark.session import checkpoint_folder, cut
from tidemark.workloads.adapters import SESSIONS, day_text, r, rounded, sessions
from tidemark.workloads.registry import workload

FEATURES = ["call_extrinsic", "put_extrinsic", "f_discount", "f_tax", "f_quantity", "past_return"]
PARTS = {"train": 0.55, "calibration": 0.2, "test": 0.25}
TREES = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.2, "seed": 42}


def _pairs(t):
    """sessions as pairs: time values of both sides from discount and tax."""
    return sessions(t).withColumns({"call_extrinsic": F.col("px") * (F.col("f_discount") + 0.01), "put_extrinsic": F.col("px") * (F.col("f_tax") + 0.01)})


def _targets(t):
    """The pairs at every session horizon with the later moves and a part of the calendar."""
    d = targets.session_targets(_pairs(t), keys=["ticker"], day="day", take={"px": "px_then", "call_extrinsic": "call_then", "put_extrinsic": "put_then"})
    move = lambda now, then: targets.return_between(F.col(now), F.col(then))
    d = d.withColumns({"future_stock_return": move("px", "px_then"), "future_call_extrinsic_return": move("call_extrinsic", "call_then"), "future_put_extrinsic_return": move("put_extrinsic", "put_then")})
    return splits.time_partitions(d, day="day", shares=PARTS, purge=5)


_TARGETS = SESSIONS + """,
px as (select ticker, day, px, px * (f_discount + 0.01::double) as c, px * (f_tax + 0.01::double) as p from sessions),
ahead as (select *, unnest([struct_pack(h := 'D1', d := lead(day, 1) over w, g := 4), struct_pack(h := 'D2', d := lead(day, 2) over w, g := 5),
  struct_pack(h := 'D3', d := lead(day, 3) over w, g := 7), struct_pack(h := 'W1', d := lead(day, 5) over w, g := 10)]) as s from px window w as (partition by ticker order by day)),
tg as (select a.ticker, a.day, a.s.h as horizon, f.c / nullif(a.c, 0) - 1 as rc, f.p / nullif(a.p, 0) - 1 as rp from ahead a join px f on f.ticker = a.ticker and f.day = a.s.d where date_diff('day', a.day, a.s.d) <= a.s.g),
cal as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from tg)),
parts as (select tg.*, case when i < floor(n * 0.55) then case when i < floor(n * 0.55) - 5 then 'train' else 'purged' end
  when i < floor(n * 0.75) then case when i < floor(n * 0.75) - 5 then 'calibration' else 'purged' end else 'test' end as part from tg join cal using (day))
"""


@workload("state_calibration", sql=f"""
with {_TARGETS},
st as (select horizon, case when rc > 0 and rp <= 0 then 'call_up_put_down' when rc <= 0 and rp > 0 then 'call_down_put_up' when rc > 0 and rp > 0 then 'both_up' when rc <= 0 and rp <= 0 then 'both_down' end as state
  from parts where part = 'calibration')
select horizon as target_horizon, s.state, count(*) as n, round(avg((st.state = s.state)::integer), 6) as mean_probability
from st, (select unnest(['call_up_put_down', 'call_down_put_up', 'both_up', 'both_down']) as state) s where st.state is not null group by all
""")
def state_calibration(t):
    """Calibrators of four outcomes, fitted together for all horizons: their mean probability is each outcome's share."""
    d = _targets(t).filter(F.col("part") == "calibration").withColumn("state", joint_state(F.col("future_call_extrinsic_return"), F.col("future_put_extrinsic_return")))
    label = F.array_position(F.array(*[F.lit(s) for s in scoring.STATES]), F.col("state")).cast("int") - 1
    score = [F.col("f_discount") + 0.01, F.col("f_tax") + 0.01, F.col("f_quantity") / 1000, F.abs("past_return") + 0.01]
    total = sum(score[1:], score[0])
    d = cut(d.filter(F.col("state").isNotNull()).select("target_horizon", label.alias("label"), *[F.coalesce(s / total, F.lit(0.25)).alias(f"raw_{i}") for i, s in enumerate(score)]))
    raw = [f"raw_{i}" for i in range(4)]
    table = scoring.calibrators(d, key="target_horizon", raw=raw, label="label", classes=4)
    p = scoring.calibrated([F.col(c) for c in raw], F.col("theta"), 4)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), x.alias("p")) for s, x in zip(scoring.STATES, p)]))
    out = d.join(table, "target_horizon").select("target_horizon", each.alias("e")).groupBy("target_horizon", F.col("e.state").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.avg("e.p").alias("m"))
    return out.select("target_horizon", "state", "n", r("m").alias("mean_probability"))


def _evidence(t):
    """A fixed table of bins, so that what follows from scores can be told in SQL."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("b")
    d = t.spark.range(1).select(bins).filter(F.col("b") % 4 != 3).withColumn("side", F.explode(F.array(F.lit("call"), F.lit("put")))).withColumn("target_horizon", F.explode(F.array(F.lit("D1"), F.lit("W1"))))
    n = F.col("b") * 20 + F.length("side") * 10
    none = F.lit(None).cast("double")
    return d.select("side", "target_horizon", (F.col("b") / 10.0).alias("bin_low"), ((F.col("b") + 1) / 10.0).alias("bin_high"), (F.col("b") / 10.0 + 0.05).alias("mean_predicted_probability"), n.cast("long").alias("n"),
                    (F.col("b") / 10.0 + 0.02).alias("observed_positive_rate"), (F.col("b") / 10.0 - 0.05).alias("ci95_low"), (F.col("b") / 10.0 + 0.1).alias("ci95_high"), *[none.alias(c) for c in scoring.EVIDENCE[4:]])


@workload("score_rules", sql=f"""
with {SESSIONS},
b as (select b, b * 20 + l * 10 as n, l, h from range(10) r(b), (values (4), (3)) s(l), (values ('D1'), ('W1')) t(h) where b % 4 <> 3),
x as (select ticker, day, h, px * (f_discount + 0.01::double) as c, px * (f_tax + 0.01::double) as p, 20 * f_discount - 1 as rc, 20 * f_tax - 0.8::double as rp, least(greatest(f_discount * 10, 0), 1) as pc,
  least(greatest(0.9::double - f_tax * 8, 0), 1) as pp from sessions, (values ('D1'), ('D3'), ('W1')) t(h)),
e as (select x.*, row_number() over (partition by ticker, day, x.h, l order by case when pr >= b / 10.0::double and (pr < (b + 1) / 10.0::double or (b = 9 and pr <= 1)) then 0 else 1 end, abs(b / 10.0::double + 0.05::double - pr), b / 10.0::double) as k, b, n, l
  from (select *, unnest([4, 3]) as side from x) x left join b on b.h = x.h and b.l = x.side, lateral (select case when side = 4 then pc else pp end as pr) q),
w as (select ticker, day, h, any_value(c) as c, any_value(p) as p, any_value(rc) as rc, any_value(rp) as rp, any_value(pc) as pc, any_value(pp) as pp, max(n) filter (where l = 4 and k = 1) as cn, max(n) filter (where l = 3 and k = 1) as pn,
  max(b) filter (where l = 4 and k = 1) as cb, max(b) filter (where l = 3 and k = 1) as pb from e group by all),
z as (select *, case when abs(c) > 1e-9 then (c * (1 + rc) - c) / c end as ce, case when abs(p) > 1e-9 then (p * (1 + rp) - p) / p end as pe from w),
y as (select *, greatest(ce, 0) * pc as cs, greatest(pe, 0) * pp as ps, greatest(pc, pp) > 0.5 and case when pc >= pp then ce else pe end > 0 as pcase from z)
select ticker, strftime(day, '%Y-%m-%d') as day, h as target_horizon, coalesce(cn, 0) as call_evidence_n, round(cb / 10.0::double + 0.02::double, 6) as call_evidence_hit_rate,
  case when pc >= pp then 'CALL' else 'PUT' end as best_profit_side, coalesce(pcase, false) as paper_profit_case,
  coalesce(pcase and case when pc >= pp then coalesce(cn, 0) else coalesce(pn, 0) end >= 50 and case when pc >= pp then cb else pb end / 10.0::double + 0.02::double > 0.5, false) as paper_profit_empirically_supported,
  case when ce > 0 and pc >= 0.6 and cs >= ps then 'CALL_EDGE' when pe > 0 and pp >= 0.6 and ps > cs then 'PUT_EDGE' else 'NO_EDGE' end as paper_signal,
  round(case when ce > 0 and pc >= 0.6 and cs >= ps then cs when pe > 0 and pp >= 0.6 and ps > cs then ps else greatest(cs, ps, 0) end, 6) as paper_opportunity_score from y
""")
def score_rules(t):
    """Evidence, edges and signals that follow from given returns and probabilities at three horizons."""
    d = _pairs(t).withColumn("target_horizon", F.explode(F.array(*[F.lit(h) for h in ("D1", "D3", "W1")])))
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    d = d.withColumns({"call_return": 20 * F.col("f_discount") - 1, "put_return": 20 * F.col("f_tax") - 0.8, "prob_call_gross_profit": inside(F.col("f_discount") * 10),
                       "prob_put_gross_profit": inside(0.9 - F.col("f_tax") * 8), **{f"prob_{s}": F.lit(0.25) for s in scoring.STATES}})
    out = scoring.finish_scores(d, _evidence(t))
    return out.select("ticker", day_text(F.col("day")).alias("day"), "target_horizon", "call_evidence_n", "best_profit_side", "paper_profit_case", "paper_profit_empirically_supported", "paper_signal",
                      *rounded(out, ["call_evidence_hit_rate", "paper_opportunity_score"]))


@workload("score_horizons")
def score_horizons(t):
    """Every session of every ticker scored at all session horizons by a model that was fitted, saved and loaded; the best hundred of each."""
    path = f"{checkpoint_folder(t.spark)}/bundle-{uuid.uuid4().hex}"
    scoring.fit(_targets(t).filter(F.col("part") != "purged"), features=FEATURES, part="part", trees=TREES).save(path)
    scored = scoring.score_horizons(_pairs(t), scoring.Bundle.load(t.spark, path), horizons=("D1", "D2", "D3", "W1"))
    out = scoring.best_opportunities(scored, n=100)
    return out.select("ticker", day_text(F.col("day")).alias("day"), "target_horizon", "best_profit_side", "paper_signal", "most_likely_state", "call_evidence_n", *rounded(out, [
        "model_expected_call_extrinsic", "call_gross_edge_pct", "prob_call_gross_profit", "prob_put_gross_profit", "prob_stock_up", "most_likely_state_probability", "paper_opportunity_score"]))
