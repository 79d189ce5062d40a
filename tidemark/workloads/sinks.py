"""Queries that write results to their sinks and read them back, and clocks and probabilities on the way there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.pricing import ERF_COEFFICIENTS, ERF_P, probability_above
from tidemark.operators import earnings, risk, targets
from tidemark.session import checkpoint_folder
from tidemark.sources import results
from tidemark.workloads.adapters import SCORES, SESSIONS, day_text, r, research_scores, rounded, sessions, stamp
from tidemark.workloads.registry import workload
from tidemark.workloads.risk import _DECIDED, candidates

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _folder(t, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@workload("label_sink", sql=f"""
with {SESSIONS},
ahead as (select ticker, day, px, unnest([struct_pack(h := 'D1', d := lead(day, 1) over w, p := lead(px, 1) over w, g := 4), struct_pack(h := 'D2', d := lead(day, 2) over w, p := lead(px, 2) over w, g := 5),
  struct_pack(h := 'D3', d := lead(day, 3) over w, p := lead(px, 3) over w, g := 7), struct_pack(h := 'W1', d := lead(day, 5) over w, p := lead(px, 5) over w, g := 10)]) as s from sessions window w as (partition by ticker order by day))
select s.h as horizon, ticker, strftime(date_trunc('year', day), '%Y-%m-%d') as day, count(*) as labels, round(avg(s.p / nullif(px, 0) - 1), 6) + 0 as mean_return
from ahead where s.d is not null and date_diff('day', day, s.d) <= s.g group by all
""")
def label_sink(t):
    """Session labels stored apart from inputs by horizon, ticker and year, written twice and read back once."""
    d = targets.session_targets(sessions(t).select("ticker", "day", "px"), keys=["ticker"], day="day", take={"px": "px_then"})
    labels = d.select(F.col("target_horizon").alias("horizon"), "ticker", F.trunc("day", "year").alias("day"), F.col("day").alias("session"), targets.return_between(F.col("px"), F.col("px_then")).alias("label"))
    path = _folder(t, "labels")
    for _ in range(2):  # a repeat replaces its own partitions
        results.write_labels(labels, path)
    back = t.spark.read.schema(labels.schema).parquet(path)
    out = back.groupBy("horizon", "ticker", "day").agg(F.count("label").alias("labels"), F.avg("label").alias("m"))
    return out.select("horizon", "ticker", day_text(F.col("day")).alias("day"), "labels", r("m").alias("mean_return"))


@workload("experiment_sink", sql=f"""
with {SCORES}
select 'second' as run_id, ticker, count(*) as n, round(avg(actual_return - cost), 6) + 0 as net from scores where trade group by ticker
""")
def experiment_sink(t):
    """Two runs appended under their own ids; the newest is read back."""
    d, path = research_scores(t), _folder(t, "runs")
    for run, rows in (("first", d), ("second", d.filter("trade"))):
        results.append_run(rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("actual_return") - F.col("cost")).alias("net")), path, run_id=run)
    return results.latest_run(t.spark, path).select("run_id", "ticker", "n", r("net").alias("net"))


@workload("paper_signal_sink", sql=f"""
with {_DECIDED}
select supplier, part, contracts, case when allowed then 'OPEN' else 'REJECTED' end as execution_status, 'paper' as mode, false as live_capital_used,
  'paper-20240102-' || left(sha256('{{"supplier":' || supplier || ',"part":' || part || ',"decision":"' || case when allowed then 'TRADE' else 'NO_TRADE' end || '","contracts":' || contracts || '}}'), 16) as signal_id from decided
""")
def paper_signal_sink(t):
    """Paper signals of every decision, open or rejected, appended and read back."""
    made = risk.paper_signals(risk.evaluate_risk(candidates(t)), key=["supplier", "part"], created=F.lit("2024-01-02 15:00:00").cast("timestamp"))
    path = _folder(t, "signals")
    made.select("supplier", "part", "contracts", "execution_status", "mode", "live_capital_used", "signal_id").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


def _above(threshold: float) -> str:
    """P(return > threshold) in SQL with the library's error function."""
    x = f"((expected_return - {threshold}::double) / 0.02::double / sqrt(2.0::double))"
    k = f"(1.0::double / (1.0::double + {ERF_P} * abs{x}))"
    poly = "0.0::double"
    for a in reversed(ERF_COEFFICIENTS):
        poly = f"(({poly} + ({a})::double) * k)"
    return f"(select 0.5 * (1 + sign(x) * (1 - {poly} * exp(-x * x))) from (select {x} as x, {k} as k))"


@workload("return_probabilities", sql=f"""
with {SCORES}
select ticker, strftime(day, '%Y-%m-%d') as day, round({_above(0.0)}, 6) as probability_positive, round({_above(0.01)}, 6) as probability_above_1pct from scores
""")
def return_probabilities(t):
    """Chances of a gain and of a gain over one per cent, given a forecast and its spread."""
    d = research_scores(t).withColumns({"probability_positive": probability_above(F.col("expected_return"), F.lit(0.02)), "probability_above_1pct": probability_above(F.col("expected_return"), F.lit(0.02), 0.01)})
    return d.select("ticker", day_text(F.col("day")).alias("day"), *rounded(d, ["probability_positive", "probability_above_1pct"]))


@workload("filing_clock", sql=f"""
select o_custkey as company, 'A' || o_orderkey as accn, strftime(o_orderdate, '%Y-%m-%d') as filing_date, case when o_orderkey % 3 = 0 then '10-K' else '10-Q' end as form,
  strftime(case when o_orderkey % 5 = 0 then o_orderdate::date + interval 1 day else o_orderdate::date + interval 17 hour + to_minutes(cast(o_orderkey % 200 as bigint)) end, {TS}) as available
from orders
""")
def filing_clock(t):
    """When each filing of the companies' submission lists became known: at acceptance, else the midnight after its date."""
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.to_date("o_orderdate").cast("timestamp")) + 17 * 3600 + F.col("o_orderkey") % 200 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.struct(F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(at).alias("t"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                   F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("10-Q").alias("f"))
    lists = t.orders.groupBy(F.col("o_custkey").alias("company")).agg(F.collect_list(row).alias("x"))
    recent = F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.t").alias("acceptanceDateTime"), F.col("x.d").alias("filingDate"), F.col("x.d").alias("reportDate"), F.col("x.f").alias("form"))
    lists = lists.select("company", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    d = earnings.acceptance_clock(lists, keys=["company"], json="json")
    return d.select("company", "accn", day_text(F.col("filing_date")).alias("filing_date"), "form", stamp(earnings.filing_available(F.col("accepted"), F.col("filing_date"))).alias("available"))
