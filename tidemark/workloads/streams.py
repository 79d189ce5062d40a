"""Queries that run a table as a file stream and read the sink back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import jobs
from tidemark.workloads.adapters import NEWS_TICKERS, k_of, r, rounded, stamp
from tidemark.workloads.registry import workload

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _events(t):
    return jobs.file_stream(t.spark, t.folder, "events.parquet")


@workload("stream_trade_minute", sql=f"""
select event_type as ticker, strftime(date_trunc('minute', ts), {TS}) as minute, count(*) as trade_count, sum(cast(json_extract_string(props, '$.k') as double)) as trade_volume,
  round(sum(value * cast(json_extract_string(props, '$.k') as double)), 4) as trade_dollar_volume from events
group by event_type, date_trunc('minute', ts) having date_trunc('minute', ts) + interval 1 minute <= (select max(ts) from events) - interval 1 hour
""")
def stream_trade_minute(t):
    """Minute aggregates of a trade stream, closed minutes only."""
    d = _events(t).select(F.col("event_type").alias("ticker"), "ts", "value", k_of().alias("k"))
    out = jobs.run_to_table(jobs.trade_minutes(d, keys=["ticker"], ts="ts", price="value", size="k"))
    return out.select("ticker", stamp(F.col("minute")).alias("minute"), "trade_count", "trade_volume", r("trade_dollar_volume", 4).alias("trade_dollar_volume"))


@workload("stream_news_sliding", sql=f"""
with n as (select (['click','error','purchase','signup','view'])[cast(doc_id % 5 + 1 as integer)] as ticker, timestamp '2024-01-01' + to_minutes(cast(doc_id * 43 as bigint)) as p, n_chars % 100 / 100.0::double as s from documents),
w as (select ticker, s, time_bucket(interval 15 minute, p) + to_minutes(cast(60 - 15 * g as bigint)) as window_end from n, range(4) r(g))
select ticker, strftime(window_end, {TS}) as window_end, count(*) as news_count, round(avg(s), 6) as sentiment from w
group by ticker, window_end having window_end <= (select max(p) from n) - interval 2 hour
""")
def stream_news_sliding(t):
    """Hourly news activity every quarter of an hour."""
    names = F.array(*[F.lit(x) for x in NEWS_TICKERS])
    d = jobs.file_stream(t.spark, t.folder, "documents.parquet").select(
        F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("ticker"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 43 * 60).alias("published"), (F.col("n_chars") % 100 / 100.0).alias("score"))
    out = jobs.run_to_table(jobs.news_activity(d, keys=["ticker"], ts="published", score="score"))
    return out.select("ticker", stamp(F.col("window_end")).alias("window_end"), "news_count", r("sentiment").alias("sentiment"))


@workload("stream_dedup", sql="""
select distinct sha256('{"day":"' || strftime(ts, '%Y-%m-%d') || '","event_type":"' || event_type || '","user_id":' || user_id || '}') as content_key from events
""")
def stream_dedup(t):
    """Each content taken in exactly once."""
    d = _events(t).select("ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id")
    return jobs.run_to_table(jobs.deduplicate(d, ts="ts", content=["day", "event_type", "user_id"], delay="2 days").select("content_key"))


@workload("stream_latest_state", sql="""
select user_id, epoch_us(max(ts + to_minutes(cast(json_extract_string(props, '$.k') as integer)))) as last_at,
  arg_max(event_id, (ts + to_minutes(cast(json_extract_string(props, '$.k') as integer)), event_id)) as last_id,
  arg_max(value, (ts + to_minutes(cast(json_extract_string(props, '$.k') as integer)), event_id)) as last_value, count(*) as seen from events group by user_id
""")
def stream_latest_state(t):
    """Latest value per contract by first-seen time, kept as state."""
    d = _events(t).select("user_id", "event_id", "value", F.timestamp_micros(F.unix_micros("ts") + k_of().cast("long") * 60_000_000).alias("available"))
    live = jobs.latest_known(d, key="user_id", value="value", available="available", order="event_id")
    folder = jobs.run_batches(live, lambda batch, n, path: batch.write.mode("overwrite").parquet(path), mode="update")
    out = t.spark.read.parquet(folder)
    newest = out.groupBy("user_id").agg(F.max_by(F.struct("last_at", "last_id", "last_value", "seen"), "batch").alias("s"))
    return newest.select("user_id", "s.*")


@workload("stream_monitor", sql="""
with rec as (
  select l_suppkey as book, l_orderkey as o, l_linenumber as l, l_discount - 0.04::double as e, l_tax - 0.045::double + (l_partkey % 7 - 3) / 100.0::double as a, least(greatest(l_discount * 8, 0), 1) as p,
    (l_partkey % 3 = 0)::integer as y, l_tax / 2 + 0.01::double as qc, l_discount / 4 as pc, l_discount + 0.02::double as sp, l_quantity as oi from lineitem),
cv as (select book, o, l, sum(ln(1 + greatest(a, -0.999))) over w as c from rec window w as (partition by book order by o, l rows unbounded preceding)),
pk as (select *, max(c) over (partition by book order by o, l rows unbounded preceding) as k from cv),
dd as (select book, max(1 - exp(c - k)) as dd from pk group by book),
ag as (select book, count(*) as rows, avg(a) as am, avg((p - y) ** 2) as brier, abs(avg(p) - avg(y)) as gap, sum(pc) / greatest(abs(sum(qc)), 1e-12) as cr, quantile_cont(sp, 0.95) as p95,
  median(oi) as moi, avg(a) / stddev_samp(a) * sqrt(252) as sharpe from rec group by book)
select book, rows, round(am, 6) as actual_pnl_mean, round(brier, 6) as brier, round(dd, 6) as maximum_drawdown, round(p95, 6) as p95_relative_spread, round(sharpe, 6) as actual_sharpe,
  array_to_string(list_sort(list_filter([case when rows >= 30 and am < 0 then 'negatieve_live_ev' end, case when dd > 0.12 then 'drawdown_limiet' end, case when rows >= 50 and gap > 0.12 then 'slechte_kalibratie' end,
    case when rows >= 20 and cr > 1.5 then 'execution_kosten_afwijking' end, case when rows >= 20 and p95 > 0.15 then 'uitzonderlijke_spreads' end, case when moi < 30 then 'liquiditeit_verslechterd' end],
    lambda x: x is not null)), '|') as triggers
from ag join dd using (book)
""")
def stream_monitor(t):
    """Monitoring of every book over a stream of records, as it stands after the last file."""
    d = jobs.file_stream(t.spark, t.folder, "lineitem.parquet", files_per_batch=1)
    d = d.select(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_orderkey") / 4096).alias("block"),
                 (F.col("l_discount") - 0.04).alias("expected_net_return"), (F.col("l_tax") - 0.045 + (F.col("l_partkey") % 7 - 3) / 100.0).alias("actual_net_return"),
                 (F.col("l_discount") * 8).alias("probability_positive"), (F.col("l_partkey") % 3 == 0).cast("double").alias("positive_outcome"),
                 (F.col("l_tax") / 2 + 0.01).alias("expected_cost_return"), (F.col("l_discount") / 4).alias("actual_cost_return"),
                 (F.col("l_discount") + 0.02).alias("relative_spread"), F.col("l_quantity").alias("open_interest"))
    out = t.spark.read.parquet(jobs.monitor_batches(d, keys=["book"], order=["at", "line"], bucket="block"))
    newest = out.groupBy("book").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("book", "batch")]), "batch").alias("s")).select("book", "s.*")
    return newest.select("book", "rows", F.array_join("triggers", "|").alias("triggers"),
                         *rounded(newest, ["actual_pnl_mean", "brier", "maximum_drawdown", "p95_relative_spread", "actual_sharpe"]))


@workload("stream_settle", sql="""
select o_orderkey as signal, l_linenumber as line, strftime(l_shipdate, '%Y-%m-%d') as settled, round(l_extendedprice / o_totalprice - 1, 6) as gross_return
from orders join lineitem on l_orderkey = o_orderkey and l_shipdate >= o_orderdate and l_shipdate <= o_orderdate + interval 200 day
""")
def stream_settle(t):
    """Signals and exits of two streams joined within a bounded time."""
    signals = jobs.file_stream(t.spark, t.folder, "orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    exits = jobs.file_stream(t.spark, t.folder, "lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    d = jobs.settle_stream(signals, exits, signal_time="o_orderdate", exit_time="l_shipdate", signal_key="o_orderkey", exit_key="l_orderkey",
                           within="200 days", delay="1 day")
    out = jobs.run_to_table(d)
    return out.select(F.col("o_orderkey").alias("signal"), F.col("l_linenumber").alias("line"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("settled"),
                      r(F.col("l_extendedprice") / F.col("o_totalprice") - 1).alias("gross_return"))
