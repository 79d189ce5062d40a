"""Queries that land raw files, split feeds by day, account for rows used and fold by rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from tidemark.operators import metrics, splits
from tidemark.sources import snapshots, usage
from tidemark.sources.inventory import expected_units
from tidemark.session import checkpoint_folder, cut
from tidemark.workloads.adapters import NEWS, SCORES, SESSIONS, day_text, news, r, research_scores, rounded, sessions
from tidemark.workloads.registry import Tables, workload

ORDER_LINES = StructType([StructField("o_orderkey", LongType()), StructField("o_orderdate", DateType()), StructField("o_totalprice", DoubleType())])


def _folder(t, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@workload("src_land_csv", sql="""
with o as (select date_trunc('month', o_orderdate) as m, o_totalprice as p, o_orderkey % 97 = 0 as bad from orders)
select strftime(m, '%Y-%m-%d') as day, count(*) as rows, round(sum(p), 2) as total from o where not bad group by m
union all select 'rejected', count(*), null from o where bad
""")
def src_land_csv(t):
    """Compressed CSV landed by month; every 97th line cannot be read and is kept as text."""
    raw, out = _folder(t, "csv"), _folder(t, "landed")
    bad = F.col("o_orderkey") % 97 == 0
    lines = t.orders.select(F.when(bad, "??").otherwise(F.col("o_orderkey").cast("string")).alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                            F.when(bad, "much").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    lines.write.option("header", "true").option("compression", "gzip").csv(raw)
    snapshots.land_csv(t.spark, raw, ORDER_LINES, out, day=F.trunc("o_orderdate", "month"))
    rows = t.spark.read.schema(StructType([*ORDER_LINES.fields, StructField("day", DateType())])).parquet(f"{out}/rows")
    good = rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")).select(day_text(F.col("day")).alias("day"), "rows", r("total", 2).alias("total"))
    rejects = t.spark.read.schema("file string, text string").parquet(f"{out}/rejects")
    return good.unionByName(rejects.agg(F.lit("rejected").alias("day"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("total")))


@workload("src_news_days", sql=f"""
with {NEWS},
n as (select ticker, cast(published as date) as day from news),
days as (select cast(d as date) as day from (select unnest(generate_series(min(day), max(day), interval 1 day)) as d from n) where dayofweek(d) between 1 and 5),
c as (select ticker, day, count(*) as rows from n group by all)
select t.ticker, strftime(days.day, '%Y-%m-%d') as day, coalesce(rows, 0) as rows, case when rows is null then 'verified_empty' else 'stored' end as status
from (select distinct ticker from n) t cross join days left join c on c.ticker = t.ticker and c.day = days.day
""")
def src_news_days(t):
    """All news split by publication day with a receipt for every ticker and weekday."""
    d = news(t).select("ticker", "published", "doc_id", "n_chars")
    span = d.agg(F.min(F.to_date("published")).alias("a"), F.max(F.to_date("published")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    receipts = snapshots.split_by_day(d, expected_units(d, days, ticker="ticker", day="day"), _folder(t, "news"), ticker="ticker", published="published")
    return receipts.select("ticker", day_text(F.col("day")).alias("day"), "rows", "status")


@workload("data_usage", sql=f"""
with {SESSIONS},
u as (select *, future_return is not null and past_return is not null as ok from sessions)
select count(*) as loaded_rows, count(*) filter (where ok) as eligible_rows, count(*) filter (where ok) as used_rows, strftime(min(day) filter (where ok), '%Y-%m-%d') as first_day,
  strftime(max(day) filter (where ok), '%Y-%m-%d') as last_day, 0 as capped_rows, false as hidden_row_cap_applied, count(distinct (ticker, day)) as catalog_ticker_days from u
""")
def data_usage(t):
    """Rows that a research run loads, could use and uses, counted while it runs."""
    t = Tables(usage.observing(t.spark), t.folder)
    seen, d = usage.Usage(), sessions(t)
    known = F.col("future_return").isNotNull() & F.col("past_return").isNotNull()
    cut(seen.watch(seen.watch(d, "load", day="day", usable=known).filter(known), "use", day="day"))
    out = usage.usage_report(seen.table(t.spark), d, ticker="ticker", day="day", eligible="load", used="use")
    return out.withColumns({c: day_text(F.col(c)) for c in ("first_day", "last_day")})


@workload("row_walk_forward", sql=f"""
with {SCORES},
p as (select *, row_number() over (order by day, ticker) - 1 as i, count(*) over () as n from scores),
g as (select n, greatest(30, cast(floor(n * 0.4) as bigint)) as first from (select count(*) as n from scores)),
w as (select n, first, greatest(20, (n - first) // 5) as width from g),
f as (select n, greatest(0, s - 5) as train_end, s as start, least(n, s + width) as stop from w, range(first, n, width) r(s)),
k as (select *, row_number() over (order by start) as fold from f where n >= 100 and train_end >= 30 and stop - start >= 10),
t as (select k.fold, k.train_end, p.probability as q, (p.actual_return > 0)::integer as y from k join p on p.i >= k.start and p.i < k.stop where k.fold <= 5),
rk as (select *, rank() over (partition by fold order by q) + (count(*) over (partition by fold, q) - 1) / 2.0::double as r from t)
select fold, any_value(train_end) as n_train, count(*) as n_test, round(avg((q - y) ** 2), 6) as brier, round(avg(((q >= 0.5) = (y > 0))::integer), 6) as accuracy,
  round((avg((q >= 0.5)::integer) filter (where y = 1) + avg((q < 0.5)::integer) filter (where y = 0)) / 2, 6) as balanced_accuracy,
  round((sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))), 6) as auc from rk group by fold
""")
def row_walk_forward(t):
    """Folds by rows over the whole table, and how a given probability scores on each."""
    d = cut(splits.row_walk_forward(research_scores(t).withColumn("up", (F.col("actual_return") > 0).cast("double")), order=["day", "ticker"], bucket="day"))
    scores = metrics.fold_scores(d.filter(F.col("role") == "test"), keys=["fold"], actual="up", predicted="probability", binary=True)
    train = d.filter(F.col("role") == "train").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
    out = scores.join(train, "fold")
    return out.select("fold", "n_train", "n_test", *rounded(out, ["brier", "accuracy", "balanced_accuracy", "auc"]))
