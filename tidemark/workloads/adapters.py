"""How the given tables stand in for market data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.functions.clock import day_text, stamp  # noqa: F401  (re-exported)
from tidemark.workloads.registry import Tables


def r(column, digits: int = 6):
    """Round half away from zero in binary floating point, as the SQL engine does,
    so both sides round the same double the same way."""
    column = (F.col(column) if isinstance(column, str) else column).cast("double")
    scale = F.lit(float(10 ** digits))
    return F.round(column * scale) / scale + F.lit(0.0)


def rounded(frame: DataFrame, names: list[str], digits: int = 6) -> list:
    return [r(F.col(n), digits).alias(n) for n in names]


def k_of(props="props"):
    return F.get_json_object(props, "$.k").cast("double")


# ---------------------------------------------------------------- minute bars
def bars(t: Tables) -> DataFrame:
    """events as stock trades: ticker = event_type, one bar per minute."""
    at = F.struct("ts", "event_id")
    return (
        t.events.select("event_type", "ts", "event_id", "value", k_of().alias("k"))
        .groupBy(F.col("event_type").alias("ticker"), F.date_trunc("minute", "ts").alias("ts"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
             F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum("k").alias("volume"),
             F.count(F.lit(1)).cast("double").alias("transactions"))
        .withColumn("day", F.to_date("ts"))
    )


BARS = """
bars as (
  select event_type as ticker, date_trunc('minute', ts) as ts, date_trunc('day', ts) as day,
         arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
         arg_max(value, (ts, event_id)) as close,
         sum(cast(json_extract_string(props, '$.k') as double)) as volume,
         cast(count(*) as double) as transactions
  from events group by all)
"""

# --------------------------------------------------------- irregular quotes/ticks
def ticks(t: Tables) -> DataFrame:
    """events as contract prices: contract = user_id, side = event_type."""
    return t.events.select("event_id", F.col("user_id").alias("contract"), F.col("event_type").alias("side"),
                           "ts", "value", F.to_date("ts").alias("day"))


TICKS = """
ticks as (select event_id, user_id as contract, event_type as side, ts, value,
                 date_trunc('day', ts) as day from events)
"""


# ------------------------------------------------------------------- trades
def trades(t: Tables) -> DataFrame:
    """lineitem as option trades of a supplier; the minute is spread over the order day."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = t.orders.select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("ticker"), F.col("l_orderkey").alias("trade_id"),
        F.col("l_linenumber").alias("part"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("l_orderkey") % 97 * 17).alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"))


TRADES = """
trades as (select l_suppkey as ticker, l_orderkey as trade_id, l_linenumber as part,
                  o_orderdate + to_seconds(cast((l_orderkey % 97) * 17 as integer)) as ts,
                  l_extendedprice / l_quantity as price, l_quantity as size
           from lineitem join orders on l_orderkey = o_orderkey)
"""


# -------------------------------------------------------------- option quotes
def options_px(t: Tables) -> DataFrame:
    """lineitem as priced option rows: spot, strike, days to expiry, volatility."""
    spot = F.col("l_extendedprice") / F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", spot.alias("spot"),
        (F.floor(spot * (F.lit(0.85) + F.lit(0.05) * F.col("l_linenumber")) * 20.0) / 20.0).alias("strike"),
        (F.col("l_orderkey") % 180 + 1).cast("double").alias("dte"),
        (F.lit(0.1) + F.lit(5.0) * F.col("l_discount")).alias("sigma"),
        F.col("l_tax").alias("rate"), (spot * (F.lit(0.02) + F.col("l_tax"))).alias("price"),
        F.when(F.col("l_linenumber") % 2 == 1, "call").otherwise("put").alias("option_type"),
        F.col("l_quantity").alias("volume"))


OPTIONS_PX = """
options_px as (
  select l_orderkey, l_linenumber, l_extendedprice / l_quantity as spot,
         floor(l_extendedprice / l_quantity * (0.85::double + 0.05::double * l_linenumber) * 20.0::double) / 20.0::double as strike,
         cast(l_orderkey % 180 + 1 as double) as dte, 0.1::double + 5.0::double * l_discount as sigma,
         l_tax as rate, l_extendedprice / l_quantity * (0.02::double + l_tax) as price,
         case when l_linenumber % 2 = 1 then 'call' else 'put' end as option_type, l_quantity as volume
  from lineitem)
"""


# -------------------------------------------------------------- call/put pairs
def pair_rows(t: Tables) -> DataFrame:
    """events as option rows of a contract-day: even ids are calls, odd ones puts."""
    return (t.events
            .select(F.col("user_id").alias("contract"), F.to_date("ts").alias("day"), "ts", "event_id",
                    F.when(F.col("event_id") % 2 == 0, "call").otherwise("put").alias("option_type"),
                    "value", k_of().alias("volume")))


PAIRS = """
sided as (
  select user_id as contract, date_trunc('day', ts) as day, event_id % 2 as side, value, ts, event_id,
         cast(json_extract_string(props, '$.k') as double) as volume,
         row_number() over (partition by user_id, date_trunc('day', ts), event_id % 2 order by ts desc, event_id desc) as rn
  from events),
pairs as (
  select c.contract, c.day, c.value as call_value, p.value as put_value,
         c.volume as call_volume, p.volume as put_volume, greatest(c.ts, p.ts) as ts
  from (select * from sided where rn = 1 and side = 0) c
  join (select * from sided where rn = 1 and side = 1) p using (contract, day))
"""


# ----------------------------------------------------------- research sessions
def sessions(t: Tables) -> DataFrame:
    """One research row per (ticker, session): features, and the move to the next
    session of the same ticker as the future return."""
    daily = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("ticker"),
                               F.to_date("l_shipdate").alias("day")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.avg("l_discount").alias("f_discount"), F.avg("l_tax").alias("f_tax"),
        F.avg("l_quantity").alias("f_quantity"), F.count(F.lit(1)).cast("double").alias("f_count"))
    # Small (one row per ticker and session) and read by several branches of most
    # research jobs, so the big scan below it runs once.
    daily = cut(daily)
    w = Window.partitionBy("ticker").orderBy("day")
    return daily.withColumn("future_return", F.lead("px", 1).over(w) / F.col("px") - 1) \
                .withColumn("past_return", F.col("px") / F.lag("px", 1).over(w) - 1)


SESSIONS = """
daily as (
  select l_suppkey % 5 as ticker, date_trunc('day', l_shipdate) as day,
         avg(l_extendedprice / l_quantity) as px, avg(l_discount) as f_discount, avg(l_tax) as f_tax,
         avg(l_quantity) as f_quantity, cast(count(*) as double) as f_count
  from lineitem group by all),
sessions as (
  select *, lead(px) over (partition by ticker order by day) / px - 1 as future_return,
         px / lag(px) over (partition by ticker order by day) - 1 as past_return
  from daily)
"""


# --------------------------------------------------------------------- news
NEWS_TICKERS = ("click", "error", "purchase", "signup", "view")


def news(t: Tables) -> DataFrame:
    """documents as articles: one every 43 minutes from 2024-01-01."""
    tickers = F.array(*[F.lit(x) for x in NEWS_TICKERS])
    seconds = F.lit(1704067200) + F.col("doc_id") * 43 * 60
    return t.documents.select(
        "doc_id", F.element_at(tickers, (F.col("doc_id") % 5 + 1).cast("int")).alias("ticker"),
        F.timestamp_seconds(seconds).alias("published"), "text", "lang", "source", "n_chars")


NEWS = """
news as (
  select doc_id, (['click','error','purchase','signup','view'])[cast(doc_id % 5 + 1 as integer)] as ticker,
         timestamp '2024-01-01 00:00:00' + to_minutes(cast(doc_id * 43 as bigint)) as published,
         text, lang, source, n_chars
  from documents)
"""


def research_scores(t: Tables) -> DataFrame:
    """sessions with a deterministic forecast, cost and decision."""
    d = sessions(t).filter(F.col("future_return").isNotNull() & F.col("past_return").isNotNull())
    d = d.select("ticker", "day", "px", "f_discount", "f_tax", "f_quantity", "f_count",
                 (F.col("future_return") / 20).alias("actual_return"),
                 (0.012 + (F.col("f_discount") - 0.05) - F.col("past_return") / 40).alias("expected_return"),
                 (0.004 + F.col("f_tax") / 20).alias("cost"), "past_return")
    d = d.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - F.col("past_return") / 3)))
    return d.withColumn("trade", F.col("expected_return") > F.col("cost") + 0.005)


SCORES = SESSIONS + """,
scores as (
  select *, expected_return > cost + 0.005::double as trade from (
    select ticker, day, px, f_discount, f_tax, f_quantity, f_count, past_return, future_return / 20 as actual_return,
           0.012::double + (f_discount - 0.05::double) - past_return / 40 as expected_return,
           0.004::double + f_tax / 20 as cost,
           greatest(0::double, least(1::double, 0.5::double - past_return / 3)) as probability
    from sessions where future_return is not null and past_return is not null))
"""
