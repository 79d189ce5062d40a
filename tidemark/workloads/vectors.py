"""Queries over embeddings, event histograms, summaries and daily vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.clock import market_close
from tidemark.operators import news as n
from tidemark.operators import vectors as v
from tidemark.operators.asof import DAY_SECONDS, asof
from tidemark.session import cut
from tidemark.workloads.adapters import BARS, bars, day_text, k_of, r, rounded
from tidemark.workloads.registry import workload

DAY = ["ticker", "day"]


def chunks(t):
    """embeddings as news chunks of a label with quality signals and clocks."""
    i = F.col("vec_id")
    hours = lambda h: F.timestamp_seconds(F.lit(1704067200) + h * 3600)
    return t.embeddings.select(
        "vec_id", F.col("label").cast("long").alias("label"), "embedding", (i % 10 / 10.0).alias("quality"), (i % 7 / 7.0).alias("relevance"),
        F.when(i % 11 != 0, i % 5 / 5.0).alias("importance"), (i % 3 / 3.0).alias("novelty"),
        F.when(i % 3 != 0, hours(i + i % 48)).alias("effective"), F.when(i % 15 != 0, hours(i)).alias("published"),
        F.when(i % 6 != 0, hours(i + i % 48)).alias("first_seen"))


CHUNKS = """
chunks as (select vec_id, label::bigint as label, embedding, vec_id % 10 / 10.0::double as q, vec_id % 7 / 7.0::double as rel,
  coalesce(case when vec_id % 11 <> 0 then vec_id % 5 / 5.0::double end, 0.5) as imp, vec_id % 3 / 3.0::double as nov,
  case when vec_id % 3 <> 0 then timestamp '2024-01-01' + to_hours(cast(vec_id + vec_id % 48 as integer)) end as effective,
  case when vec_id % 15 <> 0 then timestamp '2024-01-01' + to_hours(cast(vec_id as integer)) end as published,
  case when vec_id % 6 <> 0 then timestamp '2024-01-01' + to_hours(cast(vec_id + vec_id % 48 as integer)) end as first_seen from embeddings),
weighed as (select *, 1.4::double * q + 1.8::double * rel + 1.5::double * imp + 0.8::double * nov + 0.25::double as z, exp(z) as w from chunks)
"""


@workload("attention_pool", sql=f"""
with {CHUNKS},
x as (select label, w, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as x from weighed),
m as (select label, pos, sum(w * x) / sum(w) as mean from x group by all),
nm as (select label, sqrt(sum(mean * mean)) as norm from m group by label),
s as (select label, count(*) as chunks, exp(ln(sum(w)) - sum(w * z) / sum(w)) as eff, max(w) / sum(w) as top, avg(imp) as mi from weighed group by label)
select m.label, m.pos, round(mean / norm, 4) + 0 as value, chunks, round(eff, 5) as effective_chunks, round(top, 6) as max_attention, round(mi, 6) as mean_importance
from m join nm on nm.label = m.label join s on s.label = m.label
""")
def attention_pool(t):
    """Attention-weighted unit vector per label and how concentrated it is."""
    d = n.pool_embeddings(chunks(t), keys=["label"])
    d = d.select("label", "chunks", r("effective_chunks", 5).alias("effective_chunks"), r("max_attention").alias("max_attention"),
                 r("mean_importance").alias("mean_importance"), F.posexplode("embedding").alias("pos", "value"))
    return d.withColumns({"pos": F.col("pos").cast("long"), "value": r("value", 4)})


@workload("news_availability", sql=f"""
with {CHUNKS},
a as (select label, case when effective is not null then effective when published is not null and first_seen is not null then greatest(published, first_seen) else published end as av,
   case when effective is not null then 'effective_available_at' when published is not null and first_seen is not null then 'max_published_first_seen'
        when published is not null then 'legacy_publication_only' else 'missing' end as availability_basis from chunks)
select label, availability_basis, count(*) as source_chunks, count(*) filter (av <= timestamp '2024-01-10') as kept, count(*) filter (av > timestamp '2024-01-10') as excluded_after_asof
from a group by all
""")
def news_availability(t):
    """Chunks usable at an instant and the evidence for it."""
    d = n.availability(chunks(t), effective="effective", published="published", first_seen="first_seen")
    as_of = F.lit("2024-01-10").cast("timestamp")
    return d.groupBy("label", "availability_basis").agg(
        F.count(F.lit(1)).alias("source_chunks"), F.count_if(F.col("available") <= as_of).alias("kept"),
        F.count_if(F.col("available") > as_of).alias("excluded_after_asof"))


_VOCAB = {f: (list(vs) + (["weird"] if f == "event_type" else [])) for f, vs in n.EVENT_VOCABULARY.items()}


def news_events(t):
    """events as extracted news events of a ticker-day."""
    k = F.col("k").cast("int")
    pick = lambda vs: F.try_element_at(F.array(*[F.lit(x) for x in vs]), k % (len(vs) + 1) + 1)
    later = F.timestamp_micros(F.unix_micros("ts") + k.cast("long") * 60_000_000)
    d = t.events.select("event_id", F.col("event_type").alias("ticker"), "ts", "value", k_of().alias("k"), F.to_date("ts").alias("day"))
    return d.select(
        "ticker", "day", market_close(F.col("day")).alias("as_of"), F.when(k % 23 != 0, later).alias("available_utc"),
        F.when(k % 46 != 0, F.col("ts")).alias("published_utc"), *[pick(vs).alias(f) for f, vs in _VOCAB.items()],
        F.when(k % 9 != 0, k / 100.0).alias("importance"), (F.col("value") / 500).alias("ticker_relevance"),
        (k % 10 / 10.0).alias("uncertainty"), F.when(k % 7 != 0, k % 8 / 8.0).alias("novelty"), (k % 9).alias("facts"),
        (k % 7).alias("causal_chain"), (k % 19 == 0).alias("llm_error"))


def _sql_events() -> str:
    picks = ", ".join(f"coalesce(([{', '.join(repr(x) for x in vs)}])[k % {len(vs) + 1} + 1], '{n.EVENT_VOCABULARY[f][-1]}') as {f}" for f, vs in _VOCAB.items())
    cols = []
    for f, vs in n.EVENT_VOCABULARY.items():
        for x in vs:
            cols.append(f"round(coalesce(count(*) filter (ok and {f} = '{x}') / nullif(count(*) filter (ok), 0), 0), 6) as {f}_{x}_share")
            cols.append(f"round(coalesce(coalesce(sum(importance) filter (ok and {f} = '{x}'), 0) / greatest(sum(importance) filter (ok), 1e-8), 0), 6) as {f}_{x}_importance_share")
    for f in n.EVENT_MEASURES:
        cols += [f"round(coalesce(avg({f}) filter (ok), 0), 6) as {f}_mean", f"round(coalesce(max({f}) filter (ok), 0), 6) as {f}_max"]
    return f"""
with e as (select event_type as ticker, date_trunc('day', ts) as day, ts, value, cast(json_extract_string(props, '$.k') as integer) as k from events),
f as (select ticker, day, coalesce(case when k % 23 <> 0 then ts + to_minutes(k) end, case when k % 46 <> 0 then ts end) as seen,
   ((day + interval 16 hour) at time zone 'America/New_York') at time zone 'UTC' as as_of, {picks},
   least(1, greatest(0, coalesce(case when k % 9 <> 0 then k / 100.0::double end, 0.5))) as importance, least(1, greatest(0, value / 500)) as ticker_relevance,
   k % 10 / 10.0::double as uncertainty, coalesce(case when k % 7 <> 0 then k % 8 / 8.0::double end, 0.5) as novelty, k % 9 as facts, k % 7 as chain, k % 19 = 0 as err from e),
g as (select *, coalesce(seen <= as_of, false) as ok from f)
select ticker, strftime(day, '%Y-%m-%d') as day, count(*) filter (ok) as events, count(*) as source_events, count(*) filter (seen > as_of) as excluded_after_asof,
  count(*) filter (seen is null) as excluded_missing_time, {', '.join(cols)},
  round(least(1, ln(1 + count(*) filter (ok)) / ln(101)), 6) as event_count_log, round(coalesce(avg(facts) filter (ok), 0) / 8, 6) as facts_mean,
  round(coalesce(avg(chain) filter (ok), 0) / 6, 6) as causal_chain_mean, round(coalesce(avg(err::integer) filter (ok), 0), 6) as llm_error_share
from g group by ticker, day
"""


def _histogram(t):
    return n.event_histogram(news_events(t), keys=DAY, available="available_utc", published="published_utc", as_of="as_of")


@workload("event_histogram", sql=_sql_events())
def event_histogram(t):
    """72 event features per ticker-day from what was known at the close."""
    d = _histogram(t)
    return d.select("ticker", day_text(F.col("day")).alias("day"), "events", "source_events", "excluded_after_asof", "excluded_missing_time",
                    *rounded(d, n.event_feature_names()))


_COLUMNS = ["open", "high", "low", "close", "volume", "transactions"]


def _sql_summary(columns=_COLUMNS) -> str:
    long = " union all ".join(f"select ticker, day, ts, '{c}' as \"column\", {c} as x from bars" for c in columns)
    return f"""
long as ({long}),
pl as (select *, row_number() over (partition by ticker, day, "column" order by ts) as i, count(*) over (partition by ticker, day, "column") as n from long where x is not null),
st as (select ticker, day, "column", count(*) as n, avg(x) as mean, stddev_pop(x) as std, min(x) as min, max(x) as max, median(x) as median, quantile_cont(x, 0.1) as p10,
   quantile_cont(x, 0.9) as p90, arg_max(x, i) as last, coalesce(regr_slope(x, case when pl.n > 1 then 2.0::double * (i - 1) / (pl.n - 1) - 1 end), 0) as slope from pl group by ticker, day, "column")
"""


@workload("summary9", sql=f"""
with {BARS}, {_sql_summary()}
select ticker, strftime(day, '%Y-%m-%d') as day, "column", n, {', '.join(f'round({s}, 5) + 0 as "{s}"' for s in v.STATISTICS)} from st
""")
def summary9(t):
    """Nine statistics per ticker-day and column."""
    d = v.summarise(bars(t), keys=DAY, order=["ts"], columns=_COLUMNS)
    return d.select("ticker", day_text(F.col("day")).alias("day"), "column", "n", *rounded(d, list(v.STATISTICS), 5))


def _sql_matrix(name: str, source: int, target: int, alias: str) -> str:
    digit = lambda at: f"(strpos('0123456789abcdef', substr(h, {at}, 1)) - 1)"
    return (f"{alias} as (select i, j, case p % 6 when 0 then sqrt(3.0::double / {target}) when 5 then -sqrt(3.0::double / {target}) else 0 end as a from ("
            f"select i, j, {digit(1)} * 4096 + {digit(2)} * 256 + {digit(3)} * 16 + {digit(4)} as p from (select i, j, "
            f"md5('{name}:{source}:{target}:' || i || ':' || j) as h from range({source}) r(i), range({target}) c(j))))")


@workload("random_projection", sql=f"""
with {_sql_matrix('chunks', 64, 24, 'm')},
x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings),
y as (select vec_id, j, sum(x * a) as y from x join m using (i) group by all),
s as (select vec_id, sqrt(avg(y * y)) + 1e-6 as s from y group by vec_id)
select vec_id, cast(count(*) as bigint) as dimensions, round(sum(tanh(y / (3 * s))), 5) + 0 as total, round(sqrt(sum(tanh(y / (3 * s)) ** 2)), 5) as norm from y join s using (vec_id) group by vec_id
""")
def random_projection(t):
    """Embeddings projected by the reproducible sparse sign matrix and squashed."""
    d = t.embeddings.select("vec_id", v.compress(F.col("embedding").cast("array<double>"), 24, "chunks").alias("p"))
    return d.select("vec_id", F.size("p").cast("long").alias("dimensions"), r(v.total(F.col("p")), 5).alias("total"),
                    r(v.l2_norm(F.col("p")), 5).alias("norm"))


def _stored_blocks(t):
    """Raw blocks per ticker-day from bar summaries and the event histogram."""
    s = cut(v.summarise(bars(t), keys=DAY, order=["ts"], columns=_COLUMNS))
    out = None
    for name, columns in {"stock_raw": ["close", "volume"], "options_raw": ["open", "transactions"], "expectation_raw": ["high"],
                          "earnings_raw": ["low"]}.items():
        block = v.summary_block(s, keys=DAY, columns=columns, out=name)
        out = block if out is None else out.join(block, DAY)
    return out


def _small_events(t):
    h = _histogram(t)
    return h.select(*DAY, F.array("importance_mean", "novelty_mean", "facts_mean", "causal_chain_mean").alias("events_raw"),
                    F.array("ticker_relevance_mean", "uncertainty_mean").alias("news_raw"),
                    F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), "event_count_log", "llm_error_share", F.lit(0.5), F.lit(1.0)).alias("quality_raw"))


def _sql_ablation() -> str:
    hist = _sql_events().strip().removeprefix("with ")
    head, tail = hist.rsplit("select ticker, strftime", 1)
    raw_hist = (head.rstrip() + ",\nhist as (select ticker, day, " + ", ".join(
        [f"coalesce(avg({f}) filter (ok), 0) as {f}_m" for f in n.EVENT_MEASURES] + [
            "coalesce(avg(facts) filter (ok), 0) / 8 as fm", "coalesce(avg(chain) filter (ok), 0) / 6 as cm",
            "least(1, ln(1 + count(*) filter (ok)) / ln(101)) as ecl", "coalesce(avg(err::integer) filter (ok), 0) as les"])
        + " from g group by ticker, day)")
    size = v.layout(32)
    stat = lambda block, col, base: " union all ".join(
        f"select ticker, day, '{block}' as block, {base + i} as i, \"{s}\" as x from st where \"column\" = '{col}'" for i, s in enumerate(v.STATISTICS))
    at = lambda block, items: " union all ".join(f"select ticker, day, '{block}' as block, {i} as i, {x} as x from hist" for i, x in enumerate(items))
    events = ["importance_m", "novelty_m", "fm", "cm"]
    news_all = ["ticker_relevance_m", "uncertainty_m", *events]
    quality = ["1", "1", "0", "1", "ecl", "les", "0.5", "1"]
    parts = {
        "news_all": (at("news_all", news_all), 6, "news"), "news_events": (at("news_events", events), 4, "news"),
        "options": (stat("options", "open", 0) + " union all " + stat("options", "transactions", 9), 18, "options"),
        "stock": (stat("stock", "close", 0) + " union all " + stat("stock", "volume", 9), 18, "stock"),
        "exp_all": (stat("exp_all", "high", 0) + " union all " + stat("exp_all", "low", 9), 18, "expectation"),
        "exp_theory": (stat("exp_theory", "high", 0), 9, "expectation"), "exp_earn": (stat("exp_earn", "low", 0), 9, "expectation"),
    }
    mats = ",\n".join(_sql_matrix(f"{b}-d32", n_in, size[b], f"m_{k}") for k, (_, n_in, b) in parts.items())
    longs = ",\n".join(f"l_{k} as ({q})" for k, (q, _, _) in parts.items())
    ys = ",\n".join(f"y_{k} as (select ticker, day, block, j, sum(x * a) as y from l_{k} join m_{k} using (i) group by all)" for k in parts)
    allq = " union all ".join(f"select * from y_{k}" for k in parts) + " union all select ticker, day, block, i, x::double from l_quality"
    uses = {"all_layers": ("news_all", "options", "stock", "exp_all"), "without_news": ("options", "stock", "exp_all"),
            "without_embeddings": ("news_events", "options", "stock", "exp_all"), "without_options": ("news_all", "stock", "exp_all"),
            "without_earnings": ("news_all", "options", "stock", "exp_theory"), "without_technical": ("news_all", "options", "exp_all"),
            "without_theoretical_option_value": ("news_all", "options", "stock", "exp_earn")}
    pairs = ", ".join(f"('{k}', '{b}')" for k, bs in uses.items() for b in (*bs, "quality"))
    return f"""
with {BARS}, {_sql_summary()}, {raw_hist},
{mats},
{longs},
l_quality as ({at('quality', quality)}),
{ys},
y as ({allq}),
sc as (select ticker, day, block, sqrt(avg(y * y)) + 1e-6 as s from y group by all),
th as (select y.ticker, y.day, y.block, tanh(y / (3 * s))::float::double as v from y join sc on sc.ticker = y.ticker and sc.day = y.day and sc.block = y.block),
us(variant, block) as (values {pairs})
select variant, ticker, strftime(day, '%Y-%m-%d') as day, cast(32 as bigint) as dimensions, round(sum(v), 4) + 0 as total, round(sqrt(sum(v * v)), 4) as norm
from us join th using (block) group by variant, ticker, day
"""


@workload("ablation_fanout", sql=_sql_ablation())
def ablation_fanout(t):
    """Seven ablated vectors per ticker-day, as rows."""
    d = v.ablate(_stored_blocks(t).join(_small_events(t), DAY), dimensions=32)
    return d.select("variant", "ticker", day_text(F.col("day")).alias("day"), F.size("vector").cast("long").alias("dimensions"),
                    r(v.total(F.col("vector")), 4).alias("total"), r(v.l2_norm(F.col("vector")), 4).alias("norm"))


@workload("vector_attach", sql=f"""
with {BARS}, {_sql_summary(['close', 'volume'])},
vec as (select ticker, day, sum({' + '.join(f'"{s}"::float::double' for s in v.STATISTICS)}) as total, sum({' + '.join(f'("{s}"::float::double) ** 2' for s in v.STATISTICS)}) as sq from st group by ticker, day),
rows as (select ticker, day, count(*) as rows, arg_max(close, ts) as close from bars group by ticker, day)
select ticker, strftime(day, '%Y-%m-%d') as day, rows, close, round(total, 3) as vector_total, round(sqrt(sq), 3) as vector_norm, 'tide-384-v1' as vector_version
from rows join vec using (ticker, day)
""")
def vector_attach(t):
    """Research rows with their day's vector and its version."""
    b = bars(t)
    rows = b.groupBy(*DAY).agg(F.count(F.lit(1)).alias("rows"), F.max_by("close", "ts").alias("close"))
    block = v.summary_block(v.summarise(b, keys=DAY, order=["ts"], columns=["close", "volume"]), keys=DAY, columns=["close", "volume"], out="raw")
    vectors = block.select(*DAY, F.col("raw").cast("array<float>").alias("vector"), F.lit(v.VECTOR_VERSION).alias("vector_version"))
    d = v.attach_vectors(rows, vectors, keys=DAY, provenance=["vector_version"])
    return d.select("ticker", day_text(F.col("day")).alias("day"), "rows", "close", "vector_version",
                    r(v.total(F.col("vector")), 3).alias("vector_total"), r(v.l2_norm(F.col("vector")), 3).alias("vector_norm"))


@workload("quality_block", sql=f"""
with {BARS},
f as (select ticker, day, count(*) as fr, avg((volume < 20)::integer) as miss from bars group by all),
c as (select label, count(*) as chunks, avg(vec_id % 10 / 10.0::double) as q from embeddings group by label),
j as (select ticker, day, fr, miss, chunks, q from f left join c on c.label = day(day) % 15)
select ticker, strftime(day, '%Y-%m-%d') as day, (chunks is not null)::integer::double as q0, 1.0::double as q1, 0.0::double as q2,
  round(least(1, ln(1 + coalesce(chunks, 0)) / ln(101)), 6) as q4, round(least(1, ln(1 + fr) / ln(10001)), 6) as q5, round(coalesce(q, 0), 6) as q7,
  round(1 - miss, 6) as q11, 0.0::double as q12, 1.0::double as q15 from j
""")
def quality_block(t):
    """Sixteen quality coordinates of a ticker-day (those that vary shown)."""
    f = bars(t).groupBy(*DAY).agg(F.count(F.lit(1)).alias("fr"), F.avg((F.col("volume") < 20).cast("double")).alias("miss"))
    c = t.embeddings.groupBy(F.col("label").alias("slot")).agg(F.count(F.lit(1)).alias("chunks"), F.avg(F.col("vec_id") % 10 / 10.0).alias("q"))
    d = f.withColumn("slot", F.dayofmonth("day") % 15).join(c, "slot", "left")
    none = F.lit(None).cast("double")
    d = d.withColumn("b", v.quality_block(
        news_present=F.col("chunks").isNotNull(), feature_rows=F.col("fr"), pair_rows=F.lit(0), has_expectation=F.lit(False), chunks=F.col("chunks"),
        means={"quality": F.col("q"), "relevance": none, "importance": none, "novelty": none}, feature_missing=F.col("miss"), pair_missing=none, max_attention=none))
    return d.select("ticker", day_text(F.col("day")).alias("day"), *[r(F.col("b")[i]).alias(f"q{i}") for i in (0, 1, 2, 4, 5, 7, 11, 12, 15)])


@workload("daily_vector")
def daily_vector(t):
    """384-dimension vector per ticker-day from pooled news, events, bars and quality.

    A chunk counts in its ticker's next session whose close it was available for, over
    weekends and gaps too; chunks after the last session wait for the next one.
    """
    tickers = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    usable = n.availability(chunks(t), effective="effective", published="published", first_seen="first_seen").filter(F.col("available").isNotNull())
    usable = usable.withColumn("ticker", F.element_at(tickers, (F.col("label") % 5 + 1).cast("int"))).drop("day")
    sessions = bars(t).select(*DAY).distinct().withColumn("close", market_close(F.col("day")))
    usable = asof(usable, sessions, keys=["ticker"], left_time="available", right_time="close", direction="forward", take=["day"], bucket_seconds=7 * DAY_SECONDS).filter(F.col("day").isNotNull())
    pooled = n.pool_embeddings(usable, keys=DAY).select(*DAY, F.col("embedding").alias("news_raw"), "chunks", "max_attention", "mean_quality",
                                                        "mean_relevance", "mean_importance", "mean_novelty")
    h = _histogram(t)
    events = h.select(*DAY, F.array(*n.event_feature_names()).alias("events_raw"), F.col("events"))
    counts = bars(t).groupBy(*DAY).agg(F.count(F.lit(1)).alias("fr"), F.avg((F.col("volume") < 20).cast("double")).alias("miss"))
    d = _stored_blocks(t).join(events, DAY, "left").join(counts, DAY).join(pooled, DAY, "left")
    d = d.withColumn("quality_raw", v.quality_block(
        news_present=F.col("chunks").isNotNull(), feature_rows=F.col("fr"), pair_rows=F.lit(0), has_expectation=F.lit(False), chunks=F.col("chunks"),
        means={x: F.col(f"mean_{x}") for x in ("quality", "relevance", "importance", "novelty")}, feature_missing=F.col("miss"), pair_missing=F.lit(None).cast("double"),
        max_attention=F.col("max_attention")))
    d = v.assemble(d, 384)
    return d.select("ticker", day_text(F.col("day")).alias("day"), "dimensions", "vector_version", "schema_hash",
                    r(v.total(F.col("vector")), 4).alias("total"), r(v.l2_norm(F.col("vector")), 4).alias("norm"))
