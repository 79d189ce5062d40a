"""Queries over stored objects: inventory, coverage, plans, readiness, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources import inventory as inv
from tidemark.sources import snapshots as snap
from tidemark.workloads.adapters import TRADES, day_text, r, trades
from tidemark.workloads.registry import workload


def objects(t):
    """lineitem as stored objects: one key per line, laid out by line number; some are unfinished or foreign files."""
    day = F.to_date("l_shipdate")
    ticker = F.concat(F.lit("T"), (F.col("l_suppkey") % 25).cast("string"))
    d, month = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy/MM")
    n = F.col("l_linenumber")
    key = (F.when(n == 1, F.concat(F.lit("market-data/v2/stocks/minute/"), ticker, F.lit("/"), month, F.lit("/"), d, F.lit(".csv.gz")))
           .when(n == 2, F.concat(F.lit("market-data/v2/options/minute/"), month, F.lit("/"), d, F.lit("/by-ticker/"), ticker, F.lit("/part-00001.csv.gz")))
           .when(n == 3, F.concat(F.lit("market-data/v4/features/"), ticker, F.lit("/"), month, F.lit("/"), d, F.lit(".csv.gz")))
           .when(n == 4, F.concat(F.lit("market-data/v5/gpu-news-agent/receipts/"), ticker, F.lit("/"), F.date_format(day, "yyyy"), F.lit("/"), d, F.lit("_"),
                                  F.date_format(F.date_add(day, 5), "yyyy-MM-dd"), F.lit(".json")))
           .when(n == 5, F.concat(F.lit("market-data/v4/option-pairs/h30/"), ticker, F.lit("/"), month, F.lit("/"), d, F.lit(".csv.gz")))
           .when(n == 6, F.concat(F.lit("market-data/v3/macro/risk_free_"), d, F.lit(".csv.gz")))
           .when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("market-data/v2/stocks/minute/"), ticker, F.lit("/"), month, F.lit("/"), d, F.lit(".csv.gz.tmp")))
           .when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("market-data/v3/quotes/"), d, F.lit(".parquet")))
           .otherwise(F.concat(F.lit("other/"), ticker, F.lit("/"), d)))
    return t.lineitem.select(key.alias("key"), (F.col("l_quantity") * 100).cast("long").alias("size"), F.col("l_shipdate").alias("last_modified"))


_D = "strftime(l_shipdate, '%Y-%m-%d')"
_M = "strftime(l_shipdate, '%Y/%m')"
# Key patterns of the datasets that these objects belong to, written out on their own.
_PATTERNS = {
    "stocks": r"^market-data/v2/stocks/minute/([^/]+)/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})\.csv\.gz$",
    "options": r"^market-data/v2/options/minute/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})/(?:part-\d+\.csv\.gz|by-ticker/[^/]+/part-\d+\.csv\.gz|manifest\.json)$",
    "quotes": r"^market-data/v3/quotes/(?:([^/]+)/)?(?:\d{4}/\d{2}/)?(\d{4}-\d{2}-\d{2})",
    "macro": r"^market-data/v3/macro/(.+)$",
    "clean_features": r"^market-data/v4/features/([^/]+)/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})\.csv\.gz$",
    "clean_pairs": r"^market-data/v4/option-pairs/h(\d+)/([^/]+)/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})\.csv\.gz$",
    "news_coverage": r"^market-data/v5/gpu-news-agent/receipts/([^/]+)/\d{4}/(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.json$",
}
OBJECTS = f"""
objects as (select case l_linenumber when 1 then 'market-data/v2/stocks/minute/' || tk || '/' || {_M} || '/' || {_D} || '.csv.gz'
  when 2 then 'market-data/v2/options/minute/' || {_M} || '/' || {_D} || '/by-ticker/' || tk || '/part-00001.csv.gz'
  when 3 then 'market-data/v4/features/' || tk || '/' || {_M} || '/' || {_D} || '.csv.gz'
  when 4 then 'market-data/v5/gpu-news-agent/receipts/' || tk || '/' || strftime(l_shipdate, '%Y') || '/' || {_D} || '_' || strftime(l_shipdate + interval 5 day, '%Y-%m-%d') || '.json'
  when 5 then 'market-data/v4/option-pairs/h30/' || tk || '/' || {_M} || '/' || {_D} || '.csv.gz'
  when 6 then 'market-data/v3/macro/risk_free_' || {_D} || '.csv.gz' else case l_orderkey % 3 when 0 then 'market-data/v2/stocks/minute/' || tk || '/' || {_M} || '/' || {_D} || '.csv.gz.tmp'
    when 1 then 'market-data/v3/quotes/' || {_D} || '.parquet' else 'other/' || tk || '/' || {_D} end end as key,
  cast(l_quantity * 100 as bigint) as size, l_shipdate as last_modified
  from (select *, 'T' || (l_suppkey % 25) as tk from lineitem)),
named as (select *, case {' '.join(f"when regexp_matches(key, '{p}') then '{n}'" for n, p in _PATTERNS.items())} end as dataset from objects),
cls as (select *, case when dataset = 'macro' then [regexp_extract(key, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)]
     else regexp_extract_all(key, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) end as days,
   nullif(regexp_extract(key, '/(T\\d+)/', 1), '') as ticker from named where dataset is not null),
dd as (select distinct dataset, unnest(days) as day from cls),
tt as (select distinct dataset, ticker from cls where ticker is not null and dataset <> 'options'),
summ as (select b.*, coalesce(dc, 0) as date_count, fd as first_date, ld as last_date, coalesce(tc, 0) as ticker_count, tickers from
   (select dataset, count(*) as objects, cast(sum(size) as bigint) as bytes, min(last_modified) as fm, max(last_modified) as lm from cls group by dataset) b
   left join (select dataset, count(*) as dc, min(day) as fd, max(day) as ld from dd group by dataset) using (dataset)
   left join (select dataset, count(*) as tc, list_sort(list(ticker)) as tickers from tt group by dataset) using (dataset))
"""


@workload("inv_scan", sql=f"""
with {OBJECTS}
select dataset, objects, bytes, date_count, first_date, last_date, ticker_count, strftime(fm, '%Y-%m-%d') as first_modified, strftime(lm, '%Y-%m-%d') as last_modified from summ
""")
def inv_scan(t):
    """Stored keys classified by 48 patterns and summed up per dataset."""
    d = inv.summarise(inv.classify(objects(t)))
    return d.select("dataset", "objects", "bytes", "date_count", day_text(F.col("first_date")).alias("first_date"), day_text(F.col("last_date")).alias("last_date"),
                    "ticker_count", day_text(F.col("first_modified")).alias("first_modified"), day_text(F.col("last_modified")).alias("last_modified"))


_COMPANIES = [f"T{i}" for i in range(25)]
_WANTED = {"all": [*_COMPANIES, "SPY", "QQQ"], "benchmarks": ["SPY", "QQQ"], "companies": _COMPANIES, "none": []}
_REQS = ", ".join(
    f"('{rid}', {order}, {place}, '{name}', '{need}', '{gate}', date '1995-01-01', [{', '.join(repr(x) for x in _WANTED[mode])}]::varchar[])"
    for rid, order, names, need, gate, start, mode in inv.REQUIREMENTS for place, name in enumerate(names))
_REQUIREMENTS = tuple((*q[:5], "1995-01-01", q[6]) for q in inv.REQUIREMENTS)


@workload("readiness", sql=f"""
with {OBJECTS},
rq(id, ord, place, dataset, needed, gate, start, wanted) as (values {_REQS}),
j as (select rq.*, s.objects, s.bytes, s.first_date, s.last_date, s.tickers, s.dataset as found, row_number() over (partition by rq.id order by s.dataset is null, place) as rn
      from rq left join summ s on s.dataset = rq.dataset),
k as (select *, list_filter(wanted, lambda x: not list_contains(coalesce(tickers, []), x)) as gone from j where rn = 1),
s as (select *, case when found is null then case when needed in ('gereserveerd', 'later verplicht') then 'uitgesteld' else 'ontbreekt' end
   when first_date::date <= start + 14 and last_date::date >= date '2001-12-31' - 10 and len(gone) = 0 then 'gereed' else 'gedeeltelijk' end as state from k)
select id, cast(ord as integer) as "order", needed, gate, found as dataset_found, coalesce(objects, 0) as objects, cast(len(gone) as bigint) as missing_tickers, state,
  needed = 'verplicht' and gate in ('training', 'vectorbouw') and state <> 'gereed' as blocker from s
""")
def readiness(t):
    """State of each data requirement against the inventory, blockers first."""
    d = inv.readiness(inv.summarise(inv.classify(objects(t))), companies=_COMPANIES, end="2001-12-31", requirements=_REQUIREMENTS)
    return d.select("id", "order", "needed", "gate", "dataset_found", "objects", F.size("missing_tickers").cast("long").alias("missing_tickers"), "state", "blocker")


def _store(t, line: int):
    """(ticker, day) units of store 1, 2 or 3: every line belongs to one of them."""
    return t.lineitem.filter((F.col("l_linenumber") - 1) % 3 + 1 == line).select(
        F.concat(F.lit("T"), (F.col("l_suppkey") % 25).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("day"),
        (F.col("l_quantity") * 100).cast("long").alias("size"), "l_returnflag")


def _calendar(t):
    return inv.market_calendar(t.lineitem.select("l_shipdate"), day="l_shipdate", start="1995-01-01", end="2001-12-31")


_CAL = """
obs as (select distinct cast(l_shipdate as date) as day from lineitem where l_shipdate between timestamp '1995-01-01' and timestamp '2001-12-31'),
wk as (select cast(d as date) as day from generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval 1 day) g(d) where isodow(d) <= 5),
en as (select (select count(*) from obs) >= greatest(3, floor((select count(*) from wk) * 0.55)) as ok),
cal as (select day, 'observed' as basis from obs where (select ok from en) union all select day, 'weekdays' from wk where not (select ok from en))
"""
_UNITS = _CAL + """,
u as (select 'T' || (l_suppkey % 25) as ticker, cast(l_shipdate as date) as day, (l_linenumber - 1) % 3 + 1 as line, cast(l_quantity * 100 as bigint) as size, l_returnflag as flag from lineitem),
tick as (select distinct ticker from u), ex as (select ticker, day from tick, cal)
"""


@workload("market_calendar", sql=f"with {_CAL} select strftime(day, '%Y-%m-%d') as day, basis from cal")
def market_calendar(t):
    """Trading days as observed, or weekdays where too few are."""
    return _calendar(t).select(day_text(F.col("day")).alias("day"), "basis")


def _expected(t):
    return inv.expected_units(_store(t, 1).unionByName(_store(t, 2)), cut(_calendar(t)), ticker="ticker", day="day")


_EXPECTED = "tick2 as (select distinct ticker from u where line in (1, 2)), ex2 as (select ticker, day from tick2, cal)"


@workload("coverage", sql=f"""
with {_UNITS}, {_EXPECTED},
m as (select ticker, day, max((line = 1)::integer) as p, max((line = 2 and flag = 'N')::integer) as rc from u where line = 1 or (line = 2 and flag = 'N') group by all)
select ex2.ticker, count(*) as expected_days, cast(coalesce(sum(p), 0) as bigint) as physical_days, count(*) filter (coalesce(p, 0) + coalesce(rc, 0) > 0) as verified_days,
  round(count(*) filter (coalesce(p, 0) + coalesce(rc, 0) > 0) / count(*), 6) as coverage_ratio
from ex2 left join m on m.ticker = ex2.ticker and m.day = ex2.day group by ex2.ticker
""")
def coverage(t):
    """Days on disk and verified days per ticker."""
    d = inv.coverage(_expected(t), _store(t, 1), _store(t, 2).filter(F.col("l_returnflag") == "N"), ticker="ticker", day="day")
    return d.select("ticker", "expected_days", "physical_days", "verified_days", r("coverage_ratio").alias("coverage_ratio"))


@workload("import_plan", sql=f"""
with {_UNITS}, {_EXPECTED},
pr as (select distinct ticker, day, true as have from u where line = 1 or (line = 2 and flag = 'N')),
lg as (select distinct day, true as old from u where line = 3 and flag = 'A'),
un as (select sum(size)::double / count(distinct (ticker, day)) as per from u where line = 1),
f as (select ex2.ticker, coalesce(have, false) as h, coalesce(old, false) and not coalesce(have, false) as o from ex2 left join pr on pr.ticker = ex2.ticker and pr.day = ex2.day left join lg on lg.day = ex2.day)
select ticker, count(*) as expected_units, count(*) filter (h or o) as already_present, count(*) filter (o) as legacy_assumed, count(*) filter (not h and not o) as remaining_units,
  cast(floor(count(*) filter (not h and not o) * (select per from un)) as bigint) as estimated_remaining_bytes from f group by ticker
""")
def import_plan(t):
    """Units still to import per ticker, with a byte estimate."""
    legacy = _store(t, 3).filter(F.col("l_returnflag") == "A")
    return inv.import_plan(_expected(t), _store(t, 1), _store(t, 2).filter(F.col("l_returnflag") == "N"), ticker="ticker", day="day", size="size", legacy_days=legacy)


@workload("set_missing", sql=f"""
with {_UNITS}, {_EXPECTED}
select ticker, strftime(day, '%Y-%m-%d') as day from ex2 anti join (select distinct ticker, day from u where line = 1) p using (ticker, day)
""")
def set_missing(t):
    """Expected units that are not stored."""
    d = inv.missing_units(_expected(t), _store(t, 1), on=["ticker", "day"])
    return d.select("ticker", day_text(F.col("day")).alias("day"))


@workload("src_universe_split", sql=f"""
with {TRADES},
uni as (select s_suppkey as ticker from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1),
t as (select ticker, cast(ts as date) as day from trades), days as (select distinct day from t),
c as (select ticker, day, count(*) as rows from t semi join uni using (ticker) group by all)
select uni.ticker, strftime(days.day, '%Y-%m-%d') as day, coalesce(rows, 0) as rows, case when rows is null then 'verified_empty' else 'stored' end as status
from uni, days left join c on c.ticker = uni.ticker and c.day = days.day
""")
def src_universe_split(t):
    """Market-wide trades kept for the universe, with a receipt per ticker and day."""
    universe = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).filter(F.col("n_regionkey") == 1).select(F.col("s_suppkey").alias("ticker"))
    d = trades(t).select("ticker", F.to_date("ts").alias("day"))
    _, receipts = snap.split_universe(d, universe, cut(d.select("day").distinct()), ticker="ticker", day="day")
    return receipts.select("ticker", day_text(F.col("day")).alias("day"), "rows", "status")


@workload("src_layout_pref", sql="""
with r as (select l_suppkey as ticker, cast(l_shipdate as date) as day, l_quantity as q, l_tax as x, 'shared' as layout from lineitem
  union all select l_suppkey, cast(l_shipdate as date), l_quantity, l_tax, 'by_ticker' from lineitem where l_linenumber <= 2),
k as (select *, max((layout = 'by_ticker')::integer) over (partition by ticker, day) as has from r),
d as (select distinct ticker, day, q, x, layout from k where has = 0 or layout = 'by_ticker')
select ticker, strftime(day, '%Y-%m-%d') as day, any_value(layout) as layout, count(*) as rows, round(sum(q), 2) as quantity from d group by ticker, day
""")
def src_layout_pref(t):
    """Rows of the authoritative layout per ticker and day, repeats removed."""
    d = t.lineitem.select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"), "l_linenumber")
    both = d.drop("l_linenumber").withColumn("layout", F.lit("shared")).unionByName(
        d.filter(F.col("l_linenumber") <= 2).drop("l_linenumber").withColumn("layout", F.lit("by_ticker")))
    kept = snap.prefer_layout(both, keys=["ticker", "day"], layout="layout", first="by_ticker")
    return kept.groupBy("ticker", "day").agg(F.any_value("layout").alias("layout"), F.count(F.lit(1)).alias("rows"), F.sum("q").alias("quantity")).select(
        "ticker", day_text(F.col("day")).alias("day"), "layout", "rows", r("quantity", 2).alias("quantity"))


@workload("src_latest_version", sql="""
with k as (select user_id as ticker, 'raw/' || user_id || '/range-' || (999 - event_id % 1000) || '/' || strftime(ts, '%Y%m%dT%H%M%S') || lpad(cast(event_id % 1000000 as varchar), 6, '0') || 'Z_x.json' as path from events)
select ticker, max(regexp_extract(path, '([^/]+)$', 1)) as newest, max(regexp_extract(path, '(\\d{8}T\\d{6,12}Z)[^/]*$', 1)) as stamp from k group by ticker
""")
def src_latest_version(t):
    """Newest immutable snapshot per ticker by the stamp in its file name."""
    path = F.concat(F.lit("raw/"), F.col("user_id").cast("string"), F.lit("/range-"), (999 - F.col("event_id") % 1000).cast("string"), F.lit("/"),
                    F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0"), F.lit("Z_x.json"))
    d = snap.newest_versions(t.events.select(F.col("user_id").alias("ticker"), path.alias("path")), group=["ticker"], path="path")
    return d.select("ticker", snap.basename(F.col("path")).alias("newest"), "stamp")


@workload("src_append_dedup", sql="""
with h as (select distinct sha256('{"role":"' || role || '","text":' || to_json(text) || ',"turn":' || turn || '}') as content_key, conv_id from conversations)
select content_key from h group by content_key having count(*) filter (conv_id % 3 = 0) = 0
""")
def src_append_dedup(t):
    """Content hashes of rows not stored yet, each once."""
    cols = ["role", "text", "turn"]
    d = t.conversations
    stored = d.filter(F.col("conv_id") % 3 == 0).select(snap.content_key(cols).alias("content_key"))
    return snap.new_content(d.select(*cols), stored, columns=cols).select("content_key")


@workload("src_manifest_merge", sql="""
with b as (select cast(l_shipdate as date) as day, l_suppkey as ticker, l_linenumber as batch, count(*) as rows from lineitem group by all)
select strftime(day, '%Y-%m-%d') as day, ticker, arg_max(rows, batch) as rows, max(batch) as batch, count(*) - 1 as replaced from b group by day, ticker
""")
def src_manifest_merge(t):
    """Day manifest after several writes: the last row count wins."""
    entries = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("ticker"), F.col("l_linenumber").alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"))
    d = snap.merge_manifest(entries, keys=["day", "ticker"], rows="rows", updated="batch")
    return d.select(day_text(F.col("day")).alias("day"), "ticker", "rows", "batch", "replaced")


@workload("src_preferred_copy", sql="""
with c as (select 'T' || (l_suppkey % 25) as ticker, cast(l_shipdate as date) as day, ([240, 60, 15, 30, 120, 45, 90])[l_linenumber] as horizon from lineitem)
select ticker, strftime(day, '%Y-%m-%d') as day, cast(arg_min(horizon, case horizon when 30 then 1 when 15 then 2 when 60 then 3 when 120 then 4 when 240 then 5 when 45 then 6 else 7 end) as integer) as horizon
from c group by ticker, day
""")
def src_preferred_copy(t):
    """Which stored horizon to read per ticker and day."""
    horizon = F.element_at(F.array(*[F.lit(x) for x in (240, 60, 15, 30, 120, 45, 90)]), F.col("l_linenumber"))
    d = t.lineitem.select(F.concat(F.lit("T"), (F.col("l_suppkey") % 25).cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("day"), horizon.alias("horizon"))
    out = snap.preferred_copy(d, keys=["ticker", "day"], horizon="horizon")
    return out.select("ticker", day_text(F.col("day")).alias("day"), "horizon")


@workload("src_latest_common", sql=f"""
with {_UNITS}
select ticker, strftime(max(day), '%Y-%m-%d') as day from (select ticker, day from u where line in (1, 3) intersect select ticker, day from u where line = 2) group by ticker
""")
def src_latest_common(t):
    """Newest day each ticker has in both the feature and the pair store."""
    d = snap.newest_common_day(_store(t, 1).unionByName(_store(t, 3)), _store(t, 2), ticker="ticker", day="day")
    return d.select("ticker", day_text(F.col("day")).alias("day"))
