"""Object inventory: classify stored keys, summarise datasets, coverage, plans, readiness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

_DAY = r"(\d{4}-\d{2}-\d{2})"
_MONTH = r"\d{4}/\d{2}/"
_PART = r"part-\d+\.csv\.gz"
_CSV = r"\.csv\.gz$"


@dataclass(frozen=True)
class Layout:
    """How keys of a dataset are built, and which groups hold ticker, dates, horizon."""
    pattern: str
    ticker: int | None = None
    days: tuple[int, ...] = ()
    horizon: int | None = None


# Key layouts.
LAYOUTS = {
    "ticker/month/day": Layout(rf"/([^/]+)/{_MONTH}{_DAY}.*$", 1, (2,)),
    "ticker/month/day.csv": Layout(rf"/([^/]+)/{_MONTH}{_DAY}{_CSV}", 1, (2,)),
    "ticker/day.csv": Layout(rf"/([^/]+)/{_DAY}{_CSV}", 1, (2,)),
    "ticker/day.json": Layout(rf"/([^/]+)/{_DAY}\.json$", 1, (2,)),
    "maybe ticker, month/day": Layout(rf"/(?:([^/]+)/)?(?:{_MONTH})?{_DAY}", 1, (2,)),
    "day/parts": Layout(rf"/{_MONTH}{_DAY}/(?:{_PART}|by-ticker/[^/]+/{_PART}|manifest\.json)$", None, (1,)),
    "ticker/range.csv": Layout(rf"/([^/]+)/{_DAY}_{_DAY}{_CSV}", 1, (2, 3)),
    "ticker/range/parts": Layout(rf"/([^/]+)/{_DAY}_{_DAY}/.+{_CSV}", 1, (2, 3)),
    "ticker/year/range": Layout(rf"/([^/]+)/\d{{4}}/{_DAY}_{_DAY}\.json$", 1, (2, 3)),
    "month/run.json": Layout(rf"/{_MONTH}.+\.json$", None, ()),
    "ticker/y/m/d": Layout(r"/([^/]+)/(\d{4}/\d{2}/\d{2})/.+\.json\.gz$", 1, (2,)),
    "horizon/ticker/month/day": Layout(rf"/h(\d+)/([^/]+)/{_MONTH}{_DAY}{_CSV}", 2, (3,), 1),
    "anything": Layout(r"/.+$", None, ()),
}

# Datasets in matching order, their folder and layout.
DATASETS = (
    ("stocks", "v2/stocks/minute", "ticker/month/day.csv"), ("options", "v2/options/minute", "day/parts"),
    ("news", "v2/news", "ticker/month/day.csv"), ("option_trades", "v3/option-trades", "day/parts"),
    ("option_trade_features", "v3/option-trade-minute", "day/parts"), ("open_interest", "v3/open-interest", "ticker/day.csv"),
    ("earnings", "v3/earnings", "ticker/range.csv"), ("earnings_sec_raw", "v5/earnings/raw/sec", "ticker/y/m/d"),
    ("earnings_fmp_raw", "v5/earnings/raw/fmp", "ticker/y/m/d"), ("earnings_processed", "v5/earnings/processed", "ticker/range/parts"),
    ("earnings_status", "v5/earnings/status/runs", "month/run.json"), ("sentiment", "v3/sentiment", "ticker/month/day.csv"),
    ("gpu_sentiment", "v3/gpu-sentiment", "ticker/month/day.csv"), ("features", "v3/features", "ticker/month/day.csv"),
    ("quotes", "v3/quotes", "maybe ticker, month/day"), ("google_finance_news", "v3/google-finance/news", "ticker/day.csv"),
    ("google_finance_snapshots", "v3/google-finance/snapshots", "ticker/day.json"), ("news_rich", "v3/news-rich", "ticker/month/day.csv"),
    ("macro", "v3/macro", "anything"), ("pairs", "v3/option-pairs", "horizon/ticker/month/day"),
    ("relationships", "v3/relationships", "anything"), ("pair_models", "v3/pair-models", "anything"),
    ("professional_news", "v4/professional-news", "ticker/month/day.csv"), ("events", "v4/events", "ticker/month/day.csv"),
    ("clean_features", "v4/features", "ticker/month/day.csv"), ("clean_pairs", "v4/option-pairs", "horizon/ticker/month/day"),
    ("clean_relationships", "v4/relationships", "anything"), ("clean_pair_models", "v4/pair-models", "anything"),
    ("legacy_models", "v3/models", "anything"), ("option_reference", "v5/option-reference", "ticker/month/day"),
    ("corporate_actions", "v5/corporate-actions", "ticker/month/day"), ("dividends", "v5/dividends", "ticker/month/day"),
    ("borrow", "v5/borrow", "ticker/month/day"), ("news_articles", "v5/news-articles", "ticker/month/day"),
    ("news_chunks", "v5/news-chunks", "ticker/month/day"), ("news_embeddings", "v5/news-embeddings", "ticker/month/day"),
    ("news_events", "v5/news-events", "ticker/month/day"), ("news_coverage", "v5/gpu-news-agent/receipts", "ticker/year/range"),
    ("daily_vectors", "v5/daily-vectors", "ticker/month/day"), ("daily_labels", "v5/daily-labels", "ticker/month/day"),
    ("exchange_calendar", "v5/exchange-calendar", "anything"), ("sector_factors", "v5/sector-factors", "ticker/month/day"),
    ("deep_relationships", "v5/deep-relationships", "anything"), ("fusion_models", "v5/fusion-models", "anything"),
    ("alpha_research", "v5/alpha-research", "anything"), ("paper_trading", "v5/paper-trading", "anything"),
    ("trading_control", "v5/trading-control", "anything"), ("monitoring", "v5/monitoring", "anything"),
)
ROOT = "market-data"


def scan_objects(spark: SparkSession, path: str) -> DataFrame:
    """Keys, sizes and times under a folder; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def _text_day(text: Column) -> Column:
    return F.try_to_date(F.replace(text, F.lit("/"), F.lit("-")), "yyyy-MM-dd")


def classify(objects: DataFrame, key: str = "key", datasets=DATASETS) -> DataFrame:
    """Dataset, ticker, horizon, dates and manifest flag of every key.

    A key's folder names its dataset (one map lookup per folder depth) and the
    dataset's layout decides which single pattern is applied to the rest, so the
    cost per key does not grow with the number of datasets.
    """
    known = F.create_map(*[x for name, folder, layout in datasets for x in (
        F.lit(folder), F.struct(F.lit(name).alias("name"), F.lit(layout).alias("layout"), F.lit(folder.count("/") + 1).alias("depth")))])
    depths = sorted({folder.count("/") + 1 for _, folder, _ in datasets}, reverse=True)
    d = objects.withColumn("_seg", F.split(F.regexp_extract(F.col(key), rf"^{ROOT}/(.*)$", 1), "/"))
    d = d.withColumn("_spec", F.coalesce(*[F.try_element_at(known, F.array_join(F.slice("_seg", 1, n), "/")) for n in depths]))
    d = d.withColumn("_tail", F.concat(F.lit("/"), F.array_join(F.slice("_seg", F.col("_spec.depth") + 1, F.size("_seg")), "/")))

    def parts(name: str, layout: Layout) -> Column:
        group = lambda i: F.nullif(F.regexp_extract("_tail", "^" + layout.pattern, i), F.lit("")) if i else F.lit(None).cast("string")
        days = [_text_day(group(i)) for i in layout.days] or [_text_day(F.regexp_extract("_tail", _DAY, 1))]
        return F.when((F.col("_spec.layout") == name) & F.col("_tail").rlike("^" + layout.pattern), F.struct(
            F.col("_spec.name").alias("dataset"), group(layout.ticker).alias("ticker"), group(layout.horizon).alias("horizon"),
            F.array_compact(F.array(*days)).alias("days")))
    d = d.withColumn("_m", F.coalesce(*[parts(n, x) for n, x in LAYOUTS.items()]))
    return d.select(*objects.columns, "_m.dataset", "_m.ticker", "_m.horizon", "_m.days", F.col(key).endswith("/manifest.json").alias("is_manifest"))


def summarise(classified: DataFrame, size: str = "size", modified: str = "last_modified") -> DataFrame:
    """Per dataset: objects, bytes, dates, tickers, horizons, manifests, modification span.

    Distinct dates and tickers come from a grouped, already distinct side table, so
    no set grows inside one aggregate.  Three branches read the classification, so
    it is written once."""
    known = cut(classified.select("dataset", "ticker", "days", "is_manifest", size, modified)).filter(F.col("dataset").isNotNull())
    base = known.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("objects"), F.sum(size).alias("bytes"), F.min(modified).alias("first_modified"),
        F.max(modified).alias("last_modified"), F.count_if("is_manifest").alias("manifests"))
    days = known.select("dataset", F.explode("days").alias("day")).distinct().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("date_count"), F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    tickers = known.filter(F.col("ticker").isNotNull()).select("dataset", "ticker").distinct().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("ticker_count"), F.array_sort(F.collect_list("ticker")).alias("tickers"))
    return base.join(days, "dataset", "left").join(tickers, "dataset", "left").fillna(0, ["date_count", "ticker_count"])


def weekdays(start: str, end: str) -> Column:
    return F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: F.weekday(d) < 5)


# How much evidence the observed calendar needs.
CALENDAR_SHARE, CALENDAR_FLOOR = 0.55, 3


def market_calendar(observed: DataFrame, *, day: str, start: str, end: str) -> DataFrame:
    """Trading days: the observed ones when they are enough, else all weekdays."""
    seen = observed.select(F.to_date(day).alias("day")).filter(
        F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()
    both = seen.agg(F.array_sort(F.collect_list("day")).alias("seen"), F.any_value(weekdays(start, end)).alias("_w"))
    both = both.withColumn("_w", weekdays(start, end))
    enough = F.size("seen") >= F.greatest(F.lit(CALENDAR_FLOOR), F.floor(F.size("_w") * CALENDAR_SHARE))
    return both.select(F.explode(F.when(enough, F.col("seen")).otherwise(F.col("_w"))).alias("day"),
                       F.when(enough, "observed").otherwise("weekdays").alias("basis"))


def expected_units(tickers: DataFrame, calendar: DataFrame, *, ticker: str, day: str) -> DataFrame:
    """Every ticker on every calendar day; the calendar rides along as one array
    (a few thousand days at most), so this is a projection."""
    days = calendar.agg(F.array_sort(F.collect_set(day)).alias("d")).scalar()
    return tickers.select(ticker).distinct().withColumn("_d", days).select(ticker, F.explode("_d").alias(day))


def missing_units(expected: DataFrame, present: DataFrame, *, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def coverage(expected: DataFrame, physical: DataFrame, receipts: DataFrame, *, ticker: str, day: str) -> DataFrame:
    """Per ticker: expected days, days on disk, days verified (disk or receipt), share."""
    on = [ticker, day]
    marks = physical.select(*on, F.lit(1).alias("_p"), F.lit(0).alias("_r")).unionByName(
        receipts.select(*on, F.lit(0).alias("_p"), F.lit(1).alias("_r"))).groupBy(*on).agg(F.max("_p").alias("_p"), F.max("_r").alias("_r"))
    d = expected.join(marks, on, "left").groupBy(ticker).agg(
        F.count(F.lit(1)).alias("expected_days"), F.coalesce(F.sum("_p"), F.lit(0)).alias("physical_days"),
        F.count_if(F.coalesce("_p", F.lit(0)) + F.coalesce("_r", F.lit(0)) > 0).alias("verified_days"))
    return d.withColumn("coverage_ratio", F.col("verified_days") / F.col("expected_days"))


def import_plan(expected: DataFrame, physical: DataFrame, receipts: DataFrame, *, ticker: str, day: str, size: str,
                legacy_days: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Per ticker: expected, present, legacy-assumed and remaining units, with a byte
    estimate from the mean stored unit."""
    on = [ticker, day]
    present = physical.select(*on).unionByName(receipts.select(*on)).distinct().withColumn("_have", F.lit(True))
    d = expected.join(present, on, "left")
    if legacy_days is not None:
        d = d.join(legacy_days.select(day).distinct().withColumn("_old", F.lit(True)), day, "left")
    else:
        d = d.withColumn("_old", F.lit(None).cast("boolean"))
    have = F.coalesce("_have", F.lit(False)) & F.lit(not force)
    old = ~have & F.coalesce("_old", F.lit(False)) & F.lit(not force)
    units = physical.agg(F.try_divide(F.sum(size).cast("double"), F.count_distinct(*on))).scalar()
    g = d.groupBy(ticker).agg(
        F.count(F.lit(1)).alias("expected_units"), F.count_if(have | old).alias("already_present"),
        F.count_if(old).alias("legacy_assumed"), F.count_if(~have & ~old).alias("remaining_units"))
    return g.withColumn("estimated_remaining_bytes", F.floor(F.col("remaining_units") * units).cast("long"))


# Readiness requirements (id, order, datasets, need, gate, start, tickers).
RESEARCH_START, NEWS_START = "2024-01-01", "2023-10-01"
BENCHMARKS = ("SPY", "QQQ")
_R = "verplicht"
_S = "sterk aanbevolen"
REQUIREMENTS = (
    ("stock_minute", 10, ("stocks",), _R, "training", RESEARCH_START, "all"),
    ("benchmarks", 20, ("stocks",), _R, "training", RESEARCH_START, "benchmarks"),
    ("option_minute", 30, ("options",), _R, "training", RESEARCH_START, "companies"),
    ("option_trades", 40, ("option_trades",), _R, "training", RESEARCH_START, "companies"),
    ("option_quotes", 50, ("quotes",), "later verplicht", "netto-uitkomst", RESEARCH_START, "companies"),
    ("contract_reference", 60, ("option_reference", "corporate_actions"), _R, "training", RESEARCH_START, "companies"),
    ("open_interest", 70, ("open_interest",), _S, "volwaardig model", RESEARCH_START, "companies"),
    ("risk_free", 80, ("macro",), _R, "training", RESEARCH_START, "none"),
    ("dividends_borrow", 90, ("dividends", "borrow"), _S, "volwaardig model", RESEARCH_START, "companies"),
    ("earnings", 100, ("earnings_processed",), _R, "training", RESEARCH_START, "companies"),
    ("news_raw", 110, ("news_articles",), _R, "vectorbouw", NEWS_START, "companies"),
    ("news_chunks", 120, ("news_chunks",), _R, "vectorbouw", NEWS_START, "companies"),
    ("news_embeddings", 130, ("news_embeddings",), _R, "vectorbouw", NEWS_START, "companies"),
    ("llm_events", 140, ("news_events",), _R, "vectorbouw", NEWS_START, "companies"),
    ("news_coverage", 145, ("news_coverage",), _R, "vectorbouw", NEWS_START, "companies"),
    ("clean_features", 150, ("clean_features",), _R, "vectorbouw", RESEARCH_START, "companies"),
    ("pairs", 160, ("clean_pairs",), _R, "vectorbouw", RESEARCH_START, "companies"),
    ("daily_vectors", 170, ("daily_vectors",), _R, "training", RESEARCH_START, "companies"),
    ("labels", 180, ("daily_labels", "clean_pairs"), _R, "training", RESEARCH_START, "companies"),
    ("quotes_layer", 190, ("quotes",), "gereserveerd", "C2", RESEARCH_START, "companies"),
    ("exchange_calendar", 200, ("exchange_calendar",), _S, "volwaardig model", RESEARCH_START, "none"),
    ("sector_factors", 210, ("sector_factors",), _S, "volwaardig model", RESEARCH_START, "companies"),
)
START_SLACK_DAYS, END_SLACK_DAYS = 14, 10


def readiness(summary: DataFrame, *, companies: list[str], end: str, requirements=REQUIREMENTS) -> DataFrame:
    """State of each requirement against the inventory; blockers first.

    The requirement list is fixed configuration of 22 rows, joined by dataset name.
    """
    wanted = {"all": [*companies, *[b for b in BENCHMARKS if b not in companies]], "benchmarks": list(BENCHMARKS),
              "companies": [c for c in companies if c not in BENCHMARKS], "none": []}
    spark = summary.sparkSession
    rows = [(rid, order, place, name, need, gate, start, wanted[mode])
            for rid, order, names, need, gate, start, mode in requirements for place, name in enumerate(names)]
    table = spark.createDataFrame(rows, "id string, `order` int, place int, dataset string, needed string, gate string, start string, wanted array<string>")
    have = summary.filter(F.col("objects") > 0).select("dataset", "objects", "bytes", "first_date", "last_date", "tickers")
    d = table.join(have, "dataset", "left")
    found = F.struct("dataset", "objects", "bytes", "first_date", "last_date", "tickers")
    first = F.min_by(F.when(F.col("objects").isNotNull(), found), F.when(F.col("objects").isNotNull(), F.col("place")))
    g = d.groupBy("id", "order", "needed", "gate", "start", "wanted").agg(first.alias("f"))
    gone = F.array_except("wanted", F.coalesce("f.tickers", F.array().cast("array<string>")))
    dates = (F.col("f.first_date") <= F.date_add(F.col("start").cast("date"), START_SLACK_DAYS)) & (
        F.col("f.last_date") >= F.date_sub(F.lit(end).cast("date"), END_SLACK_DAYS))
    state = (F.when(F.col("f").isNull(), F.when(F.col("needed").isin("gereserveerd", "later verplicht"), "uitgesteld").otherwise("ontbreekt"))
             .when(F.coalesce(dates, F.lit(False)) & (F.size(gone) == 0), "gereed").otherwise("gedeeltelijk"))
    out = g.select("id", "order", "needed", "gate", F.col("f.dataset").alias("dataset_found"), F.coalesce("f.objects", F.lit(0)).alias("objects"),
                   F.coalesce("f.bytes", F.lit(0)).alias("bytes"), "f.first_date", "f.last_date", gone.alias("missing_tickers"), state.alias("state"))
    out = out.withColumn("blocker", (F.col("needed") == _R) & F.col("gate").isin("training", "vectorbouw") & (F.col("state") != "gereed"))
    return out.orderBy(F.col("blocker").desc(), "order")


def gate(rows: DataFrame) -> DataFrame:
    """Overall verdict: score of required rows, blockers, vector and training ready."""
    need = F.col("needed") == _R
    return rows.agg(
        (F.count_if(need & (F.col("state") == "gereed")) / F.greatest(F.lit(1), F.count_if(need))).alias("readiness_score"),
        F.count_if("blocker").alias("blocker_count"), (F.count_if(F.col("blocker") & (F.col("gate") == "vectorbouw")) == 0).alias("vector_ready"),
        (F.count_if("blocker") == 0).alias("training_ready"))
