"""Rolling news windows and their as-of join onto market rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY_SECONDS, asof, micros

# Window lengths in minutes and the news categories.
NEWS_WINDOWS = {"15m": 15, "60m": 60}
NEWS_CATEGORIES = ("earnings", "guidance", "analyst", "product", "legal_regulatory", "mna", "management", "macro")
WINDOW_MEANS = {"sentiment": "sentiment_score", "emotion": "emotion_intensity", "surprise": "surprise_score",
                "source_quality": "source_quality", "event_importance": "event_importance"}
WINDOW_SUMS = {"bullish_signal": "bullish_signal", "bearish_signal": "bearish_signal",
               "official_source_count": "is_official_source", "professional_source_count": "is_professional_source"}


def news_columns(frame: DataFrame) -> DataFrame:
    """The numeric news columns, absent or missing counting as zero; the model score
    is preferred to the lexicon score."""
    have = set(frame.columns)
    score = [F.col(c).try_cast("double") for c in ("gpu_sentiment_score", "sentiment_score") if c in have]
    columns: dict[str, Column] = {"sentiment_score": F.coalesce(*(score[:1] or [F.lit(0.0)]), F.lit(0.0))}
    for name in [*WINDOW_MEANS.values(), *WINDOW_SUMS.values()]:
        if name != "sentiment_score":
            columns[name] = F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)
    if "event_category" not in have:
        columns["event_category"] = F.lit("other")
    return frame.withColumns(columns)


def rolling_news(articles: DataFrame, *, keys: list[str], published: str, minutes: int,
                 means: dict[str, str], sums: dict[str, str] | None = None, count: str | None = None,
                 categories: tuple[str, ...] = (), label: str | None = None,
                 bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Per article: statistics of the window that ends at it, both ends included.

    A busy ticker is cut into time buckets; articles near the end of a bucket are
    lent to the next one so its windows are whole.
    """
    label = label or f"{minutes}m"
    span = minutes * 60_000_000
    width = bucket_seconds * 1_000_000
    reach = -(-span // width)
    d = articles.withColumn("_t", micros(published))
    own = F.floor(F.col("_t") / width).cast("long")
    # buckets whose windows can reach back to this article
    last = F.floor((F.col("_t") + span) / width).cast("long")
    d = d.withColumn("_own", own).withColumn(
        "_bucket", F.explode(F.sequence(own, F.least(last, own + F.lit(reach)))))
    frame = Window.partitionBy(*keys, "_bucket").orderBy("_t").rangeBetween(-span, 0)
    outs = [F.avg(c).over(frame).alias(f"{n}_{label}") for n, c in means.items()]
    outs += [F.sum(c).over(frame).alias(f"{n}_{label}") for n, c in (sums or {}).items()]
    if count:
        outs.append(F.count(count).over(frame).alias(f"news_count_{label}"))
    outs += [F.sum((F.col("event_category") == c).cast("double")).over(frame).alias(f"{c}_news_{label}")
             for c in categories]
    return d.select(*articles.columns, *outs, "_own", "_bucket").filter(
        F.col("_own") == F.col("_bucket")).drop("_own", "_bucket")


def attach_latest(rows: DataFrame, articles: DataFrame, *, keys: list[str], ts: str, published: str,
                  take: list[str], tie: list[str], bucket_seconds: int = DAY_SECONDS,
                  max_age_seconds: float | None = None, gap: str | None = None) -> DataFrame:
    """Newest article known at each row; it stays until the next unless a maximum
    age is given."""
    return asof(rows, articles, keys=keys, left_time=ts, right_time=published, tolerance_seconds=max_age_seconds,
                take=take, tie=tie, bucket_seconds=bucket_seconds, gap=gap)


NEWS_FEATURES = ("sentiment_latest", "sentiment_15m", "news_count_15m", "news_count_60m",
                 *[f"{n}_60m" for n in [*WINDOW_MEANS, *WINDOW_SUMS]], *[f"{c}_news_60m" for c in NEWS_CATEGORIES])


def news_states(articles: DataFrame, *, keys: list[str], published: str) -> DataFrame:
    """Articles with ``NEWS_FEATURES``, what is known at each: its sentiment and the 15 and 60 minute windows."""
    d = news_columns(articles)
    short = {n: c for n, c in WINDOW_MEANS.items() if n in ("sentiment", "emotion", "surprise")}
    d = rolling_news(d, keys=keys, published=published, minutes=NEWS_WINDOWS["15m"], means=short,
                     count="sentiment_score")
    d = rolling_news(d, keys=keys, published=published, minutes=NEWS_WINDOWS["60m"], means=WINDOW_MEANS,
                     sums=WINDOW_SUMS, count="sentiment_score", categories=NEWS_CATEGORIES)
    return d.withColumn("sentiment_latest", F.col("sentiment_score"))


def news_features(rows: DataFrame, articles: DataFrame, *, keys: list[str], ts: str, published: str,
                  tie: list[str]) -> DataFrame:
    """Latest sentiment plus the 15 and 60 minute windows, one as-of join for all."""
    d = news_states(articles, keys=keys, published=published)
    return attach_latest(rows, d, keys=keys, ts=ts, published=published, take=list(NEWS_FEATURES), tie=tie)
