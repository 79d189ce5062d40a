"""Event engine: rows where something happened, folded to one row per ticker-minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The flags in label order and the minute measures by fold.
EVENT_FLAGS = (
    "event_stock_breakout_up_30m", "event_stock_breakdown_30m", "event_high_realized_vol",
    "event_stock_volume_spike", "event_option_jump_up", "event_option_jump_down",
    "event_earnings_within_5d",
)
FOLD_BY_MAX = ("news_count_60m", "event_importance_60m", "bullish_signal_60m",
               "bearish_signal_60m", "realized_vol_30m", "stock_volume_z30")
FOLD_BY_MEAN = ("sentiment_60m", "stock_return_30m", "days_to_earnings", "close_stock")


def detect_events(features: DataFrame, *, keys: list[str], ts: str = "ts") -> DataFrame:
    """Keep rows with any flag or recent news; fold per minute; name what was hit."""
    have = set(features.columns)
    flags = [c for c in EVENT_FLAGS if c in have]
    highs = [c for c in FOLD_BY_MAX if c in have]
    means = [c for c in FOLD_BY_MEAN if c in have]
    # close_stock is a price: missing stays missing; the others count as zero.
    filled = features.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*flags, *highs, *means] if c != "close_stock"})
    signs = [F.col(c) for c in flags]
    if "news_count_60m" in have:
        signs.append((F.col("news_count_60m") > 0).cast("double"))
    strength = F.greatest(*signs, F.lit(0.0))
    hits = filled.filter(strength > 0)
    folded = hits.groupBy(*keys, F.date_trunc("minute", F.col(ts)).alias("minute")).agg(
        *[F.max(c).alias(c) for c in [*flags, *highs]], *[F.avg(c).alias(c) for c in means])
    names = [F.when(F.col(c) > 0, F.lit(c.removeprefix("event_"))) for c in flags]
    if "news_count_60m" in have:
        names.append(F.when(F.col("news_count_60m") > 0, F.lit("professional_news")))
    return folded.withColumn("event_labels", F.array_join(F.array_compact(F.array(*names)), "|"))
