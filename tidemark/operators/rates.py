"""Reference series: forward-filled rates, their as-of value, and epoch units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import epoch_to_timestamp, epoch_unit
from tidemark.operators.asof import asof

YEAR_SECONDS = 366 * 86_400


def fill_forward(series: DataFrame, *, date: str, rate: str) -> DataFrame:
    """Percent to fraction with gaps filled.  The series has one row per calendar
    day, so its single ordered window is bounded by the calendar, not the data."""
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(rate, F.last(rate, ignorenulls=True).over(w) / 100)


def rate_for_days(days: DataFrame, series: DataFrame, *, day: str, date: str, rate: str, out: str) -> DataFrame:
    """Last known rate with date <= day, else zero."""
    known = series.filter(F.col(rate).isNotNull()).select(date, F.col(rate).alias(out))
    matched = asof(days, known, keys=[], left_time=day, right_time=date, take=[out], bucket_seconds=YEAR_SECONDS)
    return matched.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def infer_timestamps(frame: DataFrame, *, keys: list[str], raw: str, out: str) -> DataFrame:
    """Epoch column of unknown unit to a timestamp, one unit per feed.

    The unit only needs the magnitude of the median, and the thresholds are five
    orders apart, so an approximate median (constant state per feed) is exact here.
    """
    units = frame.groupBy(*keys).agg(epoch_unit(F.percentile_approx(raw, 0.5, 1000)).alias("unit"))
    return frame.join(units, keys).withColumn(out, epoch_to_timestamp(F.col(raw), F.col("unit")))
