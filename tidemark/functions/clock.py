"""Market clocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
# The close, and release labels with their local hour.
CLOSE_MINUTE = 16 * 60
RELEASE_MINUTES = {"bmo": 8 * 60, "amc": 16 * 60 + 5, "dmh": 12 * 60}


def local_instant(day: Column, minute_of_day: Column | int) -> Column:
    """UTC instant of a New York wall-clock minute on ``day`` (DST-aware)."""
    minute = F.lit(minute_of_day) if isinstance(minute_of_day, int) else minute_of_day
    wall = day.cast("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))
    return F.to_utc_timestamp(wall, MARKET_ZONE)


def market_close(day: Column) -> Column:
    return local_instant(day, CLOSE_MINUTE)


def local_minute_of_day(instant: Column) -> Column:
    wall = F.from_utc_timestamp(instant, MARKET_ZONE)
    return F.hour(wall) * 60 + F.minute(wall)


def local_day(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, MARKET_ZONE))


def epoch_unit(median: Column) -> Column:
    """Unit of an epoch column judged by its median magnitude."""
    return F.when(median > 1e16, "ns").when(median > 1e11, "ms").otherwise("s")


def epoch_to_timestamp(value: Column, unit: Column) -> Column:
    micros = (F.when(unit == "ns", F.floor(value / 1000)).when(unit == "ms", value * 1000)
              .otherwise(value * 1_000_000))
    return F.timestamp_micros(micros.cast("long"))


def stamp(column: Column) -> Column:
    """Readable UTC text of an instant, to the microsecond."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
