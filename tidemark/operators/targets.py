"""Targets by time, never by row count: intraday horizons, later sessions, closes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import local_day, local_minute_of_day, market_close
from tidemark.operators.asof import asof
from tidemark.schema import clip, ratio


@dataclass(frozen=True)
class Horizon:
    code: str
    kind: str
    value: int
    equivalent_market_minutes: int


# The horizons, intraday tolerance and the session-gap limits in calendar days.
HORIZONS = (
    Horizon("M15", "minutes", 15, 15), Horizon("M30", "minutes", 30, 30), Horizon("H1", "minutes", 60, 60),
    Horizon("H2", "minutes", 120, 120), Horizon("H4", "minutes", 240, 240), Horizon("D1", "sessions", 1, 390),
    Horizon("D2", "sessions", 2, 780), Horizon("D3", "sessions", 3, 1170), Horizon("W1", "sessions", 5, 1950),
)
SESSION_GAP_DAYS = {1: 4, 2: 5, 3: 7, 5: 10}
TOLERANCE_FLOOR_MINUTES = 5
TOLERANCE_SHARE = 0.12
TARGET_CLIP = (-3.0, 3.0)
CLOSE_STALENESS_MINUTES = 30
NEAREST_TOLERANCE_MINUTES = 10


def intraday_tolerance(minutes: int) -> int:
    return max(TOLERANCE_FLOOR_MINUTES, int(minutes * TOLERANCE_SHARE))


def forward_target(left: DataFrame, right: DataFrame, *, keys: list[str], ts: str, minutes: int,
                   take: list[str], tie: list[str], tolerance_minutes: float = 5,
                   target_time: str = "target_ts") -> DataFrame:
    """Same-key value at ``ts + minutes`` or the first within tolerance after it."""
    wanted = left.withColumn("_wanted", F.timestamp_micros(
        F.unix_micros(ts) + F.lit(minutes * 60_000_000)))
    stamped = right.withColumn(target_time, F.col(ts))
    return asof(wanted, stamped, keys=keys, left_time="_wanted", right_time=ts, direction="forward",
                tolerance_seconds=tolerance_minutes * 60, tie=tie, take=[target_time, *take]).drop("_wanted")


def intraday_targets(rows: DataFrame, *, keys: list[str], ts: str, take: dict[str, str], tie: list[str],
                     horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """Every row at every intraday horizon with its target (null beyond tolerance).

    Rows fan out over the few horizons; the right side is laid in once, because
    the horizon only moves the wanted time, not the key.
    """
    chosen = [h for h in horizons if h.kind == "minutes"]
    specs = F.array(*[F.struct(
        F.lit(h.code).alias("code"), F.lit(h.value).alias("minutes"),
        F.lit(intraday_tolerance(h.value)).alias("tolerance"),
        F.lit(h.equivalent_market_minutes).alias("equivalent")) for h in chosen])
    fanned = rows.withColumn("_h", F.explode(specs)).select(
        *rows.columns, F.col("_h.code").alias("target_horizon"),
        F.col("_h.equivalent").alias("horizon_equivalent_market_minutes"),
        (F.col("_h.tolerance").cast("long") * 60).alias("_tolerance"),
        F.timestamp_micros(F.unix_micros(ts) + F.col("_h.minutes").cast("long") * 60_000_000).alias("_wanted"))
    future = rows.select(*keys, ts, *tie, F.col(ts).alias("target_ts"),
                         *[F.col(c).alias(n) for c, n in take.items()])
    matched = asof(
        fanned, future, keys=keys, left_time="_wanted", right_time=ts, direction="forward",
        tolerance_seconds=F.col("_tolerance"),
        max_tolerance_seconds=max(intraday_tolerance(h.value) for h in chosen) * 60,
        tie=tie, take=["target_ts", *take.values()])
    return matched.drop("_wanted", "_tolerance")


def horizon_columns(frame: DataFrame, horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """Equivalent minutes, their log and the session flag of each row's horizon."""
    table = F.create_map(*[x for h in horizons for x in (
        F.lit(h.code), F.struct(F.lit(h.equivalent_market_minutes).alias("m"), F.lit(h.kind == "sessions").alias("s")))])
    spec = F.element_at(table, F.col("target_horizon"))
    return frame.withColumns({
        "horizon_equivalent_market_minutes": spec["m"],
        "horizon_log_minutes": F.log1p(spec["m"].cast("double")),
        "horizon_is_session": spec["s"].cast("double"),
    })


def return_between(now: Column, later: Column, bounded: bool = False) -> Column:
    move = ratio(later, now) - 1
    return clip(move, *TARGET_CLIP) if bounded else move


def later_sessions(days: DataFrame, *, keys: list[str], day: str,
                   horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """(key, day) with the n-th later *observed* session, gaps beyond the limit dropped.

    ``days`` is one row per key and session, so the window holds sessions, not rows.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    steps = [h for h in horizons if h.kind == "sessions"]
    ahead = days.select(*keys, day, *[F.lead(day, h.value).over(w).alias(h.code) for h in steps])
    options = F.array(*[F.struct(
        F.lit(h.code).alias("target_horizon"), F.lit(h.value).alias("sessions_ahead"),
        F.lit(SESSION_GAP_DAYS.get(h.value, h.value + 5)).alias("limit"),
        F.col(h.code).alias("target_day")) for h in steps])
    return (ahead.select(*keys, day, F.inline(options))
            .filter(F.datediff("target_day", day) <= F.col("limit")).drop("limit"))


def session_targets(rows: DataFrame, *, keys: list[str], day: str, take: dict[str, str],
                    horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """Daily rows joined with the same key's row on each later session."""
    calendar = later_sessions(rows.select(*keys, day).distinct(), keys=keys, day=day, horizons=horizons)
    future = rows.select(*keys, F.col(day).alias("target_day"), *[F.col(c).alias(n) for c, n in take.items()])
    return rows.join(calendar, [*keys, day]).join(future, [*keys, "target_day"])


def close_anchor(rows: DataFrame, *, keys: list[str], ts: str, tie: list[str],
                 staleness_minutes: float = CLOSE_STALENESS_MINUTES) -> DataFrame:
    """Last row of each key before the market close of its local day, re-stamped to
    the close; older than ``staleness_minutes`` is dropped."""
    close = market_close(F.col("local_day"))
    before = rows.withColumn("local_day", local_day(F.col(ts))).filter(F.col(ts) <= close)
    last = before.groupBy(*keys, "local_day").agg(
        F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(ts, *tie)).alias("_row"))
    kept = last.select(
        "local_day", F.col("_row.*"), F.col(f"_row.{ts}").alias("source_observed_at"),
        ((F.unix_micros(close) - F.unix_micros(F.col(f"_row.{ts}"))) / 60e6).alias("source_staleness_minutes"))
    return kept.filter(F.col("source_staleness_minutes").between(0, staleness_minutes)).withColumn(
        ts, market_close(F.col("local_day")))


def close_rows(rows: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key."""
    last = rows.groupBy(*keys).agg(F.max_by(
        F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*")


def near_the_money(rows: DataFrame, *, keys: list[str], strike: str, spot: str, dte: str,
                   tie: list[str]) -> DataFrame:
    """One unit per key: smallest distance of strike to spot, then nearest expiry."""
    distance = F.abs(ratio(F.col(strike), F.col(spot)) - 1)
    usable = rows.withColumn("_distance", distance).filter(
        F.col("_distance").isNotNull() & (F.col(dte) > 0))
    picked = usable.groupBy(*keys).agg(F.min_by(
        F.struct(*[F.col(c) for c in rows.columns if c not in keys]),
        F.struct("_distance", dte, *tie)).alias("_row"))
    return picked.select(*keys, "_row.*")


def nearest_minute(anchor: DataFrame, target: DataFrame, *, keys: list[str], ts: str, take: list[str],
                   tie: list[str], tolerance_minutes: int = NEAREST_TOLERANCE_MINUTES) -> DataFrame:
    """Match by New York minute of day, whatever the date; nearest within tolerance.

    ``keys`` should name the session to match with, so that a key holds one day of
    minutes; hours are the buckets.
    """
    minute = lambda f: f.withColumn(
        "market_minute", F.timestamp_seconds(local_minute_of_day(F.col(ts)) * 60))
    return asof(minute(anchor), minute(target), keys=keys, left_time="market_minute", right_time="market_minute",
                direction="nearest", tolerance_seconds=tolerance_minutes * 60, tie=tie, take=take, bucket_seconds=3600)


def session_minute_targets(rows: DataFrame, *, keys: list[str], calendar_keys: list[str], ts: str, day: str, take: dict[str, str], tie: list[str],
                           horizons: tuple[Horizon, ...] = HORIZONS, tolerance_minutes: int = NEAREST_TOLERANCE_MINUTES) -> DataFrame:
    """Rows at every session horizon with the same key's row nearest in the market's
    minute of day on the n-th later observed session of ``calendar_keys``.

    Rows without such a session, or with too wide a calendar gap to it, have no row at
    that horizon; without a row within ``tolerance_minutes`` there the target is null.
    """
    calendar = later_sessions(rows.select(*calendar_keys, day).distinct(), keys=calendar_keys, day=day, horizons=horizons)
    anchor = rows.join(calendar, [*calendar_keys, day])
    future = rows.select(*keys, F.col(day).alias("target_day"), ts, *tie, F.col(ts).alias("target_ts"), *[F.col(c).alias(n) for c, n in take.items() if n not in tie])
    return nearest_minute(anchor, future, keys=[*keys, "target_day"], ts=ts, take=["target_ts", *take.values()], tie=tie,
                          tolerance_minutes=tolerance_minutes).drop("market_minute")


def daily_median(rows: DataFrame, *, keys: list[str], values: list[str], latest: str) -> DataFrame:
    """Median per ticker-day.  The exact median holds one group's distinct values,
    which a day of minutes bounds."""
    return rows.groupBy(*keys).agg(*[F.median(c).alias(c) for c in values], F.max(latest).alias(latest))


def stack_horizons(frames: list[DataFrame]) -> DataFrame:
    """Union of horizon tables whose columns differ."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
