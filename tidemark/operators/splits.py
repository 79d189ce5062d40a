"""Chronological splits on whole sessions with purge and embargo.

All of them index a calendar (one row per session), which the calendar bounds,
and attach the result to the rows by an equality join on the session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WalkForward:
    """Default fold geometry in sessions."""
    min_train_sessions: int = 80
    test_sessions: int = 20
    purge_sessions: int = 5
    embargo_sessions: int = 1
    n_splits: int = 5
    holdout_fraction: float = 0.15
    minimum_holdout_sessions: int = 20


def calendar(rows: DataFrame, day: str) -> DataFrame:
    """Distinct sessions with position ``i`` (from 0) and total ``n``."""
    days = rows.filter(F.col(day).isNotNull()).select(day).distinct()
    w = Window.orderBy(day)
    return days.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy()))


def _int(x: Column) -> Column:
    return F.floor(x).cast("long")


def holdout_split(rows: DataFrame, *, day: str, config: WalkForward = WalkForward(), out: str = "part") -> DataFrame:
    """research / purged / holdout per session."""
    cal = calendar(rows, day)
    wanted = F.greatest(F.lit(config.minimum_holdout_sessions).cast("long"),
                        F.ceil(F.col("n") * config.holdout_fraction).cast("long"))
    edge = F.col("n") - wanted
    part = (F.when(F.col("i") >= edge, "holdout")
            .when(F.col("i") < edge - config.purge_sessions, "research").otherwise("purged"))
    return rows.join(cal.select(day, part.alias(out)), day)


def walk_forward_folds(rows: DataFrame, *, day: str, config: WalkForward = WalkForward()) -> DataFrame:
    """Every row once per fold and role (train/test) it has; folds are purged before
    and embargoed after the cut, and picked evenly when there are more than wanted."""
    c = config
    first = c.min_train_sessions + c.purge_sessions
    width = c.embargo_sessions + c.test_sessions
    n = F.col("n")
    count = F.greatest(_int((n - width - first) / width) + 1, F.lit(0))
    k = F.least(count, F.lit(c.n_splits).cast("long"))
    starts = F.when(
        count > c.n_splits,
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(c.n_splits - 1)), lambda s: first + width * _int(
            s * (count - 1) / F.lit(float(max(c.n_splits - 1, 1)))))),
    ).when(k > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), lambda s: first + width * (s - 1)))
    numbered = F.transform(starts, lambda s, i: F.struct((i + 1).alias("fold"), s.cast("long").alias("start")))
    i = F.col("i")
    roles = F.flatten(F.transform(numbered, lambda f: F.array(
        F.struct(f["fold"].alias("fold"), F.lit("train").alias("role"), (i < f["start"] - c.purge_sessions).alias("has")),
        F.struct(f["fold"].alias("fold"), F.lit("test").alias("role"),
                 ((i >= f["start"] + c.embargo_sessions)
                  & (i < f["start"] + c.embargo_sessions + c.test_sessions)).alias("has")))))
    days = calendar(rows, day).select(day, F.inline(F.filter(roles, lambda x: x["has"]))).drop("has")
    return rows.join(days, day)


def time_partitions(rows: DataFrame, *, day: str, shares: dict[str, float], purge: int = 0,
                    out: str = "part") -> DataFrame:
    """Consecutive partitions on whole sessions by share; ``purge`` sessions before
    each later partition are set aside."""
    cal = calendar(rows, day)
    cuts, total = [], 0.0
    for name, share in shares.items():
        total += share
        cuts.append((name, total))
    part = None
    for index, (name, top) in enumerate(cuts):
        end = F.col("n") if index == len(cuts) - 1 else _int(F.col("n") * F.lit(round(top, 10)))
        keep = F.col("i") < (end if index == len(cuts) - 1 else end - purge)
        label = F.when(keep, name).otherwise("purged")
        part = F.when(F.col("i") < end, label) if part is None else part.when(F.col("i") < end, label)
    return rows.join(cal.select(day, part.alias(out)), day)


def row_share_splits(rows: DataFrame, *, order: list[str], bucket: str, shares: dict[str, float],
                     out: str = "part") -> DataFrame:
    """Partitions by share of *rows* in time order (may cut inside a session)."""
    from tidemark.operators.ordered import running_sum
    d = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), keys=[], bucket=bucket, order=order,
                    value="_one", out="_pos")
    d = d.withColumn("_n", rows.agg(F.count(F.lit(1)).alias("n")).scalar())
    part, total = None, 0.0
    names = list(shares.items())
    for index, (name, share) in enumerate(names):
        total += share
        if index == len(names) - 1:
            part = part.otherwise(name) if part is not None else F.lit(name)
        else:
            here = F.col("_pos") <= _int(F.col("_n") * F.lit(round(total, 10)))
            part = F.when(here, name) if part is None else part.when(here, name)
    return d.withColumn(out, part).drop("_one", "_pos", "_n")


# Row-count folds.
ROW_FOLDS, ROW_PURGE, ROW_TRAIN_SHARE = 5, 5, 0.40
LEAST_ROWS, LEAST_FIRST, LEAST_TRAIN, LEAST_WIDTH, LEAST_TEST = 100, 30, 30, 20, 10


def row_fold_ranges(n: int, *, folds: int = ROW_FOLDS, purge: int = ROW_PURGE, train_share: float = ROW_TRAIN_SHARE) -> list[tuple[int, int, int]]:
    """(end of train, start of test, end of test) of each fold of n rows in time order."""
    if n < LEAST_ROWS:
        return []
    first = max(LEAST_FIRST, int(n * train_share))
    width = max(LEAST_WIDTH, (n - first) // max(1, folds))
    found = [(max(0, start - purge), start, min(n, start + width)) for start in range(first, n, width)]
    return [f for f in found if f[0] >= LEAST_TRAIN and f[2] - f[1] >= LEAST_TEST][:folds]


def row_walk_forward(rows: DataFrame, *, order: list[str], bucket: str, folds: int = ROW_FOLDS, purge: int = ROW_PURGE, train_share: float = ROW_TRAIN_SHARE) -> DataFrame:
    """Every row once per fold and role it has, folds counted in *rows* of the whole table.

    Row numbers come from totals by ``bucket``, which must not decrease in ``order``, and
    places inside it, so no task orders the table; only its row count comes to the driver.
    """
    from tidemark.operators.ordered import running_sum
    ranges = row_fold_ranges(rows.count(), folds=folds, purge=purge, train_share=train_share)
    d = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), keys=[], bucket=bucket, order=order, value="_one", out="_pos").withColumn("_pos", F.col("_pos") - 1)
    at = F.col("_pos")
    roles = [F.struct(F.lit(k).cast("long").alias("fold"), F.lit(role).alias("role"), has.alias("has")) for k, (end, start, stop) in enumerate(ranges, 1)
             for role, has in (("train", at < end), ("test", (at >= start) & (at < stop)))]
    if not roles:
        return rows.limit(0).withColumns({"fold": F.lit(0).cast("long"), "role": F.lit("")})
    return d.select("*", F.inline(F.filter(F.array(*roles), lambda x: x["has"]))).drop("_one", "_pos", "has")
