"""As-of joins: one shuffle, no inequality join, no key held by one task.

Both sides are laid into one time line per key and the match is read with a
window function.  The time line of a key is cut into buckets, so the window
partition is ``(key, bucket)`` and a key with a third of all rows still spreads
over as many tasks as it has buckets.  What a bucket needs from its neighbours
is one row: the last (backward) or first (forward) right row outside it.  Those
rows are aggregated per bucket with map-side combine and put into the time line
as extra right rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def micros(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: list[str],
    left_time: str,
    right_time: str,
    direction: str = "backward",
    tolerance_seconds: float | Column | None = None,
    tie: list[str] | None = None,
    take: list[str] | None = None,
    bucket_seconds: int = DAY_SECONDS,
    max_tolerance_seconds: float | None = None,
    gap: str | None = None,
) -> DataFrame:
    """Attach to every left row the right row nearest in time on the allowed side.

    * exact time matches count; left rows are never dropped or multiplied;
    * equal right times: backward takes the last by ``tie``, forward the first,
      nearest the last of the earlier side; a nearest tie goes backward;
    * ``tolerance_seconds`` is inclusive and may be a column of the left row
      (then give ``max_tolerance_seconds``); beyond it the right columns are null;
    * ``take`` names the right columns wanted (prunes the shuffle).
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    tie = tie or []
    take = take if take is not None else [c for c in right.columns if c not in keys]
    width = bucket_seconds * 1_000_000
    reach = max_tolerance_seconds
    if reach is None and isinstance(tolerance_seconds, (int, float)):
        reach = float(tolerance_seconds)

    payload = F.struct(
        F.lit(True).alias("_hit"), F.col("_t").alias("_rt"),
        *[F.col(c).alias(c) for c in take],
    )
    rank = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("none"))
    rights = right.withColumn("_t", micros(right_time))
    for needed in ["_t", *keys]:
        rights = rights.filter(F.col(needed).isNotNull())
    rights = rights.select(
        *keys, F.floor(F.col("_t") / width).cast("long").alias("_bucket"), "_t",
        rank.alias("_tie"), payload.alias("_r"),
    )
    tie_type = rights.schema["_tie"].dataType
    payload_type = rights.schema["_r"].dataType

    lefts = left.select(
        *keys, F.struct(*[F.col(c) for c in left.columns]).alias("_l"), micros(left_time).alias("_t"),
    ).select(*keys, F.floor(F.col("_t") / width).cast("long").alias("_bucket"), "_t", "_l")

    line = lefts.select(
        *keys, "_bucket", "_t", F.lit(1).alias("_side"),
        F.lit(None).cast(tie_type).alias("_tie"), "_l", F.lit(None).cast(payload_type).alias("_r"),
    )
    own = rights.select(
        *keys, "_bucket", "_t", F.lit(0).alias("_side"), "_tie",
        F.lit(None).cast(line.schema["_l"].dataType).alias("_l"), "_r",
    )
    line = line.unionByName(own)
    for look in (["backward"] if direction == "backward" else ["forward"] if direction == "forward"
                 else ["backward", "forward"]):
        carried = _carry(lefts, rights, keys, look, reach, bucket_seconds)
        line = line.unionByName(carried.select(
            *keys, "_bucket", "_t", F.lit(0).alias("_side"), "_tie",
            F.lit(None).cast(line.schema["_l"].dataType).alias("_l"), "_r",
        ))

    # Either way a right row is read before a left row of the same instant, so exact
    # matches count.  Looking forward is looking back along the reversed time line:
    # a frame that only grows costs one pass, one that shrinks would restart per row.
    part = Window.partitionBy(*keys, "_bucket")
    upto = (Window.unboundedPreceding, 0)
    before = F.last("_r", ignorenulls=True).over(
        part.orderBy(F.col("_t").asc(), F.col("_side").asc(), F.col("_tie").asc()).rowsBetween(*upto))
    after = F.last("_r", ignorenulls=True).over(
        part.orderBy(F.col("_t").desc(), F.col("_side").asc(), F.col("_tie").desc()).rowsBetween(*upto))
    if direction == "backward":
        line = line.withColumn("_m", before)
    elif direction == "forward":
        line = line.withColumn("_m", after)
    else:
        line = line.withColumn("_b", before).withColumn("_f", after).withColumn(
            "_m",
            F.when(F.col("_b").isNull(), F.col("_f"))
            .when(F.col("_f").isNull(), F.col("_b"))
            .when((F.col("_f._rt") - F.col("_t")) < (F.col("_t") - F.col("_b._rt")), F.col("_f"))
            .otherwise(F.col("_b")),
        )
    matched = line.filter(F.col("_side") == 1)
    distance = F.abs(F.col("_t") - F.col("_m._rt"))
    if tolerance_seconds is not None:
        limit = (F.lit(int(tolerance_seconds * 1_000_000)) if isinstance(tolerance_seconds, (int, float))
                 else (tolerance_seconds * 1_000_000))
        matched = matched.select("*", F.col("_l.*")) if not isinstance(tolerance_seconds, (int, float)) else matched
        matched = matched.withColumn("_m", F.when(distance <= limit, F.col("_m")))
    out = [F.col(f"_l.{c}").alias(c) for c in left.columns]
    out += [F.col(f"_m.{c}").alias(c) for c in take]
    if gap:
        out.append((distance / F.lit(1_000_000.0)).alias(gap))
    return matched.select(*out)


def _carry(lefts, rights, keys, look, reach, bucket_seconds):
    """The one right row each bucket needs from outside, stamped into that bucket."""
    stamp = F.struct("_t", "_tie")
    pick = F.max_by if look == "backward" else F.min_by
    edge = rights.groupBy(*keys, "_bucket").agg(
        pick(F.struct("_t", "_tie", "_r"), stamp).alias("_edge"))
    if reach is not None and reach <= bucket_seconds:
        # Nothing further than the neighbouring bucket can be within tolerance.
        step = 1 if look == "backward" else -1
        moved = edge.withColumn("_bucket", F.col("_bucket") + F.lit(step).cast("long"))
    else:
        # Any distance: run over the short per-key list of occupied buckets.
        asked = lefts.filter(F.col("_t").isNotNull()).groupBy(*keys, "_bucket").agg(
            F.lit(None).cast(edge.schema["_edge"].dataType).alias("_edge"))
        buckets = edge.unionByName(asked).groupBy(*keys, "_bucket").agg(
            F.max_by("_edge", F.col("_edge").isNotNull()).alias("_edge"))
        along = F.col("_bucket").asc() if look == "backward" else F.col("_bucket").desc()
        seen = F.last("_edge", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
        moved = buckets.select(*keys, "_bucket", seen.alias("_edge")).filter(F.col("_edge").isNotNull())
    return moved.select(*keys, "_bucket", "_edge._t", "_edge._tie", "_edge._r")


@dataclass(frozen=True)
class Source:
    """A right side of ``asof_many``: ``take`` columns of the row last known by ``time``."""
    frame: DataFrame
    time: str
    take: tuple[str, ...]
    tie: tuple[str, ...] = ()
    tolerance_seconds: float | None = None


def asof_many(left: DataFrame, sources: list[Source], *, keys: list[str], left_time: str, bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Attach to every left row the last row of each source up to its time.

    All sources are laid into one time line with one running last row each, so any
    number of them costs one shuffle of each side and one sort.  Matching is as in
    ``asof`` looking backward: exact times count, equal times go by ``tie``, a source's
    columns are null beyond its tolerance, left rows stay as they are.  ``take`` names
    must differ between sources.
    """
    width = bucket_seconds * 1_000_000
    bucket = F.floor(F.col("_t") / width).cast("long").alias("_bucket")
    held, ties, rights = [], [], []
    for n, s in enumerate(sources):
        d = s.frame.withColumn("_t", micros(s.time))
        for needed in ["_t", *keys]:
            d = d.filter(F.col(needed).isNotNull())
        rank = F.struct(*[F.col(c) for c in s.tie]) if s.tie else F.struct(F.lit(0).alias("none"))
        rights.append(d.select(*keys, bucket, "_t", rank.alias(f"_o{n}"), F.struct(F.col("_t").alias("_rt"), *[F.col(c) for c in s.take]).alias(f"_r{n}")))
        held.append((f"_r{n}", rights[n].schema[f"_r{n}"].dataType))
        ties.append((f"_o{n}", rights[n].schema[f"_o{n}"].dataType))
    lefts = left.select(*keys, F.struct(*[F.col(c) for c in left.columns]).alias("_l"), micros(left_time).alias("_t")).select(*keys, bucket, "_t", "_l")
    empty = {n: F.lit(None).cast(kind) for n, kind in [*held, *ties]} | {"_l": F.lit(None).cast(lefts.schema["_l"].dataType)}

    def filled(frame: DataFrame, side: int) -> DataFrame:
        return frame.select(*keys, "_bucket", "_t", F.lit(side).alias("_side"), *[(F.col(n) if n in frame.columns else value).alias(n) for n, value in empty.items()])
    known = filled(rights[0], 0)
    for other in rights[1:]:
        known = known.unionByName(filled(other, 0))
    # What a bucket needs from before it: the last row of every source, in one row.
    edges = known.groupBy(*keys, "_bucket").agg(*[F.max_by(F.col(r), F.when(F.col(r).isNotNull(), F.struct("_t", o))).alias(r) for (r, _), (o, _) in zip(held, ties)])
    asked = lefts.filter(F.col("_t").isNotNull()).select(*keys, "_bucket").distinct().select("*", *[empty[r].alias(r) for r, _ in held])
    buckets = edges.unionByName(asked).groupBy(*keys, "_bucket").agg(*[F.max_by(F.col(r), F.when(F.col(r).isNotNull(), F.lit(1))).alias(r) for r, _ in held])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, "_bucket", (F.col("_bucket") * width).alias("_t"), *[F.last(r, ignorenulls=True).over(before).alias(r) for r, _ in held])
    line = known.unionByName(filled(carried, -1)).unionByName(filled(lefts, 1))
    order = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_t").asc_nulls_first(), "_side", *[o for o, _ in ties]).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({r: F.last(r, ignorenulls=True).over(order) for r, _ in held}).filter(F.col("_side") == 1)
    out = [F.col(f"_l.{c}").alias(c) for c in left.columns]
    for (r, _), s in zip(held, sources):
        near = F.lit(True) if s.tolerance_seconds is None else F.col("_t") - F.col(f"{r}._rt") <= int(s.tolerance_seconds * 1_000_000)
        out += [F.when(near, F.col(f"{r}.{c}")).alias(c) for c in s.take]
    return line.select(*out)
