"""Running totals, ranks and quantiles over an order that no single task holds.

The ordered domain is cut into buckets that increase with the order.  A small
table of per-bucket totals gives every bucket its starting value, and the rows
are then finished inside ``(keys, bucket)`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(frame: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Left join on keys where null keys match each other."""
    renamed = other.select(*[F.col(c).alias(f"_k_{c}") for c in on],
                           *[c for c in other.columns if c not in on])
    condition = None
    for c in on:
        test = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        condition = test if condition is None else condition & test
    return frame.join(renamed, condition, "left").drop(*[f"_k_{c}" for c in on])


def running_sum(frame: DataFrame, *, keys: list[str], bucket: str, order: list[str],
                value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value``; ``bucket`` must not decrease in ``order``."""
    totals = frame.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (null_safe_join(frame, starts, [*keys, bucket])
            .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
            .drop("_start"))


def value_ranks(frame: DataFrame, *, keys: list[str], value: str, splits: int = 64,
                sums: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """One row per distinct ``(keys, value)``: ``peers`` rows hold it, ``below`` rows
    are smaller, ``total`` rows are in the group.  Exact.

    Rows are first combined per distinct value (map-side).  The value range is cut
    at sampled quantiles; the cut points only balance the work, any cut is right.
    ``sums`` adds further aggregates per distinct value; ``weight`` names a column that
    says how many rows a row stands for.
    """
    keyed = [F.col(k) for k in keys]
    extra = [expression.alias(name) for name, expression in (sums or {}).items()]
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*keyed, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("peers"), *extra)
    marks = [i / splits for i in range(1, splits)]
    cut_points = F.percentile_approx(value, F.array(*[F.lit(m) for m in marks]), F.lit(1000))
    # Both readers of ``counts`` ask for all its measures, so they share one shuffle.
    whole = [F.sum("peers").alias("total"), *[F.max(n).alias(f"_max_{n}") for n in (sums or {})]]
    if keys:
        edges = counts.groupBy(*keyed).agg(cut_points.alias("_edges"), *whole)
        located = null_safe_join(counts, edges, keys)
    else:
        edges = counts.agg(cut_points.alias("_edges"), *whole)
        located = counts.withColumn("_e", edges.select(F.struct("_edges", "total").alias("e")).scalar()).select(
            *counts.columns, "_e._edges", "_e.total")
    located = located.withColumn(
        "_bucket", F.size(F.filter("_edges", lambda e: e < F.col(value)))).select(
        *counts.columns, "total", "_bucket")
    totals = located.groupBy(*keyed, "_bucket").agg(F.sum("peers").alias("_n"))
    w = Window.partitionBy(*keyed).orderBy("_bucket")
    starts = totals.select(
        *keyed, "_bucket",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keyed, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (null_safe_join(located, starts, [*keys, "_bucket"])
            .withColumn("below", F.col("_start") + F.coalesce(F.sum("peers").over(within), F.lit(0)))
            .drop("_start", "_bucket"))


def average_rank() -> Column:
    """Rank with ties sharing their mean, from the columns of ``value_ranks``."""
    return F.col("below") + (F.col("peers") + F.lit(1)) / F.lit(2.0)


def exact_quantiles(frame: DataFrame, *, keys: list[str], value: str,
                    probabilities: dict[str, float], weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles of whole groups, without holding a group.

    The order statistics on either side of each position are picked out of the
    ranked distinct values; everything is a sum or a minimum.
    """
    ranked = value_ranks(frame, keys=keys, value=value, weight=weight)
    picks = []
    for name, q in probabilities.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("peers"))
        picks += [
            F.max(F.when(holds(low), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_w_{name}"),
        ]
    found = ranked.groupBy(*[F.col(k) for k in keys]).agg(*picks, F.max("total").alias("n"))
    return found.select(
        *keys, "n",
        *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name)
          for name in probabilities])
