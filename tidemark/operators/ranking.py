"""Top rows per group and even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(frame: DataFrame, *, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group.  A rank filter lets Spark keep only the first ``n``
    per group in every map task (WindowGroupLimit), so a hot group shuffles little."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def even_sample(frame: DataFrame, *, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``size`` rows per group at evenly spaced positions; smaller groups stay whole.

    Position k of a group of c rows is ``trunc(k*(c-1)/(size-1))``: a row is kept
    if some k maps to its position, which a row can tell on its own.
    """
    w = Window.partitionBy(*keys)
    d = frame.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn(
        "_c", F.count(F.lit(1)).over(w))
    at = lambda k: F.floor(k * (F.col("_c") - 1) / F.lit(float(size - 1)))
    guess = F.ceil(F.col("_i") * F.lit(float(size - 1)) / (F.col("_c") - 1))
    near = F.array(*[guess + F.lit(s) for s in (-1, 0, 1)])
    kept = F.exists(near, lambda k: (k >= 0) & (k < size) & (at(k) == F.col("_i")))
    return d.filter((F.col("_c") <= size) | kept).drop("_i", "_c")
