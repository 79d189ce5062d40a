"""Pair work in bounded tasks: tiles of a bucket, small groups at once, local forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounds, folded

#: Rows of one side of a tile pair, and of a group that is compared together with its neighbours in the table.
TILE, SMALL = 1024, 8
UNIT = ["key", "low", "high"]


def by_unit(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Bring the rows of each unit (key, low, high) together and hand many units at a time to ``work`` with their starts.

    Rows come sorted by unit and ``tile``; a unit has at most two tiles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in folded(batches, UNIT):
            out = work(part, bounds(part, UNIT))
            if out is not None and out.num_rows:
                yield out
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "tile").mapInArrow(run, schema)


def halves(rows: DataFrame) -> DataFrame:
    """Units for rows with ``key`` and ``node``: a key of more than ``TILE`` rows is dealt into
    tiles by hash, and every pair of tiles is a unit of its own.  Keys with one row go.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > 1)
    parts = F.ceil(F.col("total") / TILE).cast("int")
    placed = rows.join(sizes, "key").withColumn("parts", parts).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (placed.withColumn("other", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
            .drop("total", "parts", "other"))


def small_pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside groups of at most ``SMALL`` rows."""
    size = np.diff(starts)
    few = size <= SMALL
    rows = np.arange(starts[-1])
    last = np.repeat(np.where(few, starts[1:], 0), size)
    left, right = [], []
    for d in range(1, SMALL):
        i = rows[rows + d < last]
        left.append(i)
        right.append(i + d)
    return np.concatenate(left), np.concatenate(right)


class Forest:
    """Components of rows 0..n-1 under pairs that arrive in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        while len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            low, high = low[apart], high[apart]
            if not len(low):
                break
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
            a, b = self.root[low], self.root[high]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]
