"""What the corpus operators share: session settings, Arrow batches, labelled samples, grouped tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, prepare

__all__ = ["arrow_rows", "cut", "folded", "labelled_sample", "ranked_share", "remainder", "slices", "started", "table"]

#: Rows of one Arrow batch.  Texts are long, so a batch stays at a few MB; Spark bounds its bytes as well.
BATCH_ROWS = 512


def started(spark: SparkSession) -> SparkSession:
    """Settings that every operator here relies on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return started(spark).read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text modulo a divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % divisor


def slices(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows whose summed length stays within ``most``; a longer row is alone."""
    first, held, at = 0, 0, 0
    for at, n in enumerate(lengths):
        if at > first and held + n > most:
            yield first, at
            first, held = at, 0
        held += n
    if first <= at and held + at - first >= 0:
        yield first, at + 1


def arrow_rows(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch; None gives no rows.  Empty batches never reach it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out
    return frame.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def ranked_share(key: Column, share: float) -> Column:
    """True for a share of the keys, chosen by hash: the same keys in every run and at every size."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(share * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, y) for fitting a classifier.

    ``learn`` says which doc_ids may be learnt from.  A key labelled twice takes the
    larger label, a repeated document its smallest text.  Rows are chosen by a hash of
    the key; the broadcast side holds ``rows`` keys at most.
    """
    known = (labels.select(F.col("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    picked = known.where(ranked_share(F.col("doc_id"), share)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(ranked_share(F.col("doc_id"), share))
    return (texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("row"))
            .select("doc_id", "row.text", "row.y"))


def folded(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of consecutive equal keys from batches sorted by them, many groups a table.

    A group must fit into memory; callers bound it when they form the keys.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = _changes(batch, keys)
        if held and _differs(held[-1], batch, keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut_at = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = [batch.slice(cut_at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Positions at which a new group begins, without the first row."""
    new = np.zeros(batch.num_rows - 1, bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def _differs(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return any(a.column(k)[a.num_rows - 1] != b.column(k)[0] for k in keys)


def bounds(found: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups of a table from ``folded`` and, last, its row count."""
    one = found.combine_chunks().to_batches()[0]
    return np.concatenate([[0], _changes(one, keys), [one.num_rows]]).astype(np.int64)
