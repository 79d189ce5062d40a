"""Structured Streaming versions of the incremental jobs.

Each takes a streaming DataFrame and returns one (or starts a ``foreachBatch``
sink), so the source may be files, a message log or a rate stream.  Event time
must be TIMESTAMP, not TIMESTAMP_NTZ.  Availability clocks stay data columns: a
watermark only bounds state, it never decides what was known when.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import risk
from tidemark.session import checkpoint_folder


def file_stream(spark: SparkSession, folder: str, name: str, *, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of the table ``name`` of a folder, one file or a folder of part files, schema taken from those there now."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    from tidemark.schema import scan
    return scan(reader.parquet(f"{folder}/{{{name}}}"))  # a pattern: a plain path would have to be a folder


def run_to_table(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Process what is available, exactly once, into a table, and read it back."""
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/table") \
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int, str], None], *, mode: str = "append") -> str:
    """Process what is available through ``write(batch, id, folder)``; gives the folder.
    A batch is written under its own id, so a repeat after a failure replaces it."""
    base = f"{checkpoint_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress") \
        .foreachBatch(lambda batch, n: write(batch, n, f"{base}/table/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{base}/table"


def trade_minutes(trades: DataFrame, *, keys: list[str], ts: str, price: str, size: str, delay: str = "1 hour") -> DataFrame:
    """Minute aggregates, emitted once the watermark has passed the minute."""
    money = F.col(price) * F.col(size)
    g = trades.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 minute")).agg(
        F.count(size).alias("trade_count"), F.sum(size).alias("trade_volume"), F.sum(money).alias("trade_dollar_volume"),
        F.max(size).alias("max_trade_size"))
    return g.select(*keys, F.col("window.start").alias("minute"), "trade_count", "trade_volume", "trade_dollar_volume", "max_trade_size")


def news_activity(news: DataFrame, *, keys: list[str], ts: str, score: str, delay: str = "2 hours") -> DataFrame:
    """Articles and mean score of the last hour, every quarter of an hour."""
    g = news.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "60 minutes", "15 minutes")).agg(
        F.count(F.lit(1)).alias("news_count"), F.avg(score).alias("sentiment"))
    return g.select(*keys, F.col("window.end").alias("window_end"), "news_count", "sentiment")


def deduplicate(rows: DataFrame, *, ts: str, content: list[str], delay: str) -> DataFrame:
    """Each content once; repeats later than ``delay`` are the batch job's to find."""
    keyed = rows.withColumn("content_key", F.sha2(F.to_json(F.struct(*sorted(content))), 256))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_key"])


def latest_known(rows: DataFrame, *, key: str, value: str, available: str, order: str) -> DataFrame:
    """Running latest value per key by the time it became available (update mode).

    A streaming aggregate: batches combine before the shuffle and state is one small
    tuple per key, so a busy key is never held.
    """
    at = F.unix_micros(available)
    last = F.max(F.struct(at.alias("at"), F.col(order).alias("id"), F.col(value).alias("value"))).alias("s")
    return rows.groupBy(key).agg(last, F.count(F.lit(1)).alias("seen")).select(
        key, F.col("s.at").alias("last_at"), F.col("s.id").alias("last_id"), F.col("s.value").cast("double").alias("last_value"), "seen")


def monitor_batches(records: DataFrame, *, keys: list[str], order: list[str], bucket: str) -> str:
    """A monitoring snapshot after every micro-batch over all records so far, kept by batch.

    State is what adds up, sums by key and counts by value; batch n writes the state of
    batch n - 1 and its own records under its id, so a repeat after a failure gives the
    same state and triggers do not depend on how records are cut into batches.  Batches
    must follow each other in time, as drawdowns do.
    """
    def write(batch: DataFrame, n: int, folder: str) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        state = lambda kind, k: f"{folder.rsplit('/table/', 1)[0]}/state-{kind}/batch={k}"
        sums, values = risk.monitor_sums(batch, keys=keys, order=order, bucket=bucket), risk.monitor_values(batch, keys=keys)
        if n:
            sums = risk.add_monitor_sums(spark.read.parquet(state("sums", n - 1)), sums, keys=keys)
            values = spark.read.parquet(state("values", n - 1)).unionByName(values).groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
        for kind, frame in (("sums", sums), ("values", values)):
            frame.write.mode("overwrite").parquet(state(kind, n))
        known = [spark.read.parquet(state(kind, n)) for kind in ("sums", "values")]
        risk.monitor_from_sums(*known, keys=keys).write.mode("overwrite").parquet(folder)
        batch.unpersist()
    return run_batches(records, write)


def settle_stream(signals: DataFrame, exits: DataFrame, *, signal_time: str, exit_time: str, signal_key: str, exit_key: str,
                  within: str, delay: str) -> DataFrame:
    """Signals meet their exits within a bounded time, so both sides' state expires."""
    s, x = signals.withWatermark(signal_time, delay), exits.withWatermark(exit_time, delay)
    return s.join(x, (F.col(signal_key) == F.col(exit_key)) & (F.col(exit_time) >= F.col(signal_time))
                  & (F.col(exit_time) <= F.col(signal_time) + F.expr(f"interval {within}")), "inner")
