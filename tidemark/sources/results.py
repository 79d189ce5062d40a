"""Sinks and readers of derived results: partitioned stores, labels, experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_store(frame: DataFrame, path: str, *, partitions: list[str]) -> None:
    """Replace exactly the partitions this run produced.  Rows are first gathered by
    partition, so each is written by few tasks; AQE splits one that is too large."""
    frame.hint("rebalance", *partitions).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_labels(frame: DataFrame, path: str) -> None:
    """Targets live apart from inputs, by horizon, ticker and day."""
    write_store(frame, path, partitions=["horizon", "ticker", "day"])


def append_run(frame: DataFrame, path: str, *, run_id: str) -> None:
    """Experiments and predictions are only ever added, under the id of their run."""
    frame.withColumns({"run_id": F.lit(run_id), "created_at": F.current_timestamp()}) \
        .write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    newest = runs.select(F.max_by("run_id", F.struct("created_at", "run_id")).alias("r")).scalar()
    return runs.filter(F.col("run_id") == newest)


def scorecard(runs: DataFrame, *, run: str, created: str, last: int | None = None) -> DataFrame:
    """Experiments with a holdout of all runs, or of the ``last`` ones, best expected value first."""
    recent = runs if last is None else runs.orderBy(F.col(created).desc(), run).limit(last)
    flat = recent.select(run, F.inline("experiments")).filter(F.col("holdout").isNotNull())
    fields = [c for c in flat.columns if c != "holdout"]
    return flat.select(*fields, "holdout.*").orderBy(F.col("ev").desc_nulls_last())
