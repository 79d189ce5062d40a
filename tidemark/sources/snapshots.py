"""Immutable snapshots, append-only writes, manifests and layout preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.schema import conform
from tidemark.session import cut
from tidemark.sources.results import write_store

# The stamp in a file name, and the order in which stored horizons are preferred.
STAMP = r"(\d{8}T\d{6,12}Z)"
HORIZON_ORDER = (30, 15, 60, 120, 240)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stamp_of(path: Column) -> Column:
    """The stamp is looked for in the file name only, never in the folders."""
    return F.nullif(F.regexp_extract(basename(path), STAMP, 1), F.lit(""))


def newest_versions(keys: DataFrame, *, group: list[str], path: str) -> DataFrame:
    """Newest snapshot per group by its file-name stamp."""
    d = keys.withColumn("stamp", stamp_of(F.col(path))).filter(F.col("stamp").isNotNull())
    return d.groupBy(*group).agg(F.max("stamp").alias("stamp"), F.max_by(path, F.struct("stamp", path)).alias(path))


def read_newest(spark: SparkSession, folder: str, schema: StructType, *, group: list[str]) -> DataFrame:
    """Rows of the newest snapshot file per group; the choice is made from file names
    and joined back, so older files are read only for their group columns."""
    d = spark.read.schema(schema).json(folder, recursiveFileLookup=True).withColumn("_file", F.col("_metadata.file_name"))
    newest = newest_versions(d.select(*group, "_file").distinct(), group=group, path="_file").drop("stamp")
    return d.join(newest, [*group, "_file"]).drop("_file")


def read_history(spark: SparkSession, folder: str, schema: StructType, *, max_bad_share: float = 0.01) -> DataFrame:
    """All snapshots; unreadable ones are skipped but counted, and too many stop the job."""
    shaped = StructType([*schema.fields]).add("_corrupt_record", "string")
    d = spark.read.schema(shaped).option("columnNameOfCorruptRecord", "_corrupt_record").option("mode", "PERMISSIVE") \
        .json(folder, recursiveFileLookup=True)
    # Parsed once and kept: the count and every later reader use the same parse.
    d = cut(d)
    seen = d.agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt_record").alias("bad"))
    row = seen.first()
    if row["n"] and row["bad"] / row["n"] > max_bad_share:
        raise ValueError(f"{row['bad']} of {row['n']} snapshots under {folder} are unreadable")
    return d.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def content_key(columns: list[str]) -> Column:
    """sha256 of the row as JSON with sorted column names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def new_content(rows: DataFrame, existing: DataFrame, *, columns: list[str], key: str = "content_key") -> DataFrame:
    """Rows whose content is not stored yet, each once."""
    d = rows.withColumn(key, content_key(columns))
    one = d.groupBy(key).agg(F.any_value(F.struct(*[c for c in rows.columns])).alias("_r")).select(key, "_r.*")
    return one.join(existing.select(key).distinct(), key, "left_anti")


def append_content(rows: DataFrame, path: str, *, columns: list[str]) -> None:
    """Append what is new under its content key; running it twice adds nothing.

    Only a missing path counts as an empty store: a store that cannot be read stops the
    job instead of being written again.
    """
    spark = rows.sparkSession
    d = rows.withColumn("content_key", content_key(columns))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    have = spark.read.parquet(path).select("content_key") if stored else d.select("content_key").limit(0)
    new_content(rows, have, columns=columns).write.mode("append").parquet(path)


def merge_manifest(entries: DataFrame, *, keys: list[str], rows: str, updated: str) -> DataFrame:
    """Last written row count per (day, ticker), and how many writes it replaces."""
    return entries.groupBy(*keys).agg(F.max_by(rows, updated).alias(rows), F.max(updated).alias(updated),
                                      (F.count(F.lit(1)) - 1).alias("replaced"))


def prefer_layout(rows: DataFrame, *, keys: list[str], layout: str, first: str) -> DataFrame:
    """Per key only the authoritative layout if it exists; repeated rows removed.

    Only the other layouts' rows meet the distinct keys of the authoritative one; its
    own rows pass through.
    """
    is_first = F.col(layout).eqNullSafe(F.lit(first))
    held = rows.filter(is_first)
    others = rows.filter(~is_first).join(held.select(*keys).distinct(), keys, "left_anti")
    return held.unionByName(others).distinct()


def load_layouts(by_ticker: DataFrame, shared: DataFrame, schema: StructType, *, keys: list[str]) -> DataFrame:
    """Union of both layouts with differing columns, then the preferred one per key."""
    both = conform(by_ticker, schema).withColumn("layout", F.lit("by_ticker")).unionByName(
        conform(shared, schema).withColumn("layout", F.lit("shared")), allowMissingColumns=True)
    return prefer_layout(both, keys=keys, layout="layout", first="by_ticker")


def preferred_copy(copies: DataFrame, *, keys: list[str], horizon: str, order: tuple[int, ...] = HORIZON_ORDER) -> DataFrame:
    """The stored horizon to read per (ticker, day): the first in ``order``; horizons not in
    it come last, by their text, so a unit with only such a copy is kept."""
    place = F.array_position(F.array(*[F.lit(h) for h in order]), F.col(horizon).cast("int"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1), F.col(horizon).cast("string"))
    return copies.groupBy(*keys).agg(F.min_by(horizon, rank).alias(horizon))


def newest_common_day(left: DataFrame, right: DataFrame, *, ticker: str, day: str) -> DataFrame:
    """Newest day a ticker has in both stores."""
    return left.select(ticker, day).distinct().join(right.select(ticker, day).distinct(), [ticker, day]).groupBy(ticker).agg(
        F.max(day).alias(day))


def split_universe(rows: DataFrame, universe: DataFrame, calendar: DataFrame, *, ticker: str, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the ticker universe, and a receipt per (ticker, day): stored or verified empty."""
    from tidemark.sources.inventory import expected_units
    kept = rows.join(universe.select(ticker).distinct(), ticker, "left_semi")
    counts = kept.groupBy(ticker, day).agg(F.count(F.lit(1)).alias("rows"))
    receipts = expected_units(universe, calendar, ticker=ticker, day=day).join(counts, [ticker, day], "left").select(
        ticker, day, F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("rows").isNotNull(), "stored").otherwise("verified_empty").alias("status"))
    return kept, receipts


class TooManyRejects(RuntimeError):
    """More unreadable rows than a landing job may leave aside."""


def read_csv(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """Compressed CSV with a declared schema; unreadable rows keep their text in ``_corrupt_record``."""
    return spark.read.schema(StructType([*schema.fields]).add("_corrupt_record", "string")).option("header", "true") \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(pattern)


def land_csv(spark: SparkSession, pattern: str, schema: StructType, path: str, *, day: Column, stop_share: float = 0.05) -> DataFrame:
    """Read CSV once and land it: good rows by day under ``path/rows``, others as text under ``path/rejects``.

    Returns the counts (landed, rejected).  A share of rejects above ``stop_share`` stops the
    job before anything is landed; nothing is dropped without a trace.
    """
    parsed = cut(read_csv(spark, pattern, schema).withColumn("file", F.input_file_name()))
    bad = F.col("_corrupt_record").isNotNull()
    counts = parsed.agg(F.count_if(~bad).alias("landed"), F.count_if(bad).alias("rejected"))
    row = counts.first()
    if row["rejected"] > stop_share * (row["landed"] + row["rejected"]):
        raise TooManyRejects(f"{row['rejected']} of {row['landed'] + row['rejected']} rows are unreadable")
    write_store(parsed.filter(~bad).drop("_corrupt_record", "file").withColumn("day", day), f"{path}/rows", partitions=["day"])
    parsed.filter(bad).select("file", F.col("_corrupt_record").alias("text")).write.mode("append").parquet(f"{path}/rejects")
    return counts


def split_by_day(articles: DataFrame, plan: DataFrame, path: str, *, ticker: str, published: str, day: str = "day") -> DataFrame:
    """Articles of any span into one partition a publication day, and a receipt for every planned (ticker, day).

    A planned day without articles is ``verified_empty``; articles without a clock or on
    days that were not planned for their ticker are not stored.
    """
    dated = articles.withColumn(day, F.to_date(published)).filter(F.col(day).isNotNull())
    stored = dated.join(plan.select(ticker, day).distinct(), [ticker, day], "left_semi")
    write_store(stored, path, partitions=[day])
    counts = articles.sparkSession.read.schema(stored.schema).parquet(path).groupBy(ticker, day).agg(F.count(F.lit(1)).alias("rows"))
    return plan.select(ticker, day).distinct().join(counts, [ticker, day], "left").select(
        ticker, day, F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNotNull(), "stored").otherwise("verified_empty").alias("status"))
