"""Fixed-size daily vectors: summaries, projection, blocks, ablations."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.schema import safe_inputs

VECTOR_VERSION = "tide-384-v1"
# Block shares of the vector, candidate sizes, summary statistics.
BLOCK_SHARES = {"news": 0.5, "options": 0.25, "stock": 0.125, "expectation": 1 / 12}
MIN_QUALITY = 8
DIMENSIONS = (128, 256, 384, 512, 768)
STATISTICS = ("mean", "std", "min", "max", "median", "p10", "p90", "last", "slope")
ABLATIONS = {
    "all_layers": (), "without_news": ("news",), "without_embeddings": ("embeddings",), "without_options": ("options",),
    "without_earnings": ("earnings",), "without_technical": ("technical",), "without_theoretical_option_value": ("theoretical",),
}


def layout(dimensions: int) -> dict[str, int]:
    """Size of each block; quality takes the rest, at least eight, from news."""
    if dimensions < 32:
        raise ValueError("a vector needs at least 32 dimensions")
    sizes = {name: round(dimensions * share) for name, share in BLOCK_SHARES.items()}
    rest = dimensions - sum(sizes.values())
    short = max(0, MIN_QUALITY - rest)
    sizes["news"] -= short
    return {**sizes, "quality": rest + short}


def summarise(frame: DataFrame, *, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nine statistics per key and numeric column, long form, missing values skipped.

    A key is a ticker-day: its minutes bound the exact quantiles and the ordering.  Rows
    stay wide: one sort per key numbers every column's values, one aggregate takes all
    statistics, and only the result is stacked.
    """
    use = safe_inputs(columns)
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = frame.select(*keys, *order, *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(use)])
    d = d.withColumns({f"_i{k}": F.count(f"_v{k}").over(so_far) for k in range(len(use))} | {f"_n{k}": F.count(f"_v{k}").over(whole) for k in range(len(use))})
    made = []
    for k in range(len(use)):
        v, i, n = F.col(f"_v{k}"), F.col(f"_i{k}"), F.col(f"_n{k}")
        t = F.when(v.isNotNull() & (n > 1), 2.0 * (i - 1) / (n - 1) - 1)
        made += [F.count(v).alias(f"_n{k}"), F.avg(v).alias(f"_mean{k}"), F.stddev_pop(v).alias(f"_std{k}"), F.min(v).alias(f"_min{k}"), F.max(v).alias(f"_max{k}"),
                 F.percentile(v, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias(f"_q{k}"), F.max_by(v, F.when(v.isNotNull(), i)).alias(f"_last{k}"),
                 F.coalesce(F.regr_slope(v, t), F.lit(0.0)).alias(f"_slope{k}")]
    g = d.groupBy(*keys).agg(*made)
    row = lambda k, c: F.struct(
        F.lit(c).alias("column"), F.col(f"_n{k}").alias("n"), F.col(f"_mean{k}").alias("mean"), F.col(f"_std{k}").alias("std"), F.col(f"_min{k}").alias("min"),
        F.col(f"_max{k}").alias("max"), F.col(f"_q{k}")[0].alias("median"), F.col(f"_q{k}")[1].alias("p10"), F.col(f"_q{k}")[2].alias("p90"),
        F.col(f"_last{k}").alias("last"), F.col(f"_slope{k}").alias("slope"))
    return g.select(*keys, F.inline(F.array(*[row(k, c) for k, c in enumerate(use)]))).filter(F.col("n") > 0)


def summary_block(summary: DataFrame, *, keys: list[str], columns: list[str], out: str) -> DataFrame:
    """The statistics of a fixed column list as one array per key (absent = skipped)."""
    rows = summary.filter(F.col("column").isin(*columns))
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    one = F.struct(place.alias("at"), F.array(*[F.col(s) for s in STATISTICS]).alias("v"))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"])).alias(out))


def sign_of(name: str, source: int, target: int, i: int, j: int) -> int:
    """-1, 0 or +1 with odds 1:4:1, from a digest anyone can recompute."""
    pick = int(hashlib.md5(f"{name}:{source}:{target}:{i}:{j}".encode()).hexdigest()[:4], 16) % 6
    return 1 if pick == 0 else -1 if pick == 5 else 0


@lru_cache(maxsize=64)
def projection_matrix(name: str, source: int, target: int) -> np.ndarray:
    """Sparse sign matrix scaled by sqrt(3/target); a pure function of its arguments."""
    scale = np.sqrt(3.0 / max(1, target))
    return np.array([[sign_of(name, source, target, i, j) * scale for j in range(target)] for i in range(source)])


def compress(values: Column, dimensions: int, name: str) -> Column:
    """Project an array to ``dimensions`` and squash it; empty gives zeros, an array
    of that size is only squashed.  One matrix product per Arrow batch and length."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        out = [np.zeros(dimensions)] * len(batch)
        arrays = [np.nan_to_num(np.asarray(x, dtype=float), nan=0.0, posinf=0.0, neginf=0.0) if x is not None else np.empty(0) for x in batch]
        sizes = np.array([a.size for a in arrays])
        for size in set(sizes.tolist()) - {0}:
            at = np.flatnonzero(sizes == size)
            block = np.stack([arrays[i] for i in at])
            if size != dimensions:
                block = block @ projection_matrix(name, int(size), dimensions)
            scale = np.sqrt((block ** 2).mean(axis=1, keepdims=True)) + 1e-6
            for i, row in zip(at, np.tanh(block / (3.0 * scale))):
                out[i] = row
        return pd.Series(out)
    return run(values)


def quality_block(*, news_present: Column, feature_rows: Column, pair_rows: Column, has_expectation: Column, chunks: Column,
                  means: dict[str, Column], feature_missing: Column, pair_missing: Column, max_attention: Column,
                  quotes: Column | None = None) -> Column:
    """Sixteen fixed coordinates; coverage is one minus the missing share."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    logs = lambda c, top: F.least(F.lit(1.0), F.log1p(zero(c.cast("double"))) / F.ln(F.lit(top)))
    return F.array(
        flag(news_present), flag(feature_rows > 0), flag(pair_rows > 0), flag(has_expectation),
        logs(chunks, 101.0), logs(feature_rows, 10001.0), logs(pair_rows, 10001.0),
        *[zero(means[n]) for n in ("quality", "relevance", "importance", "novelty")],
        1 - F.coalesce(feature_missing, F.lit(1.0)), 1 - F.coalesce(pair_missing, F.lit(1.0)),
        zero(max_attention), flag(quotes if quotes is not None else F.lit(False)), F.lit(1.0))


def _joined(*arrays: Column) -> Column:
    empty = F.array().cast("array<double>")
    return F.concat(*[F.coalesce(a.cast("array<double>"), empty) for a in arrays])


BLOCKS = ("news_raw", "events_raw", "options_raw", "stock_raw", "expectation_raw", "earnings_raw", "quality_raw")


def _parts(frame: DataFrame, dimensions: int) -> tuple[DataFrame, dict[tuple[str, frozenset], str]]:
    """Every compressed block any ablation needs, each computed once per row."""
    size = layout(dimensions)
    c = F.col
    nothing = F.array().cast("array<double>")
    plan = {
        ("news", frozenset()): _joined(c("news_raw"), c("events_raw")),
        ("news", frozenset({"embeddings"})): _joined(c("events_raw")),
        ("news", frozenset({"news"})): nothing,
        ("options", frozenset()): _joined(c("options_raw")), ("options", frozenset({"options"})): nothing,
        ("stock", frozenset()): _joined(c("stock_raw")), ("stock", frozenset({"technical"})): nothing,
        ("expectation", frozenset()): _joined(c("expectation_raw"), c("earnings_raw")),
        ("expectation", frozenset({"theoretical"})): _joined(c("earnings_raw")),
        ("expectation", frozenset({"earnings"})): _joined(c("expectation_raw")),
        ("quality", frozenset()): _joined(c("quality_raw")),
    }
    names, columns = {}, {}
    for (block, off), values in plan.items():
        name = f"_{block}_{'_'.join(sorted(off)) or 'all'}"
        names[(block, off)] = name
        columns[name] = (F.array_repeat(F.lit(0.0), size[block]) if values is nothing
                         else compress(values, size[block], f"{block}-d{dimensions}"))
    return frame.withColumns(columns), names


def _vector(names: dict, disabled: tuple[str, ...]) -> Column:
    parts = []
    for block in (*BLOCK_SHARES, "quality"):
        off = next((key for key in names if key[0] == block and key[1] and key[1] <= set(disabled)), (block, frozenset()))
        parts.append(F.col(names[off]))
    return F.transform(F.concat(*parts), lambda x: x.cast("float"))


def assemble(frame: DataFrame, dimensions: int = 384) -> DataFrame:
    """The daily vector from the raw blocks; a row with no source is refused."""
    has = [F.size(F.coalesce(F.col(b), F.array().cast("array<double>"))) > 0 for b in ("news_raw", "options_raw", "stock_raw")]
    kept = frame.filter(has[0] | has[1] | has[2])
    d, names = _parts(kept, dimensions)
    d = d.withColumn("vector", _vector(names, ())).drop(*names.values())
    described = F.to_json(F.struct(F.lit(VECTOR_VERSION).alias("version"), F.lit(dimensions).alias("dimensions"),
                                   *[F.size(b).alias(b) for b in BLOCKS]))
    return d.withColumns({"vector_version": F.lit(VECTOR_VERSION), "dimensions": F.lit(dimensions),
                          "schema_hash": F.sha2(described, 256), "future_inputs": F.lit(False)})


def ablate(frame: DataFrame, dimensions: int = 384, variants: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per input row and variant, the vector length unchanged."""
    variants = variants or ABLATIONS
    d, names = _parts(frame, dimensions)
    made = F.array(*[F.struct(F.lit(v).alias("variant"), _vector(names, off).alias("vector")) for v, off in variants.items()])
    keep = [c for c in frame.columns if c not in BLOCKS]
    return d.select(*keep, F.inline(made))


def attach_vectors(rows: DataFrame, vectors: DataFrame, *, keys: list[str], provenance: list[str] | None = None) -> DataFrame:
    """Inner join on (ticker, day); the vector side has one row per key."""
    return rows.join(vectors.select(*keys, "vector", *(provenance or [])), keys)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double"))
