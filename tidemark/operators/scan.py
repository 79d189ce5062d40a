"""Relationship scan: rank correlations, false discovery, confirmation, information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import benjamini_hochberg
from tidemark.operators.ordered import average_rank, exact_quantiles, null_safe_join, value_ranks
from tidemark.operators.splits import calendar
from tidemark.schema import safe_inputs
from tidemark.session import cut

# Limits of the scan.
MIN_PAIRS, MIN_SUPPORT = 20, 80
DISCOVERY_SHARE, DISCOVERY_Q, CONFIRM_Q, CONFIRM_FLOOR = 0.70, 0.10, 0.05, 30
INTERVAL_Z, RHO_BOUND = 1.96, 0.999999
MI_BINS = 10
COVERAGE_FLOOR, COVERAGE_SHARE = 30, 0.2


def usable_features(rows: DataFrame, features: list[str], *, target: str) -> list[str]:
    """Features that are no leak by name, known in enough rows and not constant; one aggregate over all of them."""
    use = [f for f in safe_inputs(features) if f != target]
    if not use:
        return []
    of = lambda f: F.col(f).try_cast("double")
    row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(of(f)).alias("known"), (F.min(of(f)) < F.max(of(f))).alias("varies")).alias(f"_{i}") for i, f in enumerate(use)]).first()
    return [f for i, f in enumerate(use) if row[f"_{i}"]["known"] >= max(COVERAGE_FLOOR, int(row["n"] * COVERAGE_SHARE)) and row[f"_{i}"]["varies"]]


def split_rows(rows: DataFrame, *, day: str, purge: int = 1, out: str = "split") -> DataFrame:
    """discovery / confirmation on whole sessions, purged on both sides of the cut."""
    cal = calendar(rows, day)
    edge = F.greatest(F.lit(1), F.floor(F.col("n") * DISCOVERY_SHARE))
    part = F.when(F.col("i") < edge - purge, "discovery").when(F.col("i") >= edge + purge, "confirmation")
    return rows.join(cal.select(day, part.alias(out)), day).filter(F.col(out).isNotNull())


def long_pairs(rows: DataFrame, *, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """Feature/target pairs in long form, complete pairs only, for every feature that is no leak by name."""
    use = safe_inputs(features)
    if not use:
        return rows.limit(0).select(*keys, F.lit(0.0).alias("y"), F.lit("").alias("feature"), F.lit(0.0).alias("x"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in use])
    return rows.select(*keys, F.col(target).cast("double").alias("y"), F.inline(pairs)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def with_views(pairs: DataFrame, *, split: str, ticker: str) -> DataFrame:
    """Each pair twice: as it is, and with the ticker's own mean removed.  The means
    are a small grouped table, so a large ticker is not held in a window."""
    means = pairs.groupBy("feature", split, ticker).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    within = pairs.filter(F.col(ticker).isNotNull()).join(means, ["feature", split, ticker]).select(
        "feature", split, (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"), F.lit("within_ticker").alias("view"))
    return pairs.select("feature", split, "x", "y", F.lit("global").alias("view")).unionByName(within)


def rank_correlation(pairs: DataFrame, *, keys: list[str]) -> DataFrame:
    """Spearman correlation per key with average ranks, exact; too few pairs give 0.

    Both ranks come from counts of distinct values, so one feature is ranked by
    many tasks, and its rows meet their rank by equality.
    """
    d = pairs
    for side in ("x", "y"):
        ranks = value_ranks(pairs, keys=keys, value=side).select(*keys, side, average_rank().alias(f"r{side}"))
        d = null_safe_join(d, ranks, [*keys, side])
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("_rho"), F.min("x").alias("_lx"), F.max("x").alias("_hx"),
                             F.min("y").alias("_ly"), F.max("y").alias("_hy"))
    usable = (F.col("n") >= MIN_PAIRS) & (F.col("_lx") < F.col("_hx")) & (F.col("_ly") < F.col("_hy"))
    return g.select(*keys, "n", F.when(usable, F.coalesce("_rho", F.lit(0.0))).otherwise(0.0).alias("rho"), usable.alias("tested"))


def rho_interval(rho: Column, n: Column) -> tuple[Column, Column]:
    """Fisher interval; null for four pairs or fewer."""
    z = F.atanh(F.greatest(F.lit(-RHO_BOUND), F.least(F.lit(RHO_BOUND), rho)))
    radius = F.lit(INTERVAL_Z) / F.sqrt(F.when(n > 4, n - 3))
    return F.tanh(z - radius), F.tanh(z + radius)


def _beta_tail(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, vectorised."""
    from math import lgamma
    x = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(np.array([lgamma(i + b) - lgamma(i) - lgamma(b) for i in a]) + a * np.log(x) + b * np.log1p(-x))
    swap = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.maximum(1 - (p + q) * z / (p + 1), tiny)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + top * d) < tiny, tiny, 1 + top * d)
            c = np.where(np.abs(1 + top / c) < tiny, tiny, 1 + top / c)
            h = h * d * c
    part = front * h / p
    return np.where(swap, 1 - part, part)


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a t statistic."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isfinite(t), _beta_tail(df / (df + np.where(np.isfinite(t), t, 0.0) ** 2), df / 2, 0.5), 0.0)


def with_p_values(stats: DataFrame, *, rho: str = "rho", n: str = "n", tested: str = "tested", out: str = "p") -> DataFrame:
    """p per hypothesis.  The table has one row per hypothesis, so this is the one
    place the missing t-distribution is worth a trip through Arrow."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = np.clip(b[rho].to_numpy(float), -1, 1)
            df = np.maximum(b[n].to_numpy(float) - 2, 1)
            with np.errstate(divide="ignore"):
                p = student_tail(r * np.sqrt(df / np.maximum(1 - r * r, 0)), df)
            yield b.assign(**{out: np.where(b[tested].to_numpy(bool), p, 1.0)})
    from pyspark.sql.types import DoubleType, StructField, StructType
    return stats.mapInPandas(run, StructType([*stats.schema.fields, StructField(out, DoubleType())]))


def relationship_scan(rows: DataFrame, *, features: list[str], target: str, ticker: str, day: str, min_support: int = MIN_SUPPORT,
                      purge: int = 1, max_selected: int | None = None) -> DataFrame:
    """Hypotheses found in discovery and checked once in confirmation.

    A feature counts as confirmed when both the global and the within-ticker view
    keep their sign and pass the false-discovery limit in confirmation.  Features known in
    too few rows, or constant, are not tried.  All that discovery selects go on, or the ``max_selected`` strongest if the caller asks.
    """
    # Both tables feed several branches; the second has one row per hypothesis.
    features = usable_features(rows, features, target=target)
    pairs = cut(long_pairs(split_rows(rows, day=day, purge=purge), features=features, target=target, keys=["split", ticker]))
    stats = cut(with_p_values(rank_correlation(with_views(pairs, split="split", ticker=ticker), keys=["feature", "split", "view"])))
    found = benjamini_hochberg(stats.filter(F.col("split") == "discovery"), keys=["view"], p="p", null_policy="one")
    wide = _side_by_side(found, "discovery")
    best_q = F.least("discovery_q", "discovery_within_ticker_q")
    best_rho = F.greatest(F.abs("discovery_rho"), F.abs("discovery_within_ticker_rho"))
    chosen = wide.filter((F.col("discovery_n") >= min_support) & (best_q <= DISCOVERY_Q))
    if max_selected is not None:
        chosen = chosen.orderBy(best_q, best_rho.desc(), "feature").limit(max_selected)
    again = stats.filter(F.col("split") == "confirmation").join(chosen.select("feature"), "feature", "left_semi")
    late = _side_by_side(benjamini_hochberg(again, keys=["view"], p="p", null_policy="one"), "confirmation")
    d = chosen.join(late, "feature")
    for tag in ("", "_within_ticker"):
        rho, n = F.col(f"confirmation{tag}_rho"), F.col(f"confirmation{tag}_n")
        low, high = rho_interval(rho, n)
        stable = (F.signum(rho) == F.signum(f"discovery{tag}_rho")) & (rho != 0)
        d = d.withColumns({f"confirmation{tag}_low": low, f"confirmation{tag}_high": high, f"stable{tag or '_global'}": stable,
                           f"confirmed{tag or '_global'}": stable & (F.col(f"confirmation{tag}_q") <= CONFIRM_Q) & (n >= max(CONFIRM_FLOOR, min_support // 2))})
    d = d.withColumn("confirmed", F.col("confirmed_global") & F.col("confirmed_within_ticker"))
    effect = quartile_effect(pairs.filter(F.col("split") == "confirmation"))
    return d.join(effect, "feature", "left").withColumn("causal_claim", F.lit(False))


def _side_by_side(stats: DataFrame, prefix: str) -> DataFrame:
    pick = lambda view, c: F.max(F.when(F.col("view") == view, F.col(c)))
    return stats.groupBy("feature").agg(*[
        pick(view, c).alias(f"{prefix}{tag}_{c}") for view, tag in (("global", ""), ("within_ticker", "_within_ticker")) for c in ("rho", "p", "n", "q")])


def quartile_effect(pairs: DataFrame) -> DataFrame:
    """Mean target in the top and bottom quarter of each feature."""
    marks = exact_quantiles(pairs, keys=["feature"], value="x", probabilities={"q1": 0.25, "q3": 0.75}).drop("n")
    d = pairs.join(marks, "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("x") >= F.col("q3"), F.col("y"))).alias("high_mean"), F.avg(F.when(F.col("x") <= F.col("q1"), F.col("y"))).alias("low_mean"))
    keep = F.col("_n") >= 30
    return d.select("feature", F.when(keep, F.col("high_mean")).alias("high_mean"), F.when(keep, F.col("low_mean")).alias("low_mean"),
                    F.when(keep, F.col("high_mean") - F.col("low_mean")).alias("difference"))


def binned_information(pairs: DataFrame, *, keys: list[str], bins: int = MI_BINS) -> DataFrame:
    """Mutual information of equal-count bins, in nats; descriptive only."""
    d = pairs
    for side in ("x", "y"):
        place = value_ranks(pairs, keys=keys, value=side).select(*keys, side, F.floor(F.col("below") * bins / F.col("total")).alias(f"b{side}"))
        d = null_safe_join(d, place, [*keys, side])
    joint = d.groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    bx, by = joint.groupBy(*keys, "bx").agg(F.sum("n").alias("nx")), joint.groupBy(*keys, "by").agg(F.sum("n").alias("ny"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("nt"))
    j = joint.join(bx, [*keys, "bx"]).join(by, [*keys, "by"]).join(total, keys)
    return j.groupBy(*keys).agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mutual_information"),
                                F.max("nt").alias("n"))
