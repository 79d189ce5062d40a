"""Leakage audits: counts over whole tables, and a gate that refuses to go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import FORBIDDEN_INPUT_TOKENS

# Coverage a feature needs, and availability bases too weak to trust.
MIN_FEATURE_ROWS, MIN_FEATURE_SHARE = 30, 0.20
WEAK_BASES = ("missing", "legacy_publication_only")


def audit_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: name allowed, coverage, varies, usable.  One pass."""
    stats = frame.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
        for c in columns])
    rows = stats.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.lit(any(t in c.lower() for t in FORBIDDEN_INPUT_TOKENS)).alias("forbidden"),
                 F.col(f"{c}.n").alias("non_null"), F.coalesce(F.col(f"{c}.lo") < F.col(f"{c}.hi"), F.lit(False)).alias("varies"))
        for c in columns])))
    enough = F.col("non_null") >= F.greatest(F.lit(MIN_FEATURE_ROWS), F.floor(F.col("_rows") * MIN_FEATURE_SHARE))
    return rows.withColumn("usable", ~F.col("forbidden") & enough & F.col("varies")).drop("_rows")


def audit_point_in_time(frame: DataFrame, *, as_of: str, available: list[str], target: str, keys: list[str] | None = None) -> DataFrame:
    """Rows, missing as-of, values available only later, targets not strictly later."""
    a = F.col(as_of)
    return frame.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(a.isNull()).alias("missing_as_of"),
        *[F.count_if(F.col(c) > a).alias(f"future_{c}") for c in available],
        F.count_if(F.col(target).isNotNull() & a.isNotNull()).alias("targets_checked"),
        F.count_if(F.col(target) <= a).alias("non_future_targets"))


def audit_purge(folds: DataFrame, *, as_of: str, label_end: str, fold: str = "fold", role: str = "role") -> DataFrame:
    """Per fold: the last training label must end before the first test row."""
    train = F.col(role) == "train"
    g = folds.groupBy(fold).agg(
        F.max(F.when(train, F.col(as_of))).alias("last_train_as_of"),
        F.max(F.when(train, F.col(label_end))).alias("last_train_label"),
        F.min(F.when(~train, F.col(as_of))).alias("first_test_as_of"))
    return g.withColumn("valid", F.coalesce(F.col("last_train_label") < F.col("first_test_as_of"), F.lit(False)))


def audit_provenance(vectors: DataFrame, *, strict: bool = True) -> DataFrame:
    """Counts of vectors with a weak availability basis, a missing as-of or future inputs."""
    weak = F.col("availability_basis").isNull() | F.col("availability_basis").isin(*WEAK_BASES)
    out = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("as_of").isNull()).alias("missing_as_of"),
                      F.count_if(weak).alias("weak_basis"), F.count_if(F.coalesce("future_inputs", F.lit(True))).alias("future_inputs"))
    bad = F.col("missing_as_of") + F.col("future_inputs") + (F.col("weak_basis") if strict else F.lit(0))
    return out.withColumn("valid", bad == 0)


class LeakageError(ValueError):
    """Raised before anything is written from data that failed an audit."""


def require(audit: DataFrame, violation, context: str) -> None:
    """Stop when any audit row (a handful) violates."""
    bad = audit.filter(violation).limit(20).collect()
    if bad:
        raise LeakageError(f"{context}: " + "; ".join(str(row.asDict()) for row in bad))
