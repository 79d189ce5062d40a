"""Layer schemas and the tolerant-read helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DoubleType, FloatType, LongType, StringType,
    StructField, StructType, TimestampNTZType, TimestampType,
)


def _fields(kind, names: str) -> list[StructField]:
    return [StructField(name, kind, True) for name in names.split()]


STOCK_BARS = StructType(
    _fields(StringType(), "ticker") + _fields(TimestampType(), "ts") + _fields(DateType(), "day")
    + _fields(DoubleType(), "open high low close volume transactions")
)

OPTION_BARS = StructType(
    _fields(StringType(), "ticker underlying layout") + _fields(TimestampType(), "ts")
    + _fields(DateType(), "day") + _fields(DoubleType(), "open high low close volume transactions")
)

OPTION_TRADES = StructType(
    _fields(StringType(), "ticker") + _fields(TimestampType(), "ts")
    + _fields(DoubleType(), "price size")
)

QUOTE_COLUMNS = StructType(
    _fields(DoubleType(), "bid ask midprice spread relative_spread bid_size ask_size")
)

NEWS_COLUMNS = StructType(
    _fields(TimestampType(), "published_utc")
    + _fields(StringType(), "headline title description article_title article_description article_text sentiment")
    + _fields(DoubleType(), "sentiment_score emotion_intensity surprise_score relevance_score")
    + _fields(StringType(), "event_category")
)

EMBEDDING_CHUNKS = StructType(
    _fields(StringType(), "ticker") + _fields(DateType(), "day")
    + [StructField("embedding", ArrayType(FloatType()), True)]
    + _fields(DoubleType(), "quality relevance importance novelty recency")
    + _fields(TimestampType(), "available_at published_at first_seen_at")
)

MONITOR_RECORDS = StructType(
    _fields(DoubleType(), "expected_net_return actual_net_return probability_positive positive_outcome "
                          "expected_cost_return actual_cost_return relative_spread open_interest")
)

RISK_CANDIDATES = StructType(
    _fields(StringType(), "ticker side")
    + _fields(DoubleType(), "expected_return expected_cost_return uncertainty option_price")
    + _fields(LongType(), "contract_multiplier")
    + _fields(DoubleType(), "relative_spread")
    + _fields(LongType(), "open_interest daily_volume")
    + _fields(DoubleType(), "data_age_minutes")
    + _fields(BooleanType(), "feature_complete leakage_valid model_valid system_healthy drift_alert")
)


def conform(frame: DataFrame, schema: StructType, keep_extra: bool = True) -> DataFrame:
    """Give ``frame`` every column of ``schema``: cast what is there (bad values
    become null, never an error), add what is missing as a typed null."""
    present = set(frame.columns)
    shaped = []
    for field in schema.fields:
        if field.name in present:
            column = F.col(field.name).try_cast(field.dataType)
            if isinstance(field.dataType, (DoubleType, FloatType)):
                column = missing(column)
            shaped.append(column.alias(field.name))
        else:
            shaped.append(F.lit(None).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in frame.columns if c not in set(schema.names)] if keep_extra else []
    return frame.select(*extra, *shaped)


def missing(column: Column) -> Column:
    """NaN means "missing" in the data; Spark would sort it above every number."""
    return F.when(F.isnan(column), F.lit(None)).otherwise(column)


def scan(frame: DataFrame) -> DataFrame:
    """Normalise a freshly read table: zone-less clocks become UTC timestamps and
    NaN becomes null.  A projection only, so pruning and pushdown still apply."""
    shaped = []
    for field in frame.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, TimestampNTZType):
            column = column.cast("timestamp")
        elif isinstance(field.dataType, (DoubleType, FloatType)):
            column = missing(column)
        shaped.append(column.alias(field.name))
    return frame.select(*shaped)


def truth(condition: Column) -> Column:
    """A comparison with a missing value is False, never null."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return truth(condition).cast("double")


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps null null (``greatest``/``least`` alone would skip it)."""
    out = column
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def ratio(top: Column, bottom: Column) -> Column:
    """Division where a zero or missing denominator gives null."""
    return F.try_divide(top, bottom)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# Column-name fragments that may never feed a model input.
FORBIDDEN_INPUT_TOKENS = (
    "future_", "target", "label", "realized_payoff", "realised_payoff",
    "next_", "forward_", "outcome",
)


def safe_inputs(columns: list[str]) -> list[str]:
    """Names that carry no hint of a future value."""
    return [c for c in columns if not any(token in c.lower() for token in FORBIDDEN_INPUT_TOKENS)]
