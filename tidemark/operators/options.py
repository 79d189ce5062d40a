"""Option contracts: symbols, economics, call/put pairs, valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.pricing import (
    BENCHMARK_SIGMA_BOUNDS, BENCHMARK_SIGMA_DEFAULT, DAYS_PER_YEAR, SIGMA_BOUNDS, call_intrinsic, normal_cdf, put_intrinsic,
)
from tidemark.operators.ordered import null_safe_join
from tidemark.schema import clip, ratio, truth

# The option symbol format and price scale.
OCC_PATTERN = r"^O:([A-Z0-9.\-]+?)(\d{6})([CP])(\d{8})$"
STRIKE_SCALE = 1000.0
RATIO_FLOOR = 1e-8


def parse_symbol(frame: DataFrame, symbol: str) -> DataFrame:
    """Symbol parts as columns: a projection, so no join and no shuffle per bar row."""
    part = lambda i: F.nullif(F.regexp_extract(F.col(symbol), OCC_PATTERN, i), F.lit(""))
    return frame.withColumns({
        "underlying": part(1),
        "expiry": F.try_to_date(part(2), "yyMMdd"),
        "option_type": F.when(part(3) == "C", "call").when(part(3) == "P", "put"),
        "strike": part(4).try_cast("double") / STRIKE_SCALE,
    })


def contract_dimension(frame: DataFrame, symbol: str) -> DataFrame:
    """Distinct contracts with their parts and row count; only symbols are shuffled,
    combined per task first, and each is parsed once."""
    counts = frame.groupBy(symbol).agg(F.count(F.lit(1)).alias("rows"))
    return parse_symbol(counts, symbol)


def economics(frame: DataFrame, *, spot: str, strike: str, price: str, option_type: str,
              dte: Column | None = None) -> DataFrame:
    """Intrinsic and extrinsic value, log-moneyness, call flag (and days to expiry)."""
    is_call = F.col(option_type) == "call"
    intrinsic = F.when(is_call, call_intrinsic(F.col(spot), F.col(strike))).otherwise(
        put_intrinsic(F.col(spot), F.col(strike)))
    out = frame.withColumns({
        "is_call": truth(is_call).cast("double"),
        "intrinsic": intrinsic,
        "extrinsic": clip(F.col(price) - intrinsic, low=0.0),
        "log_moneyness": F.ln(ratio(F.nullif(spot, F.lit(0.0)), F.col(strike))),
    })
    return out.withColumn("dte", dte) if dte is not None else out


def days_to_expiry(expiry: Column, ts: Column) -> Column:
    """Days from an instant to midnight UTC of the expiry date."""
    return (F.unix_micros(expiry.cast("timestamp")) - F.unix_micros(ts)) / 86_400e6


def pair(frame: DataFrame, *, keys: list[str], option_type: str, order: list[str],
         measures: list[str], context: list[str] | None = None) -> DataFrame:
    """Call and put of the same key side by side, the last row of each kept.

    One grouping with map-side combine replaces two de-duplications and a join.
    """
    context = context or []
    at = F.struct(*[F.col(c) for c in order])
    rows = {side: F.struct(*[F.col(c) for c in [*measures, *(context if side == "call" else [])]])
            for side in ("call", "put")}
    grouped = frame.groupBy(*keys).agg(*[
        F.max_by(F.when(F.col(option_type) == side, rows[side]),
                 F.when(F.col(option_type) == side, at)).alias(side)
        for side in ("call", "put")])
    both = grouped.filter(F.col("call").isNotNull() & F.col("put").isNotNull())
    return both.select(
        *keys,
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("call", "put") for c in measures],
        *[F.col(f"call.{c}").alias(c) for c in context])


def benchmark_sigma(frame: DataFrame, *, keys: list[str], long: str, short: str,
                    out: str = "benchmark_sigma") -> DataFrame:
    """The 60-row volatility if a ticker-day has any, else the 30-row one.

    One count a ticker-day, combined before the shuffle and joined back, so the rows
    of a busy ticker-day stay where they are.
    """
    counts = frame.groupBy(*keys).agg((F.count(long) > 0).alias("_has_long"))
    d = null_safe_join(frame, counts, keys)
    chosen = F.when(F.col("_has_long"), F.col(long)).otherwise(F.col(short))
    return d.withColumn(out, F.coalesce(clip(chosen, *BENCHMARK_SIGMA_BOUNDS), F.lit(BENCHMARK_SIGMA_DEFAULT))).drop("_has_long")


def valuation(frame: DataFrame, *, spot: str, strike: str, dte: str, rate: str, sigma: str,
              call_actual: str | None = None, put_actual: str | None = None) -> DataFrame:
    """Theoretical call and put value, time value and gap to the observed time value.

    The distribution terms are staged as columns: each is computed once per row and
    shared by call and put, and the generated code stays small enough to compile.
    """
    s_, k_, r_, t_ = F.col(spot), F.col(strike), F.col(rate), F.col("_years")
    d = frame.withColumns({"_years": clip(F.col(dte), low=0.0) / DAYS_PER_YEAR, "_v": clip(F.col(sigma), *SIGMA_BOUNDS)})
    usable = (s_ > 0) & (k_ > 0) & r_.isNotNull() & F.col("_v").isNotNull() & t_.isNotNull()
    d = d.withColumn("_d1", F.when(usable & (t_ > 0), (F.ln(s_ / k_) + (r_ + 0.5 * F.col("_v") * F.col("_v")) * t_) / (F.col("_v") * F.sqrt(t_))))
    d = d.withColumn("_d2", F.col("_d1") - F.col("_v") * F.sqrt(t_))
    d = d.withColumns({"_n1": normal_cdf(F.col("_d1")), "_n2": normal_cdf(F.col("_d2")), "_k": k_ * F.exp(-r_ * t_),
                       "_ci": call_intrinsic(s_, k_), "_pi": put_intrinsic(s_, k_)})
    due = usable & (t_ <= 0)
    d = d.withColumns({
        "bs_call_price": F.when(due, F.col("_ci")).otherwise(s_ * F.col("_n1") - F.col("_k") * F.col("_n2")),
        "bs_put_price": F.when(due, F.col("_pi")).otherwise(F.col("_k") * (1 - F.col("_n2")) - s_ * (1 - F.col("_n1")))})
    out = d.withColumns({"bs_call_extrinsic": clip(F.col("bs_call_price") - F.col("_ci"), low=0.0),
                         "bs_put_extrinsic": clip(F.col("bs_put_price") - F.col("_pi"), low=0.0)}).drop(
        "_years", "_v", "_d1", "_d2", "_n1", "_n2", "_k", "_ci", "_pi")
    if call_actual:
        out = out.withColumn("call_expectation_gap", F.col("bs_call_extrinsic") - F.col(call_actual))
    if put_actual:
        out = out.withColumn("put_expectation_gap", F.col("bs_put_extrinsic") - F.col(put_actual))
    return out


def pair_ratios(frame: DataFrame, *, call_return: str, put_return: str, volumes: dict[str, tuple[str, str]],
                extrinsics: tuple[str, str]) -> DataFrame:
    """Divergence, joint sign states and call/put ratios of a pair row."""
    c, p = F.col(call_return), F.col(put_return)
    columns = {
        "call_put_return_divergence_5m": c - p,
        "call_up_put_down_5m": truth((c > 0) & (p < 0)).cast("int"),
        "call_down_put_up_5m": truth((c < 0) & (p > 0)).cast("int"),
        "both_options_up_5m": truth((c > 0) & (p > 0)).cast("int"),
        "both_options_down_5m": truth((c < 0) & (p < 0)).cast("int"),
        "call_put_extrinsic_ratio": ratio(F.col(extrinsics[0]) + RATIO_FLOOR, F.col(extrinsics[1]) + RATIO_FLOOR),
    }
    for name, (call, put) in volumes.items():
        columns[name] = ratio(F.col(call) + 1, F.col(put) + 1)
    return frame.withColumns(columns)


def parity_residual(call: Column, put: Column, spot: Column, strike: Column, dte: Column, rate: Column) -> Column:
    return call - put - (spot - strike * F.exp(-rate * clip(dte, low=0.0) / DAYS_PER_YEAR))


def enrich_chain(frame: DataFrame, *, spot: str, strike: str, option_type: str, bid: str, ask: str,
                 last: str, close: str) -> DataFrame:
    """Live-chain columns: mid (quotes, else last trade, else day close), intrinsic,
    time value and relative spread in percent."""
    mid = F.coalesce((F.col(bid) + F.col(ask)) / 2, F.col(last), F.col(close))
    is_call = F.col(option_type) == "call"
    intrinsic = F.when(is_call, call_intrinsic(F.col(spot), F.col(strike))).otherwise(
        put_intrinsic(F.col(spot), F.col(strike)))
    return frame.withColumn("mid", mid).withColumn("intrinsic", intrinsic).withColumns({
        "time_value": clip(F.col("mid") - F.col("intrinsic"), low=0.0),
        "spread_pct": ratio(F.col(ask) - F.col(bid), F.col("mid")) * 100,
    })
