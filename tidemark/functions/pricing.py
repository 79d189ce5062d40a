"""Option valuation as column expressions (all JVM-side)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import clip

# Abramowitz-Stegun 7.1.26 coefficients (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Volatility bounds in the formula, for the benchmark choice and its default.
SIGMA_BOUNDS = (0.01, 5.0)
BENCHMARK_SIGMA_BOUNDS = (0.08, 3.0)
BENCHMARK_SIGMA_DEFAULT = 0.35
DAYS_PER_YEAR = 365.0


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))


def probability_above(mean: Column, sigma: Column, threshold: float = 0.0) -> Column:
    """P(return > threshold) of a normal with this mean and (floored) sigma."""
    scale = F.greatest(sigma, F.lit(1e-8))
    return normal_cdf((mean - F.lit(threshold)) / scale)


@dataclass(frozen=True)
class Quote:
    spot: Column
    strike: Column
    years: Column
    rate: Column
    sigma: Column


def _d1(q: Quote) -> Column:
    v = clip(q.sigma, *SIGMA_BOUNDS)
    return (F.ln(q.spot / q.strike) + (q.rate + 0.5 * v * v) * q.years) / (v * F.sqrt(q.years))


def _valued(q: Quote, live: Column, intrinsic: Column) -> Column:
    usable = (q.spot > 0) & (q.strike > 0) & q.rate.isNotNull() & q.sigma.isNotNull() & q.years.isNotNull()
    return F.when(usable & (q.years <= 0), intrinsic).when(usable, live)


def call_value(q: Quote) -> Column:
    v = clip(q.sigma, *SIGMA_BOUNDS)
    d1 = _d1(q)
    d2 = d1 - v * F.sqrt(q.years)
    live = q.spot * normal_cdf(d1) - q.strike * F.exp(-q.rate * q.years) * normal_cdf(d2)
    return _valued(q, live, call_intrinsic(q.spot, q.strike))


def put_value(q: Quote) -> Column:
    v = clip(q.sigma, *SIGMA_BOUNDS)
    d1 = _d1(q)
    d2 = d1 - v * F.sqrt(q.years)
    live = q.strike * F.exp(-q.rate * q.years) * normal_cdf(-d2) - q.spot * normal_cdf(-d1)
    return _valued(q, live, put_intrinsic(q.spot, q.strike))


def call_intrinsic(spot: Column, strike: Column) -> Column:
    return clip(spot - strike, low=0.0)


def put_intrinsic(spot: Column, strike: Column) -> Column:
    return clip(strike - spot, low=0.0)
