"""Indicators, ranks, quantiles, pricing and the t tail against reference values."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pricing
from tidemark.operators import indicators as ind
from tidemark.operators import metrics, ordered
from tidemark.operators.scan import student_tail


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    n = 90
    pdf = pd.DataFrame({"ticker": "T", "day": "d", "ts": pd.date_range("2025-01-02 14:30", periods=n, freq="min"),
                        "close": 100 * np.exp(np.cumsum(rng.normal(0, .002, n))), "volume": rng.integers(1, 99, n).astype(float)})
    pdf["high"], pdf["low"] = pdf.close * 1.01, pdf.close * .99
    return pdf, spark.createDataFrame(pdf)


def test_indicators_match_pandas(bars):
    pdf, sdf = bars
    got = ind.stock_features(sdf).orderBy("ts").toPandas()
    px, lr = pdf.close, np.log(pdf.close).diff()
    want = {"stock_return_30m": px.pct_change(30), "realized_vol_30m": lr.rolling(30, min_periods=8).std() * np.sqrt(390 * 252),
            "sma_10_ratio": px / px.rolling(10, min_periods=3).mean() - 1,
            "macd_ratio": (px.ewm(span=12, adjust=False).mean() - px.ewm(span=26, adjust=False).mean()) / px}
    for name, series in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), series.to_numpy(float), rtol=1e-9, atol=1e-12, equal_nan=True)


def test_exponential_mean_over_gaps(spark):
    rows = [(i, v) for i, v in enumerate([None, 1.0, None, 3.0, 4.0, None, None, 2.0])]
    d = spark.createDataFrame([("k", i, v) for i, v in rows], "k string, i int, v double")
    got = [r["e"] for r in ind.ewm_mean(d, "v", 3, keys=["k"], order="i", out="e").orderBy("i").collect()]
    want = pd.Series([v for _, v in rows], dtype=float).ewm(span=3, adjust=False).mean().tolist()
    np.testing.assert_allclose([np.nan if g is None else g for g in got], want, equal_nan=True)


def test_padded_lag_return(spark):
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, None, 2.0])], "k string, ts int, close double")
    got = [r["r1m"] for r in ind.lag_returns(d, keys=["k"], lags=(1,), prefix="r").orderBy("ts").collect()]
    assert got == [None, 0.0, 1.0]


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "a", "b"], 400), "v": rng.integers(0, 40, 400).astype(float)})
    ranks = {(r["k"], r["v"]): r["a"] for r in ordered.value_ranks(spark.createDataFrame(pdf), keys=["k"], value="v", splits=5)
             .withColumn("a", ordered.average_rank()).collect()}
    pdf["rank"] = pdf.groupby("k")["v"].rank()
    assert all(ranks[(k, v)] == a for k, v, a in zip(pdf.k, pdf.v, pdf["rank"]))
    q = ordered.exact_quantiles(spark.createDataFrame(pdf), keys=["k"], value="v", probabilities={"p": .37}).collect()
    for r in q:
        assert r["p"] == pytest.approx(np.quantile(pdf[pdf.k == r["k"]].v, .37))
    one = ordered.exact_quantiles(spark.createDataFrame(pdf), keys=[], value="v", probabilities={"p": .9}).first()
    assert one["p"] == pytest.approx(np.quantile(pdf.v, .9)) and one["n"] == 400


def test_option_value(spark):
    q = pricing.Quote(*[F.lit(float(x)) for x in (100, 95, .25, .03, .4)])
    call, put = spark.range(1).select(pricing.call_value(q), pricing.put_value(q)).first()
    phi = lambda x: .5 * (1 + math.erf(x / math.sqrt(2)))
    d1 = (math.log(100 / 95) + (.03 + .08) * .25) / .2
    want = 100 * phi(d1) - 95 * math.exp(-.0075) * phi(d1 - .2)
    assert call == pytest.approx(want, abs=5e-5)
    assert call - put == pytest.approx(100 - 95 * math.exp(-.0075), abs=5e-5)


def test_t_tail():
    # two-sided values from standard tables
    for t, df, p in ((2.228, 10, .05), (1.96, 1e6, .05), (3.169, 10, .01), (12.706, 1, .05)):
        assert student_tail([t], [df])[0] == pytest.approx(p, rel=2e-3)


def test_economics(spark):
    d = spark.createDataFrame([(1, .20, .12, .05, True), (2, -.10, .11, .05, True), (3, .15, .13, .05, False)],
                              "i int, actual_return double, expected_return double, cost double, trade boolean")
    m = metrics.economic_metrics(d, keys=[], order=["i"], bucket="i").first()
    assert m["number_of_trades"] == 2 and m["expected_value_per_trade"] == pytest.approx(0) and m["maximum_drawdown"] > 0
    assert m["net_return"] == pytest.approx(1.15 * .85 - 1)


def test_false_discovery(spark):
    d = spark.createDataFrame([(p,) for p in (.001, .01, .04, .7, None)], "p double")
    q = {r["p"]: r["q"] for r in metrics.benjamini_hochberg(d, keys=[], p="p").collect()}
    assert q[None] is None and q[.001] == pytest.approx(.004) and q[.01] == pytest.approx(.02) and q[.7] == pytest.approx(.7)


def test_stability_index(spark):
    rows = [("f", float(x), True) for x in np.linspace(0, 1, 100)] + [("f", float(x), False) for x in np.linspace(2, 3, 100)]
    rows += [("flat", 1.0, i % 2 == 0) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, v double, ref boolean")
    got = {r["k"]: r["psi"] for r in metrics.stability_index(d, keys=["k"], value="v", is_reference="ref").collect()}
    assert got["f"] > .25 and got["flat"] == 0.0
