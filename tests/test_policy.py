"""No default drops rows: long keys, many features, unknown horizons, all links, patterns and runs."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, pages, relationships, scan
from tidemark.sources import results, snapshots


def test_ema_of_a_long_key_equals_pandas(spark):
    n = 10_000
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(0, 1, n).cumsum() * 0.01
    gaps = rng.random(n) < 0.2
    gaps[3000:7000] = True  # one long silence
    pdf = pd.DataFrame({"k": "a", "ts": np.arange(n), "close": np.where(gaps, np.nan, close)})
    d = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None)))
    got = indicators.ewm_mean(d, "close", 12, keys=["k"], order="ts", out="m").orderBy("ts").toPandas()["m"].to_numpy(float)
    want = pdf["close"].ewm(span=12, adjust=False).mean().to_numpy()
    known = ~np.isnan(want)
    assert np.allclose(got[known], want[known], rtol=1e-9) and np.isnan(got[~known]).all()


def test_every_feature_is_scanned(spark):
    names = [f"f{i}" for i in range(1500)]
    d = spark.range(3).select(F.lit("T").alias("ticker"), F.lit("discovery").alias("split"), F.col("id").cast("double").alias("y"), *[F.col("id").alias(n) for n in names])
    pairs = scan.long_pairs(d, features=names, target="y", keys=["split", "ticker"])
    assert pairs.select("feature").distinct().count() == 1500


def test_units_with_unknown_horizons_are_kept(spark):
    d = spark.createDataFrame([("A", 1, 45), ("A", 1, 60), ("B", 1, 90), ("B", 1, 45), ("C", 1, 7)], "ticker string, day int, h int")
    got = {r["ticker"]: r["h"] for r in snapshots.preferred_copy(d, keys=["ticker", "day"], horizon="h").collect()}
    assert got == {"A": 60, "B": 45, "C": 7}


@pytest.mark.parametrize("limit", [None, 5])
def test_links_are_whole_unless_asked(spark, limit):
    html = "".join(f'<a href="http://x.example.net/{i % 150}">A title that is long enough {i}</a>' for i in range(300))
    d = spark.createDataFrame([(1, "http://y.example.net/", html)], "id int, url string, html string")
    got = pages.harvest_links(d, key="id", url="url", html="html", limit=limit).orderBy("position").collect()
    assert [r["href"] for r in got] == [f"http://x.example.net/{i}" for i in range(limit or 150)]
    assert got[3]["title"].endswith(" 3")


def test_all_runs_are_on_the_card(spark):
    rows = [(f"r{i:03d}", [(f"e{i}", (1, float(i)))]) for i in range(80)]
    d = spark.createDataFrame(rows, "run string, experiments array<struct<name: string, holdout: struct<trades: int, ev: double>>>")
    assert results.scorecard(d, run="run", created="run").count() == 80
    assert {r["run"] for r in results.scorecard(d, run="run", created="run", last=2).collect()} == {"r078", "r079"}


def test_patterns_match_like_a_nested_loop(spark):
    fields = ("support", "lift", "score", "prob_call_up_put_down", "prob_call_down_put_up", "prob_both_up", "prob_both_down", "prob_stock_up")
    patterns = [(p, 10.0 + p, 0.01 * p, float(p % 5), 0.1, 0.2, 0.3, 0.4, 0.5 + 0.001 * p) for p in range(1, 200) if bin(p).count("1") <= 3]
    pat = spark.createDataFrame(patterns, "pattern long, " + ", ".join(f"{f} double" for f in fields))
    masks = [(i, i * 37 % 256) for i in range(60)] + [(60, None), (61, 0)]
    rows = spark.createDataFrame(masks, "id int, mask long")
    got = {r["id"]: r for r in relationships.add_pattern_priors(rows, pat).collect()}
    for i, mask in masks:
        hits = [p for p in patterns if mask is not None and mask & p[0] == p[0]]
        assert got[i]["relationship_match_count"] == len(hits)
        if hits:
            w = [max(p[1], 1) ** 0.5 for p in hits]
            assert got[i]["relationship_prior_stock_up"] == pytest.approx(sum(p[8] * x for p, x in zip(hits, w)) / sum(w))
    full = relationships.explain(rows, pat)
    assert full.count() == sum(r["relationship_match_count"] for r in got.values())
    top = relationships.explain(rows, pat, limit=3).filter("id = 5").orderBy("position").collect()
    want = sorted((p for p in patterns if (5 * 37 % 256) & p[0] == p[0]), key=lambda p: (-p[3], p[0]))[:3]
    assert [r["pattern"] for r in top] == [p[0] for p in want]
