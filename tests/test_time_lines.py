"""Many sources in one time line, running quantiles of a whole table, later-session targets, monitoring in parts."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes, targets
from tidemark.operators.asof import Source, asof, asof_many
from tidemark.streaming import jobs

START = dt.datetime(2024, 1, 2, 14, 30)


def lines(spark, seed, n, keys="ab", value="v"):
    r = random.Random(seed)
    rows = [(r.choice(keys), START + dt.timedelta(minutes=r.randrange(0, 6000, 7)) if r.random() > 0.03 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, f"k string, t timestamp, {value} long")


def test_many_sources_equal_one_by_one(spark):
    left = lines(spark, 1, 300, "abc", "row")
    one, two = lines(spark, 2, 120, "ab", "x"), lines(spark, 3, 40, "b", "y")
    got = asof_many(left, [Source(one, "t", ("x",), ("x",), 3600.0), Source(two, "t", ("y",), ("y",))], keys=["k"], left_time="t")
    want = asof(left, one, keys=["k"], left_time="t", right_time="t", tolerance_seconds=3600, tie=["x"], take=["x"])
    want = asof(want, two, keys=["k"], left_time="t", right_time="t", tie=["y"], take=["y"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n", [0, 20, 31, 700])
def test_running_terciles_equal_pandas(spark, n):
    r = np.random.default_rng(n)
    value = np.round(r.normal(size=n), 1)
    value[r.random(n) < 0.1] = np.nan
    value[r.random(n) < 0.3] = 0.5
    if n:
        value[-2:] = np.nan
    frame = pd.DataFrame({"day": np.arange(n) // 9, "i": np.arange(n), "value": value})
    rows = spark.createDataFrame(frame, "day long, i long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    got = regimes.prior_terciles_over_all(rows, bucket="day", order=["day", "i"], value="value", least_block=40).toPandas().sort_values("i")
    for name, q in (("_low", 0.33), ("_high", 0.67)):
        want = frame["value"].expanding(min_periods=30).quantile(q).shift(1)
        np.testing.assert_allclose(got[name].astype(float).to_numpy(), want.to_numpy(), atol=1e-12)


def test_later_sessions_at_the_nearest_minute(spark):
    day = lambda d, minute: START + dt.timedelta(days=d, minutes=minute)
    rows = [("u", 0, day(0, 10), 1.0), ("u", 0, day(0, 60), 2.0), ("u", 1, day(1, 8), 3.0), ("u", 1, day(1, 12), 4.0), ("u", 1, day(1, 49), 5.0), ("u", 9, day(9, 10), 6.0)]
    frame = spark.createDataFrame(rows, "k string, d int, ts timestamp, v double").withColumn("day", F.to_date("ts"))
    out = targets.session_minute_targets(frame, keys=["k"], calendar_keys=["k"], ts="ts", day="day", take={"v": "later"}, tie=[])
    got = {(r["v"], r["target_horizon"]): r["later"] for r in out.collect()}
    # 8 and 12 minutes are as near to 10: the earlier one; 49 is 11 minutes from 60; day 9 is too far for one or two sessions
    assert got == {(1.0, "D1"): 3.0, (2.0, "D1"): None}


def records(n):
    r = random.Random(5)
    return [(r.choice("ab"), i, r.uniform(-.02, .05), r.uniform(-.08, .08) if r.random() > .1 else None, r.random(), float(r.random() > .4), .02, r.uniform(0, .06), r.choice([.05, .1, .2]), float(r.randrange(80)))
            for i in range(n)]


def test_monitoring_does_not_depend_on_the_batches(spark, tmp_path):
    schema = ("book string, at long, expected_net_return double, actual_net_return double, probability_positive double, positive_outcome double, expected_cost_return double, "
              "actual_cost_return double, relative_spread double, open_interest double")
    rows = records(400)
    out = {}
    for parts in (1, 5):
        folder = str(tmp_path / f"in{parts}")
        for k in range(parts):  # file times give the order of batches
            part = rows[k * len(rows) // parts:(k + 1) * len(rows) // parts]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("block", F.floor(F.col("at") / 16))
        found = spark.read.parquet(jobs.monitor_batches(stream, keys=["book"], order=["at"], bucket="block"))
        assert found.select("batch").distinct().count() == parts
        newest = found.groupBy("book").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("book", "batch")]), "batch").alias("s")).select("book", "s.*")
        out[parts] = newest.toPandas().sort_values("book").reset_index(drop=True)
    assert out[1]["rows"].sum() == 400 and len(out[1]["triggers"][0]) > 1
    one, five = (x.assign(triggers=x["triggers"].map(list)) for x in out.values())
    pd.testing.assert_frame_equal(one, five, rtol=1e-9)
