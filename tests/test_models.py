"""Model bundles: what is loaded scores as what was fitted; calibrators against scikit-like optimality."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import scoring


def pairs(spark, n=400):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2))
    rows = [(i, "D1" if i % 2 else "W1", float(1 + abs(a)), float(1 + abs(b)), float(a) if i % 11 else None, float(b), float(np.sign(a) * .1 + .05 * r.normal()), float(np.sign(b) * .1 + .05 * r.normal()),
             float(a) / 10, "train" if i < n // 2 else "calibration" if i < 3 * n // 4 else "test") for i, (a, b) in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "id long, target_horizon string, call_extrinsic double, put_extrinsic double, a double, b double, future_call_extrinsic_return double, "
                                       "future_put_extrinsic_return double, future_stock_return double, part string")


def test_saved_bundle_scores_the_same(spark, tmp_path):
    rows = pairs(spark)
    bundle = scoring.fit(rows, features=["a", "b", "call_extrinsic"], part="part", trees={"maxIter": 2, "maxDepth": 2, "stepSize": 0.3, "seed": 1})
    bundle.save(str(tmp_path / "bundle"))
    loaded = scoring.Bundle.load(spark, str(tmp_path / "bundle"))
    plain = rows.drop("target_horizon", "b")  # a column that training had is missing: its median
    one, two = (scoring.score_horizons(plain, b, horizons=("D1", "W1", "M15")).toPandas().sort_values(["id", "target_horizon"]).reset_index(drop=True) for b in (bundle, loaded))
    pd.testing.assert_frame_equal(one, two)
    assert len(one) == 1200 and np.allclose(one[[f"prob_{s}" for s in scoring.STATES]].sum(axis=1), 1)
    assert (one[one.target_horizon == "M15"]["call_evidence_n"] == 0).all() and (one[one.target_horizon == "D1"]["call_evidence_n"] > 0).any()
    best = scoring.best_opportunities(scoring.score_horizons(plain, loaded, horizons=("D1", "W1")), n=5)
    assert best.count() == 10


def test_calibrators_are_optimal_and_skip_what_is_too_small(spark):
    r = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", int(r.integers(0, 3)), *map(float, p)) for i, p in enumerate(r.dirichlet([1, 2, 3], 900))]
    rows += [("few", 1, .2, .3, .5)] * 99 + [("one class", 2, .2, .3, .5)] * 200 + [("gap", i % 2 * 2, .1 + i % 5 / 10, .2, .3) for i in range(150)] + [(None, 1, .1, .2, .7)] * 150
    d = spark.createDataFrame(rows, "k string, y int, x0 double, x1 double, x2 double")
    found = {x["k"]: np.array(x["theta"]).reshape(3, 4) for x in scoring.calibrators(d, key="k", raw=["x0", "x1", "x2"], label="y", classes=3).collect()}
    assert set(found) == {"a", "b", "gap"}
    for k, theta in found.items():
        part = np.array([[*x[2:], 1.0] for x in rows if x[0] == k])
        y = np.eye(3)[[x[1] for x in rows if x[0] == k]]
        p = scoring._softmax(part, theta)
        grad = (p - y).T @ part
        grad[:, :3] += theta[:, :3]
        assert np.abs(grad[y.sum(0) > 0]).max() < 1e-5 and np.allclose(p.sum(0), y.sum(0), atol=1e-5)
