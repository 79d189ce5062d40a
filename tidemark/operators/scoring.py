"""Models of call/put pairs at many horizons: fit once, save, load in another session, score batches.

One set of boosted trees serves all horizons, which are features; probabilities are then
calibrated per horizon, as 70 % at fifteen minutes is not 70 % at a week.  Everything a
model learnt is one MLlib pipeline and two small tables by horizon, so a bundle is a folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranking, research, risk
from tidemark.operators.relationships import joint_state
from tidemark.operators.targets import HORIZONS, TARGET_CLIP, horizon_columns
from tidemark.schema import clip
from tidemark.session import cut

HORIZON_FEATURES = ("horizon_equivalent_market_minutes", "horizon_log_minutes", "horizon_is_session")
# Smallest calibration sample and the penalty of a calibrator's weights.
LEAST_CALIBRATION, CALIBRATION_L2 = 100, 1.0
STATES = risk.STATE_ORDER
SIDES = ("call", "put")
EVIDENCE = ("n", "observed_positive_rate", "ci95_low", "ci95_high", "mean_realized_return", "mean_positive_return", "mean_nonpositive_return")


class FillGaps(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Medians for missing features and a flag for each feature that had gaps in training.

    A feature that the frame lacks counts as missing in every row.
    """

    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "their medians", TypeConverters.toListFloat)
    gaps = Param(Params._dummy(), "gaps", "features with a flag", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, features=None, medians=None, gaps=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def columns(self) -> list[str]:
        return [f"_f_{c}" for c in self.getOrDefault(self.features)] + [f"_m_{c}" for c in self.getOrDefault(self.gaps)]

    def _transform(self, frame: DataFrame) -> DataFrame:
        of = lambda c: F.col(c).try_cast("double") if c in frame.columns else F.lit(None).cast("double")
        filled = {f"_f_{c}": F.coalesce(of(c), F.lit(m)) for c, m in zip(self.getOrDefault(self.features), self.getOrDefault(self.medians))}
        return frame.withColumns(filled | {f"_m_{c}": of(c).isNull().cast("double") for c in self.getOrDefault(self.gaps)})


def profit_labels(frame: DataFrame) -> DataFrame:
    """Gross-profit labels: the later time value of a side is above the present one; a missing return is no profit."""
    return frame.withColumns({f"{s}_profit": F.coalesce(F.col(f"future_{s}_extrinsic_return") > 0, F.lit(False)).cast("double") for s in SIDES})


# ---------------------------------------------------------------- calibration
def _softmax(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    z = x @ theta.T
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrators(rows: DataFrame, *, key: str, raw: list[str], label: str, classes: int, l2: float = CALIBRATION_L2, tolerance: float = 1e-9) -> DataFrame:
    """(key, n, theta): a multinomial logistic on raw probabilities for every key, all fitted together.

    Newton's method on sums: a pass adds up gradients and curvatures of all keys, each
    task its own rows first, so a pass is one job of a few numbers a key however many keys
    and rows there are.  Weights are penalised by ``l2``, intercepts are not, so the mean
    probability of a class is its share.  ``theta`` has a row a class, weights and then the
    intercept.  A key with fewer than ``LEAST_CALIBRATION`` rows or one class has no row.
    """
    d = len(raw) + 1
    data = cut(rows.filter(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(raw)]))
    shares: dict[str, np.ndarray] = {}
    for r in data.filter(F.col("key").isNotNull()).groupBy("key", "label").count().collect():
        shares.setdefault(r["key"], np.zeros(classes))[r["label"]] = r["count"]
    shares = {k: n for k, n in shares.items() if n.sum() >= LEAST_CALIBRATION and (n > 0).sum() > 1}
    thetas = {k: np.where((n > 0)[:, None], 0.0, [0.0] * (d - 1) + [-1e3]) for k, n in shares.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            x = np.column_stack([*[batch.column(f"x{i}").to_numpy() for i in range(d - 1)], np.ones(batch.num_rows)])
            y = np.eye(classes)[batch.column("label").to_numpy()]
            for k in set(keys.tolist()) & set(thetas):
                at = keys == k
                p = _softmax(x[at], thetas[k])
                curve = np.einsum("nk,ni,nj->kij", p, x[at], x[at])
                cross = np.einsum("nk,nl,ni,nj->kilj", p, p, x[at], x[at])
                h = -cross
                for c in range(classes):
                    h[c, :, c, :] += curve[c]
                held[k] = held.get(k, 0) + np.r_[((p - y[at]).T @ x[at]).ravel(), h.ravel()]
        for k, v in held.items():
            yield pa.record_batch([pa.array([k]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["key", "v"])
    for _ in range(50):
        if not thetas:
            break
        added = data.mapInArrow(sums, "key string, v array<double>").select("key", F.posexplode("v").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))
        totals = added.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v")).collect()
        moved = 0.0
        for r in totals:
            k, v, size = r["key"], np.array(r["v"]), classes * d
            ridge = np.tile(np.r_[np.full(d - 1, l2), 1e-9], classes)
            free = np.repeat(shares[k] > 0, d)
            grad = (v[:size] + ridge * thetas[k].ravel())[free]
            hess = (v[size:].reshape(size, size) + np.diag(ridge))[np.ix_(free, free)]
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            new = thetas[k].ravel().copy()
            new[free] -= step
            thetas[k] = new.reshape(classes, d)
            moved = max(moved, float(np.abs(grad).max() / shares[k].sum()))
        if moved < tolerance:
            break
    found = [(k, int(shares[k].sum()), thetas[k].ravel().tolist()) for k in sorted(thetas)]
    return rows.sparkSession.createDataFrame(found, "key string, n long, theta array<double>").withColumnRenamed("key", key)


def calibrated(raw: list[Column], theta: Column, classes: int) -> list[Column]:
    """Probabilities of every class; the raw ones where there is no calibrator."""
    d = len(raw) + 1
    z = [sum((F.get(theta, F.lit(k * d + i)) * x for i, x in enumerate(raw)), F.get(theta, F.lit(k * d + d - 1))) for k in range(classes)]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


# ---------------------------------------------------------------- the bundle
@dataclass
class Bundle:
    """Fitted trees, calibrators by (target, horizon), evidence by (side, horizon)."""
    pipeline: PipelineModel
    calibrators: DataFrame
    evidence: DataFrame

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.calibrators.coalesce(1).write.mode("overwrite").parquet(f"{path}/calibrators")
        self.evidence.coalesce(1).write.mode("overwrite").parquet(f"{path}/evidence")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        return cls(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/calibrators"), spark.read.parquet(f"{path}/evidence"))


def _raw(frame: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """Rows with returns and uncalibrated probabilities of all targets."""
    d = pipeline.transform(frame)
    one = lambda c: vector_to_array(f"_p_{c}")[1]
    total = sum((one(s) for s in STATES[1:]), one(STATES[0]))
    out = {f"_raw_{s}": F.when(total > 0, one(s) / total).otherwise(0.25) for s in STATES} | {f"_raw_{s}_profit": one(f"{s}_profit") for s in SIDES}
    return d.withColumns(out | {"prob_stock_up": one("stock_up")}).drop("_features", *[c for c in d.columns if c.startswith(("_p_", "_q_", "_l_", "_f_", "_m_"))])


def fit(rows: DataFrame, *, features: list[str], part: str, fit_part: str = "train", calibrate_part: str = "calibration", evidence_part: str = "test", trees: dict | None = None) -> Bundle:
    """A bundle from pair targets at many horizons.

    Returns, the stock's direction and gross profits learn from both earlier parts; the
    four joint outcomes learn from the first part alone, one boosted tree model against the
    rest each, and the later part calibrates every probability per horizon.  Evidence bins
    come from ``evidence_part``, which nothing was fitted on.
    """
    trees = trees or {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42}
    d = cut(profit_labels(horizon_columns(rows)).withColumns({
        **{f"{s}_return_label": clip(F.col(f"future_{s}_extrinsic_return"), *TARGET_CLIP) for s in SIDES}, "stock_up": F.coalesce(F.col("future_stock_return") > 0, F.lit(False)).cast("double"),
        "state": joint_state(F.col("future_call_extrinsic_return"), F.col("future_put_extrinsic_return"))}))
    first, both = d.filter(F.col(part) == fit_part), d.filter(F.col(part).isin(fit_part, calibrate_part))
    p = research.prepare(first, [*features, *HORIZON_FEATURES], F.col("stock_up"))
    gaps = FillGaps(features=p.features, medians=[float(p.medians[c]) for c in p.features], gaps=p.gaps)
    stages: list = [gaps, VectorAssembler(inputCols=gaps.columns(), outputCol="_features", handleInvalid="error")]
    ready = {name: cut(PipelineModel(stages).transform(x)) for name, x in (("first", first), ("both", both))}

    def classifier(name: str, source: str, label: Column) -> None:
        model = GBTClassifier(labelCol="_l", featuresCol="_features", **trees).fit(ready[source].withColumn("_l", label).filter(F.col("_l").isNotNull()))
        stages.append(model.setPredictionCol(f"_q_{name}").setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_l_{name}"))
    for s in SIDES:
        stages.append(GBTRegressor(labelCol=f"{s}_return_label", featuresCol="_features", predictionCol=f"{s}_return", **trees).fit(ready["both"].filter(F.col(f"{s}_return_label").isNotNull())))
    classifier("stock_up", "both", F.col("stock_up"))
    for s in SIDES:
        classifier(f"{s}_profit", "both", F.col(f"{s}_profit"))
    for s in STATES:
        classifier(s, "first", (F.col("state") == s).cast("double"))
    pipeline = PipelineModel(stages)
    judged = cut(_raw(d.filter(F.col(part).isin(calibrate_part, evidence_part)), pipeline))
    later = judged.filter(F.col(part) == calibrate_part)
    label = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")).cast("int") - 1
    tables = [calibrators(later.withColumn("_y", label), key="target_horizon", raw=[f"_raw_{s}" for s in STATES], label="_y", classes=len(STATES)).withColumn("target", F.lit("state"))]
    # Two classes of one weight each carry half the penalty of the single weight they stand for.
    tables += [calibrators(later, key="target_horizon", raw=[f"_raw_{s}_profit"], label=f"{s}_profit", classes=2, l2=2 * CALIBRATION_L2).withColumn("target", F.lit(f"{s}_profit")) for s in SIDES]
    known = cut(tables[0].unionByName(tables[1]).unionByName(tables[2]))
    seen = _with_probabilities(judged.filter(F.col(part) == evidence_part), known)
    evidence = None
    for s in SIDES:
        bins = metrics.evidence_bins(seen.filter(F.col(f"future_{s}_extrinsic_return").isNotNull()), keys=["target_horizon"], probability=f"prob_{s}_gross_profit", hit=f"{s}_profit", realised=f"future_{s}_extrinsic_return")
        bins = bins.select(F.lit(s).alias("side"), "target_horizon", "bin_low", "bin_high", "mean_predicted_probability", *EVIDENCE)
        evidence = bins if evidence is None else evidence.unionByName(bins)
    return Bundle(pipeline, known, cut(evidence))


def _with_probabilities(raw: DataFrame, table: DataFrame) -> DataFrame:
    """Calibrated probabilities of rows of ``_raw``; the tables have a row a horizon."""
    d = raw
    for target in ("state", *[f"{s}_profit" for s in SIDES]):
        d = d.join(table.filter(F.col("target") == target).select("target_horizon", F.col("theta").alias(f"_t_{target}")), "target_horizon", "left")
    out = {}
    names = [f"_raw_{s}" for s in STATES]
    for s, p in zip(STATES, calibrated([F.col(c) for c in names], F.col("_t_state"), len(STATES))):
        out[f"prob_{s}"] = F.coalesce(p, F.col(f"_raw_{s}"))
    for s in SIDES:
        name = f"{s}_profit"
        out[f"prob_{s}_gross_profit"] = F.coalesce(calibrated([F.col(f"_raw_{name}")], F.col(f"_t_{name}"), 2)[1], F.col(f"_raw_{name}"))
    return d.withColumns(out).drop(*[c for c in d.columns if c.startswith(("_raw_", "_t_"))])


def score_horizons(rows: DataFrame, bundle: Bundle, *, horizons: tuple[str, ...] = tuple(h.code for h in HORIZONS), threshold: float = 0.60) -> DataFrame:
    """Every row at every horizon with expected values, calibrated probabilities, evidence, signal and score."""
    fanned = horizon_columns(rows.withColumn("target_horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))))
    return finish_scores(_with_probabilities(_raw(fanned, bundle.pipeline), bundle.calibrators), bundle.evidence, threshold=threshold)


def finish_scores(scored: DataFrame, evidence: DataFrame, *, threshold: float = 0.60) -> DataFrame:
    """What follows from returns and probabilities: evidence of each side's bin at the row's horizon, edges and signal."""
    d = scored
    for s in SIDES:
        bins = evidence.filter(F.col("side") == s).groupBy("target_horizon").agg(F.array_sort(F.collect_list(F.struct("bin_low", "bin_high", "mean_predicted_probability", *EVIDENCE))).alias("_bins"))
        d = d.join(bins, "target_horizon", "left")
        chosen = metrics.bin_of(F.col(f"prob_{s}_gross_profit"), F.col("_bins"))
        d = d.withColumn("_bin", chosen).withColumns({
            f"{s}_evidence_n": F.coalesce(F.col("_bin.n"), F.lit(0)), f"{s}_evidence_hit_rate": F.col("_bin.observed_positive_rate"), f"{s}_evidence_ci_low": F.col("_bin.ci95_low"),
            f"{s}_evidence_ci_high": F.col("_bin.ci95_high"), f"{s}_historical_mean_return": F.col("_bin.mean_realized_return")}).drop("_bin", "_bins")
    return risk.edge_signals(d, threshold)


def best_opportunities(scored: DataFrame, *, horizon: str = "target_horizon", n: int = 25) -> DataFrame:
    """The best rows per horizon of a scored batch (1 to 100)."""
    if not 1 <= n <= 100:
        raise ValueError("between 1 and 100 rows per horizon")
    return ranking.top_per_group(scored, keys=[horizon], order=[F.col("paper_opportunity_score").desc(), F.col("most_likely_state_probability").desc()], n=n)
