"""Candidate research on MLlib: models per fold, costs, decisions, suites.

Loops here run over configuration (a handful of folds, feature sets, sizes); the
rows of every step stay distributed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.pricing import probability_above
from tidemark.operators import audits, metrics, risk, splits, vectors
from tidemark.operators.scan import student_tail
from tidemark.schema import safe_inputs
from tidemark.session import cut

# Penalties, minimum sample sizes and tree settings.
RIDGE_ALPHA, MIN_TRAIN, MIN_TEST = 25.0, 40, 5
LOGISTIC_C = 0.15
TREES = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
MIN_TRADES, MIN_PROFITABLE_PERIODS = 20, 2


def historical_mean(folds: DataFrame, *, target: str, fold: str = "fold", role: str = "role") -> DataFrame:
    """Test rows of every fold with the train mean and spread as forecast."""
    known = folds.filter(F.col(target).isNotNull())
    fitted = known.filter(F.col(role) == "train").groupBy(fold).agg(
        F.avg(target).alias("expected_return"), F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("prediction_uncertainty"))
    return known.filter(F.col(role) == "test").join(fitted, fold)


@dataclass(frozen=True)
class Prepared:
    """Train-only statistics of one fit: medians, which features had gaps, target spread."""
    features: list[str]
    medians: dict[str, float]
    gaps: list[str]
    rows: int
    spread: float

    def columns(self) -> list[Column]:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(f"_f_{c}") for c in self.features]
        return filled + [F.col(c).isNull().cast("double").alias(f"_m_{c}") for c in self.gaps]

    def transform(self, frame: DataFrame) -> DataFrame:
        names = [f"_f_{c}" for c in self.features] + [f"_m_{c}" for c in self.gaps]
        d = frame.select("*", *self.columns())
        return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(d).drop(*names)


def prepare(train: DataFrame, features: list[str], target: Column) -> Prepared:
    """Medians, gaps and target spread of the training rows in one aggregate."""
    use = safe_inputs(features)
    row = train.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s"),
        *[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(f"m_{c}") for c in use],
        *[F.count_if(F.col(c).isNull()).alias(f"g_{c}") for c in use]).first()
    kept = [c for c in use if row[f"m_{c}"] is not None]
    return Prepared(kept, {c: row[f"m_{c}"] for c in kept}, [c for c in kept if row[f"g_{c}"]], row["n"], row["s"] or 0.0)


def ridge(train: DataFrame, features: list[str], target: str, alpha: float = RIDGE_ALPHA):
    """Ridge on standardised features with an unpenalised intercept.  The penalty is
    restated for a loss that is a mean and a target scaled by its deviation."""
    known = train.filter(F.col(target).isNotNull())
    p = prepare(known, features, F.col(target))
    if p.rows < MIN_TRAIN:
        raise ValueError("too few training rows")
    model = LinearRegression(labelCol=target, featuresCol="features", predictionCol="expected_return", elasticNetParam=0.0,
                             regParam=alpha / p.rows * max(p.spread, 1e-12), standardization=True, solver="normal").fit(p.transform(known))
    sigma = model.summary.rootMeanSquaredError * math.sqrt(p.rows / max(p.rows - 1, 1))
    return lambda frame: model.transform(p.transform(frame)).drop("features").withColumn("prediction_uncertainty", F.lit(sigma))


def fold_numbers(folds: DataFrame) -> list[int]:
    return [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]


def ridge_walk_forward(folds: DataFrame, *, features: list[str], target: str, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Out-of-fold ridge forecasts of every fold's test rows."""
    out = []
    for n in fold_numbers(folds):
        fold = folds.filter(F.col("fold") == n)
        predict = ridge(fold.filter(F.col("role") == "train"), features, target, alpha)
        out.append(predict(fold.filter((F.col("role") == "test") & F.col(target).isNotNull())))
    return reduce(DataFrame.unionByName, out)


def trade(predictions: DataFrame, *, target: str, cost: str, model: risk.CostModel = risk.CostModel()) -> DataFrame:
    """Probabilities, decision and net return of forecasts."""
    mean, sigma = F.col("expected_return"), F.col("prediction_uncertainty")
    d = predictions.withColumns({"actual_return": F.col(target), "probability": probability_above(mean, sigma),
                                 "probability_above_1pct": probability_above(mean, sigma, 0.01), "cost": F.col(cost)})
    return risk.decide(d, predicted="expected_return", cost="cost", uncertainty="prediction_uncertainty", actual="actual_return", model=model)


@dataclass(frozen=True)
class Candidate:
    name: str
    features: tuple[str, ...] = ()
    model: str = "ridge"


def evaluate(rows: DataFrame, candidate: Candidate, *, target: str, cost: str, day: str, label_end: str, order: list[str], bucket: str,
             config: splits.WalkForward = splits.WalkForward(), open_holdout: bool = False, walk: bool = True, available: tuple[str, ...] = (),
             provisional: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics per part, predictions) of one candidate.

    The holdout is set apart first, the folds are audited before any fit, for overlap
    and for values that became ``available`` only after the row's day, and the holdout
    is fitted and scored only when asked for; without ``walk`` it alone is.
    ``provisional`` names a flag of rows whose cost is no quote; ``costs_provisional``
    says whether any judged row has one.
    """
    parts = splits.holdout_split(rows, day=day, config=config, out="_part")
    research = parts.filter(F.col("_part") == "research").drop("_part")
    held = parts.filter(F.col("_part") != "purged").select(
        *rows.columns, F.lit(0).cast("long").alias("fold"), F.when(F.col("_part") == "research", "train").otherwise("test").alias("role"))
    folds = splits.walk_forward_folds(research, day=day, config=config) if walk or not open_holdout else held
    if open_holdout and walk:
        folds = folds.unionByName(held)
    folds = cut(folds)
    seen = audits.audit_point_in_time(folds, as_of=day, available=list(available), target=label_end, keys=["fold", "role"])
    late = sum((F.col(f"future_{c}") for c in available), F.col("missing_as_of") + F.col("non_future_targets"))
    audits.require(seen, late > 0, candidate.name)
    audits.require(audits.audit_columns(folds, list(candidate.features)) if candidate.features else folds.limit(0).withColumn("forbidden", F.lit(True)),
                   F.col("forbidden"), candidate.name)
    audits.require(audits.audit_purge(folds, as_of=day, label_end=label_end), ~F.col("valid"), candidate.name)
    if candidate.model == "historical_mean":
        made = historical_mean(folds, target=target)
    else:
        made = ridge_walk_forward(folds, features=list(candidate.features), target=target)
    made = cut(trade(made, target=target, cost=cost).withColumn("part", F.when(F.col("fold") == 0, "holdout").otherwise("walk_forward")))
    economic = metrics.economic_metrics(made, keys=["part"], order=order, bucket=bucket)
    predictive = metrics.predictive_metrics(made, keys=["part"])
    profitable = made.filter(F.col("trade")).groupBy("part", "fold").agg(F.sum("actual_net_return").alias("s")).groupBy("part").agg(
        F.count_if(F.col("s") > 0).alias("profitable_periods"))
    rough = F.coalesce(F.col(provisional).cast("boolean"), F.lit(True)) if provisional else F.lit(False)
    flags = made.groupBy("part").agg(F.max(rough).alias("costs_provisional"))
    out = economic.join(predictive, "part").join(flags, "part").join(profitable, "part", "left").fillna(0, ["profitable_periods"])
    return out.withColumns({"candidate": F.lit(candidate.name), "model": F.lit(candidate.model), "target": F.lit(target), "leakage_valid": F.lit(True)}), made


def breakdowns(predictions: DataFrame, dimensions: dict[str, str], *, order: list[str], bucket: str) -> DataFrame:
    """Economic metrics of predictions per part and value of each dimension (name -> column)."""
    return metrics.economic_metrics(metrics.breakdown_rows(predictions, dimensions), keys=["part", "dim", "value"], order=order, bucket=bucket)


def suite(rows: DataFrame, candidates: list[Candidate], *, targets: list[str], ticker: str, day: str, **settings) -> DataFrame:
    """Baseline and candidates per target; the choice uses walk-forward results only,
    then baseline and the chosen one alone see the holdout.  Paired t-tests against
    the baseline are one family over all targets and candidates of the suite.  ``stable``
    marks a candidate with a positive value on the holdout, enough trades and periods."""
    blocks, tests = [], []
    for target in targets:
        base = Candidate("historical_mean", (), "historical_mean")
        base_metrics, base_made = evaluate(rows, base, target=target, day=day, **settings)
        scored = [base_metrics]
        summary = []
        for c in candidates:
            m, made = evaluate(rows, c, target=target, day=day, **settings)
            scored.append(m)
            row = m.filter(F.col("part") == "walk_forward").first()
            summary.append((c, row))
            t = metrics.paired_test(made, base_made, on=[ticker, day], value="actual_net_return", keys=["part"]).first()
            p = float(student_tail([t["t_statistic"]], [max(t["n"] - 1, 1)])[0]) if t and t["t_statistic"] is not None else None
            tests.append((c.name, target, int(t["n"]) if t else 0, t["t_statistic"] if t else None, p))
        good = [x for x in summary if x[1]["number_of_trades"] >= MIN_TRADES and x[1]["profitable_periods"] >= MIN_PROFITABLE_PERIODS]
        chosen = max(good or summary, key=lambda x: (x[1]["expected_value_per_trade"], -x[1]["maximum_drawdown"]))[0]
        for c in (base, chosen):
            m, _ = evaluate(rows, c, target=target, day=day, open_holdout=True, walk=False, **settings)
            scored.append(m.filter(F.col("part") == "holdout"))
        blocks.append(reduce(DataFrame.unionByName, scored).withColumn("selected_before_holdout", F.col("candidate") == chosen.name))
    tested = rows.sparkSession.createDataFrame(tests, "candidate string, target string, pairs long, t_statistic double, p double")
    tested = metrics.benjamini_hochberg(tested, keys=[], p="p")
    out = reduce(DataFrame.unionByName, blocks).join(tested, ["candidate", "target"], "left")
    earlier = out.filter(F.col("part") == "walk_forward").select("candidate", "target", F.col("profitable_periods").alias("_periods"))
    stable = (F.col("part") == "holdout") & (F.col("model") != "historical_mean") & (F.col("expected_value_per_trade") > 0) & (
        F.col("number_of_trades") >= MIN_TRADES) & (F.col("_periods") >= MIN_PROFITABLE_PERIODS)
    return out.join(earlier, ["candidate", "target"], "left").withColumn("stable", F.coalesce(stable, F.lit(False))).drop("_periods")


def balance_weight(label: Column, positives: float, rows: float) -> Column:
    return F.when(label > 0, rows / (2 * max(positives, 1.0))).otherwise(rows / (2 * max(rows - positives, 1.0)))


def calibrated_logistic(rows: DataFrame, *, features: list[str] | None, label: str, part: str, vector: str | None = None,
                        c: float = LOGISTIC_C) -> DataFrame:
    """Balanced logistic fitted on train, its margin recalibrated on the later
    calibration period, applied to the rest.  Adds ``probability``."""
    known = rows.filter(F.col(label).isNotNull())
    train = known.filter(F.col(part) == "train")
    if vector is None:
        p = prepare(train, features or [], F.col(label))
        known, train = p.transform(known), p.transform(train)
    else:
        known, train = (x.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))) for x in (known, train))
    n = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    model = LogisticRegression(labelCol=label, weightCol="_w", regParam=1.0 / (c * max(n["n"], 1)), maxIter=100).fit(
        train.withColumn("_w", balance_weight(F.col(label), n["p"] or 0.0, n["n"])))
    margin = model.transform(known).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")
    second = VectorAssembler(inputCols=["_margin"], outputCol="features").transform(margin)
    platt = LogisticRegression(labelCol=label, regParam=1e-6, maxIter=100).fit(second.filter(F.col(part) == "calibration"))
    return platt.transform(second).withColumn("_p", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", "_margin").withColumnRenamed("_p", "probability")


def boosted_direction(rows: DataFrame, *, features: list[str], label: str, part: str) -> DataFrame:
    """Gradient-boosted direction fitted on train; adds ``probability``."""
    known = rows.filter(F.col(label).isNotNull())
    p = prepare(known.filter(F.col(part) == "train"), features, F.col(label))
    d = p.transform(known)
    model = GBTClassifier(labelCol=label, featuresCol="features", **TREES).fit(d.filter(F.col(part) == "train"))
    return model.transform(d).withColumn("_p", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", "probability")


def state_model(rows: DataFrame, *, features: list[str], state: str, part: str) -> DataFrame:
    """Four joint outcomes from a forest, recalibrated by a multinomial logistic on the
    calibration period; adds ``prob_<state>``."""
    names = list(risk.STATE_ORDER)
    label = F.array_position(F.array(*[F.lit(s) for s in names]), F.col(state)).cast("double") - 1
    known = rows.filter(F.col(state).isNotNull()).withColumn("_label", label)
    p = prepare(known.filter(F.col(part) == "train"), features, F.col("_label"))
    d = p.transform(known)
    forest = RandomForestClassifier(labelCol="_label", featuresCol="features", numTrees=20, maxDepth=5, seed=42).fit(d.filter(F.col(part) == "train"))
    raw = forest.transform(d).drop("features", "rawPrediction", "prediction").withColumnRenamed("probability", "features")
    cal = LogisticRegression(labelCol="_label", family="multinomial", regParam=1e-3, maxIter=100).fit(raw.filter(F.col(part) == "calibration"))
    done = cal.transform(raw).withColumn("_p", vector_to_array("probability"))
    return done.select(*rows.columns, *[F.try_element_at("_p", F.lit(i + 1)).alias(f"prob_{s}") for i, s in enumerate(names)])


def benchmark_dimensions(rows: DataFrame, *, blocks: list[str], label: str, part: str, dimensions: tuple[int, ...]) -> DataFrame:
    """Validation Brier score per vector size; the smallest (score, size) is chosen and
    compared with the same size without news."""
    def score(size: int, variant: str) -> DataFrame:
        d = vectors.ablate(rows, dimensions=size, variants={variant: vectors.ABLATIONS[variant]})
        d = calibrated_logistic(d, features=None, label=label, part=part, vector="vector")
        y = F.col(label).cast("double")
        return d.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("probability") - y) ** 2).alias("brier")).select(
            F.lit(size).alias("dimensions"), F.lit(variant).alias("variant"), F.col(part).alias("part"), "n", "brier")
    tried = cut(reduce(DataFrame.unionByName, [score(size, "all_layers") for size in dimensions]))
    best = tried.filter(F.col("part") == "validation").orderBy("brier", "dimensions").first()["dimensions"]
    return tried.unionByName(score(best, "without_news")).withColumn("chosen", F.col("dimensions") == best)


MATRIX_C, MATRIX_ALPHA = 0.3, 10.0


def dimension_matrix(rows: DataFrame, *, vector: str, target: str, order: list[str], bucket: str, sizes: tuple[int, ...], binary: bool) -> DataFrame:
    """Walk-forward scores by rows for the first ``size`` coordinates of a vector, per size and fold.

    Balanced logistic for a target of 0 and 1, ridge otherwise; folds are cut once for all sizes.
    """
    known = rows.filter(F.col(target).isNotNull() & F.col(vector).isNotNull())
    folds = cut(splits.row_walk_forward(known, order=order, bucket=bucket).select("fold", "role", F.col(target).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("v")))
    counts = {(r["fold"], r["role"]): (r["n"], r["p"], r["s"]) for r in folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.stddev_pop("y").alias("s")).collect()}
    out = []
    for size in sizes:
        d = folds.withColumn("features", array_to_vector(F.slice("v", 1, size)))
        for k in sorted({k for k, _ in counts}):
            train, test = (d.filter((F.col("fold") == k) & (F.col("role") == role)) for role in ("train", "test"))
            n, positives, spread = counts[k, "train"]
            if binary:
                model = LogisticRegression(labelCol="y", weightCol="_w", regParam=1.0 / (MATRIX_C * n), maxIter=100).fit(train.withColumn("_w", balance_weight(F.col("y"), positives or 0.0, n)))
                scored = model.transform(test).withColumn("p", vector_to_array("probability")[1])
            else:
                scored = LinearRegression(labelCol="y", predictionCol="p", elasticNetParam=0.0, regParam=MATRIX_ALPHA / n * max(spread or 0.0, 1e-12), solver="normal").fit(train).transform(test)
            out.append(scored.select(F.lit(size).alias("dimensions"), "fold", F.lit(n).cast("long").alias("n_train"), "y", "p"))
    return metrics.fold_scores(cut(reduce(DataFrame.unionByName, out)), keys=["dimensions", "fold", "n_train"], actual="y", predicted="p", binary=binary)
