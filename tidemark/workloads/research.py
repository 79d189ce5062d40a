"""Queries that fit models: walk-forward, calibration, trees, suites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import metrics, research, risk, splits
from tidemark.session import cut
from tidemark.workloads.adapters import SESSIONS, r, rounded, sessions
from tidemark.workloads.metrics import _FOLDS, ECON, sql_economics
from tidemark.workloads.registry import workload

FEATURES = ["f_discount", "f_tax", "f_quantity", "f_count", "past_return"]
PARTS = {"train": 0.55, "validation": 0.15, "calibration": 0.15, "test": 0.15}


def _rows(t):
    """sessions with a target, its end date and a cost."""
    d = sessions(t).filter(F.col("future_return").isNotNull())
    w = Window.partitionBy("ticker").orderBy("day")
    d = d.withColumn("label_end", F.coalesce(F.lead("day").over(w), F.date_add("day", 1)))
    return d.withColumns({"ret": F.col("future_return") / 20, "up": (F.col("future_return") > 0).cast("double"), "cost": 0.002 + F.col("f_tax") / 50,
                          "month": F.date_trunc("month", "day")}).drop("future_return")


def _parts(t):
    return cut(splits.time_partitions(_rows(t), day="day", shares=PARTS, purge=5).filter(F.col("part") != "purged"))


@workload("ridge_walk_forward")
def ridge_walk_forward(t):
    """Out-of-fold ridge errors per fold."""
    folds = cut(splits.walk_forward_folds(_rows(t), day="day"))
    d = research.trade(research.ridge_walk_forward(folds, features=FEATURES, target="ret"), target="ret", cost="cost")
    out = metrics.predictive_metrics(d, keys=["fold"])
    return out.select("fold", "n", *rounded(out, ["mae", "rmse", "direction_accuracy", "brier", "calibration_gap"]))


@workload("logistic_calibrated")
def logistic_calibrated(t):
    """Calibrated direction probabilities: scores per period."""
    d = research.calibrated_logistic(_parts(t), features=FEATURES, label="up", part="part")
    out = metrics.model_scores(d.withColumn("mid", F.col("probability") - 0.5), keys=["part"], actual="ret", expected="mid", probability="probability")
    return out.select("part", "n", *rounded(out, ["brier", "accuracy", "auc"]))


@workload("gbt_direction")
def gbt_direction(t):
    """Boosted direction probabilities: scores per period."""
    d = research.boosted_direction(_parts(t), features=FEATURES, label="up", part="part")
    out = metrics.model_scores(d.withColumn("mid", F.col("probability") - 0.5), keys=["part"], actual="ret", expected="mid", probability="probability")
    return out.select("part", "n", *rounded(out, ["brier", "accuracy", "auc"]))


@workload("state_model")
def state_model(t):
    """Joint call/put outcome probabilities: multiclass scores per period."""
    from tidemark.operators.relationships import joint_state
    d = _parts(t).withColumn("state", joint_state(F.col("ret") + (F.col("f_discount") - 0.05), -F.col("ret") + (F.col("f_tax") - 0.04)))
    d = research.state_model(d, features=FEATURES, state="state", part="part")
    out = metrics.multiclass_scores(d, keys=["part"], truth="state", probabilities={s: f"prob_{s}" for s in risk.STATE_ORDER})
    return out.select("part", *rounded(out, ["multiclass_brier", "log_loss"]))


@workload("dim_benchmark")
def dim_benchmark(t):
    """Validation score per vector size, the choice, and the gain from news."""
    f = lambda *names: F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    d = _parts(t).withColumns({"news_raw": f("f_discount", "f_tax"), "events_raw": f("f_count"), "options_raw": f("f_quantity", "past_return"),
                               "stock_raw": f("past_return", "px"), "expectation_raw": f("f_tax"), "earnings_raw": f("f_discount"),
                               "quality_raw": F.array(*[F.lit(1.0)] * 8)})
    out = research.benchmark_dimensions(d, blocks=[], label="up", part="part", dimensions=(32, 64))
    return out.select("dimensions", "variant", "part", "n", "chosen", r("brier").alias("brier"))


_SETTINGS = {"cost": "cost", "day": "day", "label_end": "label_end", "order": ["day", "ticker"], "bucket": "month"}


@workload("alpha_evaluate")
def alpha_evaluate(t):
    """One audited candidate: walk-forward and holdout metrics after costs."""
    rows = cut(_rows(t).withColumns({"known": F.col("day"), "estimated": F.col("f_tax") > 0.06}))
    out, _ = research.evaluate(rows, research.Candidate("all_features", tuple(FEATURES)), target="ret", open_holdout=True, available=("known",), provisional="estimated", **_SETTINGS)
    return out.select("candidate", "model", "part", "observations", "number_of_trades", "profitable_periods", "costs_provisional", "leakage_valid", *rounded(out, [
        "expected_value_per_trade", "ev_net", "sharpe", "maximum_drawdown", "net_return", "mae", "rmse", "brier"]))


_BASELINE = SESSIONS + f""",
rw as (select ticker, day, future_return / 20 as ret, f_tax / 50 - 0.011::double as cost from sessions where future_return is not null),
c0 as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from rw)),
research as (select rw.* from rw join c0 using (day) where i < n - greatest(20, ceil(n * 0.15)) - 5),
cal as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from research)), {_FOLDS},
j as (select research.*, fold, role from research join roles using (day)),
tr as (select fold, avg(ret) as mean, coalesce(stddev_samp(ret), 0) as sigma from j where role = 'train' group by fold),
made as (select ticker, day, ret as actual_return, mean as expected_return, cost, mean > cost + 0.005::double + sigma * 0.25::double as trade from j join tr using (fold) where role = 'test'),
keyed as (select 'ticker=' || ticker as slice, * from made union all select 'month=' || strftime(day, '%Y-%m'), * from made)
"""


@workload("alpha_breakdowns", sql=f"with {_BASELINE}, {sql_economics('keyed', 'slice')}")
def alpha_breakdowns(t):
    """The audited baseline's walk-forward trades by ticker and month: economic metrics per value."""
    rows = cut(_rows(t).withColumns({"cheap": F.col("f_tax") / 50 - 0.011, "known": F.col("day")}))
    _, made = research.evaluate(rows, research.Candidate("historical_mean", (), "historical_mean"), target="ret", available=("known",), **{**_SETTINGS, "cost": "cheap"})
    d = research.breakdowns(made.withColumn("month_text", F.date_format("month", "yyyy-MM")), {"ticker": "ticker", "month": "month_text"}, order=["day", "ticker"], bucket="month")
    return d.select(F.concat_ws("=", "dim", "value").alias("slice"), "observations", "number_of_trades", *rounded(d, ECON))


@workload("alpha_suite")
def alpha_suite(t):
    """Baseline and candidates, chosen on walk-forward only, tested once on the holdout."""
    sets = [research.Candidate("price_only", ("past_return",)), research.Candidate("all_features", tuple(FEATURES))]
    settings = {k: v for k, v in _SETTINGS.items() if k != "day"}
    out = research.suite(cut(_rows(t)), sets, targets=["ret"], ticker="ticker", day="day", config=splits.WalkForward(n_splits=3), **settings)
    return out.select("candidate", "model", "target", "part", "number_of_trades", "selected_before_holdout", "stable", "pairs", *rounded(out, [
        "expected_value_per_trade", "sharpe", "maximum_drawdown", "mae", "t_statistic", "p", "q"]))
