"""Economic and predictive metrics, evidence bins, model scores, drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import average_rank, exact_quantiles, null_safe_join, value_ranks
from tidemark.schema import clip, ratio

# Annualisation, the loss floor of a curve, drift bins and guards.
SESSIONS_PER_YEAR = 252
CURVE_FLOOR = -0.999
PEAK_FLOOR = 1e-12
PSI_BINS = 10
PSI_MIN_REFERENCE, PSI_MIN_CURRENT = 30, 20
PSI_SHARE_FLOOR = 1e-6
WILSON_Z = 1.96
EVIDENCE_BIN_WIDTH = 0.1


def wilson(hits: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Closed-form interval of a share; null for an empty group."""
    p = ratio(hits.cast("double"), n.cast("double"))
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / den
    return clip(centre - half, low=0.0), clip(centre + half, high=1.0)


def equity_curve(rows: DataFrame, *, keys: list[str], order: list[str], bucket: str, net: str) -> DataFrame:
    """Compounded curve, its running peak and the drawdown per row.

    The product is a sum of logarithms.  Each bucket of time is run on its own and
    a small table of bucket totals and tops carries both running values across
    bucket borders, so one long curve is not one task.
    """
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_c", F.sum(F.log1p(clip(F.col(net), low=CURVE_FLOOR))).over(within))
    d = d.withColumn("_m", F.max("_c").over(within))
    ends = d.groupBy(*keys, bucket).agg(F.max_by("_c", F.struct(*order)).alias("_total"), F.max("_c").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    ends = ends.withColumn("_before", F.max(F.col("_start") + F.col("_top")).over(earlier))
    d = null_safe_join(d, ends.drop("_total", "_top"), [*keys, bucket])
    d = d.withColumns({"curve": F.exp(F.col("_start") + F.col("_c")),
                       "peak": F.exp(F.greatest("_before", F.col("_start") + F.col("_m")))})
    return d.withColumn("drawdown", (F.col("peak") - F.col("curve")) / F.greatest(F.col("peak"), F.lit(PEAK_FLOOR))) \
            .drop("_c", "_m", "_start", "_before")


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(math.inf))


def economic_metrics(rows: DataFrame, *, keys: list[str], order: list[str], bucket: str, actual: str = "actual_return",
                     expected: str = "expected_return", cost: str = "cost", take: str = "trade") -> DataFrame:
    """Per group: trades, expected values before and after cost, risk ratios, curve."""
    d = rows.filter(finite(F.col(actual)) & finite(F.col(expected)) & finite(F.col(cost)))
    on = F.coalesce(F.col(take), F.lit(False))
    d = d.withColumn("_net", F.when(on, F.col(actual) - F.col(cost))).withColumn("_gross", F.when(on, F.col(actual)))
    net, gross = F.col("_net"), F.col("_gross")
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.count(net).alias("number_of_trades"),
        F.avg(on.cast("double")).alias("trade_rate"),
        F.avg(net).alias("_mean"), F.stddev_samp(net).alias("_std"),
        F.stddev_samp(F.when(net < 0, net)).alias("_down"),
        F.count(F.when(net > 0, net)).alias("_wins"), F.avg(F.when(net > 0, net)).alias("_avg_win"),
        F.avg(F.when(net <= 0, net)).alias("_avg_loss"),
        F.sum(F.when(net > 0, net)).alias("_sum_win"), F.sum(F.when(net <= 0, net)).alias("_sum_loss"),
        F.count(F.when(gross > 0, gross)).alias("_gwins"), F.avg(F.when(gross > 0, gross)).alias("_g_win"),
        F.avg(F.when(gross <= 0, gross)).alias("_g_loss"), F.avg(gross).alias("_gmean"),
        F.avg(F.when(on, F.col(cost))).alias("_cost"), F.avg(F.when(on, F.col(expected))).alias("_expected"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.col("number_of_trades")
    p_win, g_win = zero(ratio(F.col("_wins"), n)), zero(ratio(F.col("_gwins"), n))
    loss = zero(F.abs(F.col("_avg_loss")))
    out = base.select(
        *keys, "observations", "number_of_trades", "trade_rate",
        zero(F.col("_mean")).alias("expected_value_per_trade"),
        (p_win * zero(F.col("_avg_win")) - (1 - p_win) * loss).alias("ev_formula"),
        (g_win * zero(F.col("_g_win")) - (1 - g_win) * zero(F.abs(F.col("_g_loss"))) - zero(F.col("_cost"))).alias("ev_net"),
        zero(F.col("_gmean")).alias("gross_expected_value"), zero(F.col("_cost")).alias("average_cost_return"),
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * math.sqrt(SESSIONS_PER_YEAR)).alias("sharpe"),
        F.when(F.col("_down") > 0, F.col("_mean") / F.col("_down") * math.sqrt(SESSIONS_PER_YEAR)).alias("sortino"),
        F.when(F.abs("_sum_loss") > 0, zero(F.col("_sum_win")) / F.abs("_sum_loss")).alias("profit_factor"),
        p_win.alias("win_rate"), zero(F.col("_avg_win")).alias("average_win"), (-loss).alias("average_loss"),
        F.when(loss > 0, zero(F.col("_avg_win")) / loss).alias("payoff_ratio"),
        zero(F.col("_expected")).alias("mean_expected_return"))
    curve = equity_curve(d.filter(on).select(*keys, *order, bucket, "_net"), keys=keys, order=order, bucket=bucket, net="_net")
    worst = curve.groupBy(*keys).agg(
        F.max("drawdown").alias("_dd"), F.max_by("curve", F.struct(bucket, *order)).alias("_end"))
    joined = out.join(worst, keys, "left") if keys else out.join(worst, how="left", on=F.lit(True))
    return joined.withColumns({"maximum_drawdown": zero(F.col("_dd")), "net_return": zero(F.col("_end") - 1)}).drop("_dd", "_end")


def predictive_metrics(rows: DataFrame, *, keys: list[str], actual: str = "actual_return",
                       expected: str = "expected_return", probability: str = "probability") -> DataFrame:
    d = rows.filter(F.col(actual).isNotNull() & F.col(expected).isNotNull())
    err = F.col(actual) - F.col(expected)
    p, y = clip(F.col(probability), 0.0, 1.0), (F.col(actual) > 0).cast("double")
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(((F.col(expected) > 0) == (F.col(actual) > 0)).cast("double")).alias("direction_accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.abs(F.avg(p) - F.avg(y)).alias("calibration_gap"))


def breakdown_rows(rows: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """One copy of every row per dimension, as (dim, value)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dim"), F.col(c).cast("string").alias("value"))
                      for name, c in dimensions.items()])
    return rows.select("*", F.inline(pairs))


def evidence_bins(rows: DataFrame, *, keys: list[str], probability: str, hit: str, realised: str,
                  width: float = EVIDENCE_BIN_WIDTH) -> DataFrame:
    """Hit rate and returns per probability bin, the last bin closed.  The bin edges
    are compared as they are in floating point."""
    edges = [i * width for i in range(int(round(1 / width)) + 1)]
    last = len(edges) - 2
    p = F.col(probability)
    found = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= p)) - 1
    d = rows.filter(p.isNotNull() & (p >= 0) & (p <= edges[-1] + 1e-12)).withColumn("bin", F.least(found, F.lit(last)))
    value = F.col(realised)
    g = d.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted_probability"),
        F.sum(F.col(hit).cast("long")).alias("hits"), F.avg(value).alias("mean_realized_return"),
        F.avg(F.when(value > 0, value)).alias("mean_positive_return"),
        F.avg(F.when(value <= 0, value)).alias("mean_nonpositive_return"))
    low, high = wilson(F.col("hits"), F.col("n"))
    at = F.array(*[F.lit(e) for e in edges])
    return g.withColumns({
        "bin_low": F.element_at(at, F.col("bin") + 1), "bin_high": F.element_at(at, F.col("bin") + 2),
        "observed_positive_rate": F.col("hits") / F.col("n"), "ci95_low": low, "ci95_high": high})


def lookup_evidence(rows: DataFrame, bins: DataFrame, *, probability: str, take: list[str]) -> DataFrame:
    """Bin that holds each probability, else the bin whose mean is nearest.  There are
    at most ten bins, so they travel as one array value."""
    fields = ["bin_low", "bin_high", "mean_predicted_probability", *take]
    table = bins.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("b")).scalar()
    d = rows.withColumn("_bins", table)
    return d.withColumn("_bin", bin_of(F.col(probability), F.col("_bins"))).select(*rows.columns, *[F.col(f"_bin.{c}").alias(f"evidence_{c}") for c in ["bin_low", *take]])


def bin_of(p: Column, bins: Column) -> Column:
    """Of an array of bins the one that holds ``p``, else the one whose mean is nearest; null without bins."""
    inside = F.filter(bins, lambda b: (p >= b["bin_low"]) & ((p < b["bin_high"]) | ((b["bin_high"] >= 0.999999) & (p <= 1.0))))
    nearest = F.array_min(F.transform(bins, lambda b: F.struct(
        F.abs(b["mean_predicted_probability"] - p).alias("distance"), b.alias("bin"))))["bin"]
    return F.when(F.size(inside) > 0, F.try_element_at(inside, F.lit(1))).otherwise(nearest)


def area_under_curve(rows: DataFrame, *, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Exact ROC area by average ranks over distinct scores."""
    ranked = value_ranks(rows, keys=keys, value=score, sums={"_pos": F.sum(positive.cast("long"))})
    g = ranked.groupBy(*keys).agg(F.sum(F.col("_pos") * average_rank()).alias("_r"), F.sum("_pos").alias("_p"),
                                  F.max("total").alias("_n"))
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    return g.select(*keys, ratio(F.col("_r") - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def model_scores(rows: DataFrame, *, keys: list[str], actual: str, expected: str, probability: str) -> DataFrame:
    y, m, p = F.col(actual), F.col(expected), F.col(probability)
    up = (y > 0).cast("double")
    d = rows.filter(y.isNotNull() & m.isNotNull() & p.isNotNull())
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - m)).alias("mae"), F.sqrt(F.avg((y - m) * (y - m))).alias("rmse"),
        (1 - ratio(F.sum((y - m) * (y - m)), F.var_pop(y) * F.count(y))).alias("r2"), F.corr(y, m).alias("corr"),
        F.avg(((y > 0) == (m > 0)).cast("double")).alias("direction_accuracy"),
        F.avg((p - up) * (p - up)).alias("brier"), F.avg(((p >= 0.5).cast("double") == up).cast("double")).alias("accuracy"))
    return g.join(area_under_curve(d, keys=keys, score=probability, positive=y > 0), keys)


def fold_scores(rows: DataFrame, *, keys: list[str], actual: str, predicted: str, binary: bool) -> DataFrame:
    """Scores of test rows: Brier, area, accuracy and mean recall of a probability of 1, or absolute and squared errors of a number."""
    y, p = F.col(actual).cast("double"), F.col(predicted)
    d = rows.filter(y.isNotNull() & p.isNotNull())
    if not binary:
        return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"))
    hit = ((p >= 0.5) == (y > 0)).cast("double")
    recalls = [F.avg(F.when(y > 0, hit)), F.avg(F.when(y <= 0, hit))]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(hit).alias("accuracy"),
                             ((F.coalesce(recalls[0], recalls[1]) + F.coalesce(recalls[1], recalls[0])) / 2).alias("balanced_accuracy"))
    return g.join(area_under_curve(d, keys=keys, score=predicted, positive=y > 0), keys)


def multiclass_scores(rows: DataFrame, *, keys: list[str], truth: str, probabilities: dict[str, str]) -> DataFrame:
    """Brier and log loss of a class table (class name -> probability column)."""
    brier = sum(((F.col(c) - (F.col(truth) == k).cast("double")) ** 2 for k, c in probabilities.items()), F.lit(0.0))
    chosen = F.coalesce(*[F.when(F.col(truth) == k, F.col(c)) for k, c in probabilities.items()])
    return rows.groupBy(*keys).agg(
        F.avg(brier).alias("multiclass_brier"), (-F.avg(F.ln(clip(chosen, 1e-12, 1.0)))).alias("log_loss"))


def paired_test(candidate: DataFrame, baseline: DataFrame, *, on: list[str], value: str, keys: list[str]) -> DataFrame:
    """Paired difference per group: count, mean and t."""
    both = candidate.select(*dict.fromkeys([*keys, *on]), F.col(value).alias("_c")).join(
        baseline.select(*on, F.col(value).alias("_b")), on)
    d = F.col("_c") - F.col("_b")
    g = both.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"))
    return g.select(*keys, "n", "mean_difference",
                    F.when(F.col("n") >= 10, ratio(F.col("mean_difference"), F.col("_s") / F.sqrt("n"))).alias("t_statistic"))


def benjamini_hochberg(hypotheses: DataFrame, *, keys: list[str], p: str, out: str = "q",
                       null_policy: str = "keep") -> DataFrame:
    """False-discovery-rate values per family.  A family is one set of tested
    hypotheses (features x horizons, capped by the feature limit), not data rows.
    ``null_policy``: "keep" leaves a missing p missing, "one" counts it as 1."""
    d = hypotheses.withColumn("_p", F.coalesce(p, F.lit(1.0)) if null_policy == "one" else F.col(p))
    w = Window.partitionBy(*keys, F.col("_p").isNull())
    d = d.withColumn("_rank", F.rank().over(w.orderBy("_p")) + F.count(F.lit(1)).over(Window.partitionBy(*keys, "_p")) - 1)
    d = d.withColumn("_raw", F.col("_p") * F.count("_p").over(w) / F.col("_rank"))
    following = w.orderBy(F.col("_p").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(following)))) \
            .drop("_p", "_rank", "_raw")


def stability_index(rows: DataFrame, *, keys: list[str], value: str, is_reference: str, bins: int = PSI_BINS) -> DataFrame:
    """Population stability of current against reference values per key.

    Decile edges of the reference come from distributed exact quantiles; the
    histogram is an ordinary aggregate.
    """
    d = rows.filter(finite(F.col(value)))
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(d.filter(F.col(is_reference)), keys=keys, value=value, probabilities=names)
    edges = q.select(*keys, F.array_distinct(F.array(*names)).alias("_edges"))
    inner = edges.select(*keys, F.when(F.size("_edges") >= 3, F.slice("_edges", 2, F.size("_edges") - 2)).otherwise(
        F.array().cast("array<double>")).alias("_inner"))
    located = d.join(inner, keys).withColumn("_bin", F.size(F.filter("_inner", lambda e: e <= F.col(value))))
    hist = located.groupBy(*keys, "_bin").agg(
        F.sum(F.col(is_reference).cast("long")).alias("_r"), F.sum((~F.col(is_reference)).cast("long")).alias("_c"))
    grid = inner.select(*keys, F.size("_inner").alias("_last"), F.explode(F.sequence(F.lit(0), F.size("_inner"))).alias("_bin"))
    full = grid.join(hist, [*keys, "_bin"], "left").fillna(0, ["_r", "_c"])
    total = full.groupBy(*keys).agg(F.sum("_r").alias("_rn"), F.sum("_c").alias("_cn"))
    share = lambda x, n: F.greatest(F.col(x) / F.col(n), F.lit(PSI_SHARE_FLOOR))
    term = (share("_c", "_cn") - share("_r", "_rn")) * F.ln(share("_c", "_cn") / share("_r", "_rn"))
    enough = (F.col("_rn") >= PSI_MIN_REFERENCE) & (F.col("_cn") >= PSI_MIN_CURRENT)
    return full.join(total, keys).groupBy(*keys).agg(
        F.max("_rn").alias("reference_n"), F.max("_cn").alias("current_n"), F.max("_last").alias("_last"),
        F.sum(F.when(enough, term)).alias("_psi")).select(
        *keys, "reference_n", "current_n",
        F.when(F.col("_psi").isNotNull() & (F.col("_last") == 0), F.lit(0.0)).otherwise(F.col("_psi")).alias("psi"))
