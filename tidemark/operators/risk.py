"""Costs, trade decisions, risk limits, paper settlements and monitoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import equity_curve
from tidemark.operators.ordered import exact_quantiles, null_safe_join
from tidemark.schema import clip, ratio, truth


@dataclass(frozen=True)
class CostModel:
    """Fees per contract side, basis points per side, fall-backs."""
    commission_per_contract_side: float = 0.65
    regulatory_fee_per_contract_side: float = 0.03
    slippage_bps_per_side: float = 5.0
    market_impact_bps_per_side: float = 2.0
    adverse_fill_bps_per_side: float = 2.0
    fallback_roundtrip_spread_pct: float = 0.08
    missing_fee_return: float = 0.02
    minimum_tick: float = 0.01
    contract_multiplier: int = 100
    safety_margin_return: float = 0.005
    uncertainty_share: float = 0.25


@dataclass(frozen=True)
class RiskPolicy:
    """Portfolio and liquidity limits."""
    max_portfolio_exposure_pct: float = 0.30
    max_ticker_exposure_pct: float = 0.07
    max_sector_exposure_pct: float = 0.18
    risk_per_trade_pct: float = 0.005
    max_daily_loss_pct: float = 0.02
    max_drawdown_pct: float = 0.12
    max_relative_spread: float = 0.12
    min_open_interest: int = 50
    min_daily_contract_volume: int = 20
    max_model_uncertainty: float = 0.35
    max_pairwise_correlation: float = 0.85
    stale_data_minutes: float = 20.0
    safety_margin_return: float = 0.005
    uncertainty_share: float = 0.25


def _optional(frame: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in frame.columns else F.lit(None).cast("double")


def roundtrip_costs(frame: DataFrame, side: str, model: CostModel = CostModel()) -> DataFrame:
    """Spread, fees and slippage as a return, and whether the claim is provisional."""
    price_name = f"{side}_close_option" if f"{side}_close_option" in frame.columns else f"{side}_extrinsic"
    price = F.nullif(F.abs(_optional(frame, price_name)), F.lit(0.0))
    bid, ask = _optional(frame, f"{side}_bid"), _optional(frame, f"{side}_ask")
    later_bid, later_ask = _optional(frame, f"future_{side}_bid"), _optional(frame, f"future_{side}_ask")
    quoted = truth(bid.isNotNull() & ask.isNotNull() & (ask >= bid) & (price > 0))
    exit_quoted = truth(later_bid.isNotNull() & later_ask.isNotNull() & (later_ask >= later_bid))
    depth = _optional(frame, f"{side}_bid_size").isNotNull() & _optional(frame, f"{side}_ask_size").isNotNull()
    spread = F.when(quoted, clip(ask - bid, low=model.minimum_tick) / price).otherwise(
        F.lit(model.fallback_roundtrip_spread_pct))
    fees = 2 * (model.commission_per_contract_side + model.regulatory_fee_per_contract_side)
    fee = F.coalesce(F.lit(fees) / (price * model.contract_multiplier), F.lit(model.missing_fee_return))
    slip = 2 * (model.slippage_bps_per_side + model.market_impact_bps_per_side + model.adverse_fill_bps_per_side) / 10_000
    return frame.withColumns({
        "expected_cost_return": clip(spread + fee + F.lit(slip), low=0.0),
        "costs_provisional": ~(quoted & exit_quoted & depth),
    })


def decide(frame: DataFrame, *, predicted: str, cost: str, uncertainty: str, actual: str | None = None,
           model: CostModel = CostModel()) -> DataFrame:
    """TRADE where the forecast clears cost, margin and a share of its uncertainty."""
    go = truth(F.col(predicted) > F.col(cost) + model.safety_margin_return + F.col(uncertainty) * model.uncertainty_share)
    out = {"net_expected_edge": F.col(predicted) - F.col(cost), "trade": go,
           "decision": F.when(go, "TRADE").otherwise("NO_TRADE")}
    if actual:
        out["actual_net_return"] = F.when(go, F.col(actual) - F.col(cost)).otherwise(F.lit(0.0))
    return frame.withColumns(out)


def _num(name: str, default: float = 0.0) -> Column:
    c = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(default))


def evaluate_risk(candidates: DataFrame, policy: RiskPolicy = RiskPolicy()) -> DataFrame:
    """Decision, position size and sorted reason codes per candidate.

    Candidate and portfolio columns sit in the same row.  Any reason blocks the
    trade; the first eight are kill switches.
    """
    equity = F.col("equity")
    edge = _num("expected_return") - F.greatest(F.lit(0.0), _num("expected_cost_return"))
    required = F.lit(policy.safety_margin_return) + F.greatest(F.lit(0.0), _num("uncertainty")) * policy.uncertainty_share
    # Reason codes.
    kill = [
        ("systeemfout", ~F.col("system_healthy")), ("onvolledige_features", ~F.col("feature_complete")),
        ("leakage_audit_mislukt", ~F.col("leakage_valid")), ("model_ongeldig", ~F.col("model_valid")),
        ("model_of_feature_drift", F.col("drift_alert")),
        ("maximaal_dagverlies", _num("daily_pnl") <= -F.abs(_num("equity")) * policy.max_daily_loss_pct),
        ("maximale_drawdown", _num("drawdown_pct") >= policy.max_drawdown_pct),
        ("verouderde_data", _num("data_age_minutes") > policy.stale_data_minutes),
    ]
    soft = [
        ("spread_onbekend", F.col("relative_spread").isNull()),
        ("spread_te_hoog", F.col("relative_spread") > policy.max_relative_spread),
        ("onvoldoende_open_interest", F.col("open_interest").isNull() | (F.col("open_interest") < policy.min_open_interest)),
        ("onvoldoende_liquiditeit", F.col("daily_volume").isNull() | (F.col("daily_volume") < policy.min_daily_contract_volume)),
        ("modelonzekerheid_te_hoog", F.col("uncertainty").isNull() | (F.col("uncertainty") > policy.max_model_uncertainty)),
        ("edge_niet_boven_kosten_en_marge", edge <= required),
        ("ongeldig_portfoliovermogen", equity <= 0),
        ("maximale_portefeuille_exposure", F.col("gross_exposure") >= equity * policy.max_portfolio_exposure_pct),
        ("tickerconcentratie", F.col("ticker_exposure") >= equity * policy.max_ticker_exposure_pct),
        ("sectorconcentratie", F.col("sector_exposure") >= equity * policy.max_sector_exposure_pct),
        ("correlatieconcentratie", F.col("correlated_exposure_pct") >= policy.max_pairwise_correlation),
    ]
    named = lambda rules: F.array_compact(F.array(*[F.when(truth(c), F.lit(n)) for n, c in rules]))
    d = candidates.withColumns({
        "expected_edge_return": edge, "required_edge_return": required,
        "_kill": named(kill), "_all": F.array_sort(F.array_distinct(named(kill + soft)))})
    room = F.least(equity * policy.max_portfolio_exposure_pct - F.col("gross_exposure"),
                   equity * policy.max_ticker_exposure_pct - F.col("ticker_exposure"),
                   equity * policy.max_sector_exposure_pct - F.col("sector_exposure"),
                   equity * policy.risk_per_trade_pct)
    notional = F.greatest(F.lit(0.01), _num("option_price", 0.01)) * F.greatest(F.lit(1), F.col("contract_multiplier"))
    fit = F.floor(F.greatest(F.lit(0.0), room) / notional).cast("long")
    clear = F.size("_all") == 0
    small = F.array(F.lit("positie_binnen_risicolimieten_te_klein"))
    return d.withColumns({
        "contracts": F.when(clear, fit).otherwise(F.lit(0).cast("long")),
        "allowed": clear & (fit >= 1), "kill_switch": F.size("_kill") > 0,
        "decision": F.when(clear & (fit >= 1), "TRADE").otherwise("NO_TRADE"),
        "reasons": F.when(clear & (fit < 1), small).otherwise(F.col("_all")),
    }).drop("_kill", "_all")


def paper_signals(decisions: DataFrame, *, key: list[str], created: Column) -> DataFrame:
    """Append-only signal rows: OPEN when allowed, else REJECTED.  The id is a content
    hash, so writing the same decision twice gives the same signal."""
    body = F.to_json(F.struct(*[F.col(c) for c in [*key, "decision", "contracts"]]))
    return decisions.withColumns({
        "signal_id": F.concat(F.lit("paper-"), F.date_format(created, "yyyyMMdd"), F.lit("-"), F.substring(F.sha2(body, 256), 1, 16)),
        "created_at": created, "mode": F.lit("paper"), "live_capital_used": F.lit(False),
        "execution_status": F.when(F.col("allowed"), "OPEN").otherwise("REJECTED"),
    })


def settle(signals: DataFrame, exits: DataFrame, *, on: list[str]) -> DataFrame:
    """Profit and return of open signals whose exit price is known and valid."""
    entry, leave, fee = F.col("option_price"), F.col("exit_price"), F.greatest(F.lit(0.0), F.col("actual_cost"))
    d = signals.filter(F.col("allowed") & (entry > 0)).join(exits.filter(F.col("exit_price") >= 0), on)
    size = F.col("contracts") * F.col("contract_multiplier")
    d = d.withColumns({
        "gross_pnl": (leave - entry) * size, "net_pnl": (leave - entry) * size - fee,
        "actual_cost_return": fee / F.greatest(entry * size, F.lit(1e-12))})
    return d.withColumns({
        "actual_net_return": (leave - entry) / entry - F.col("actual_cost_return"),
        "expected_net_return": F.col("expected_edge_return"), "positive_outcome": F.col("net_pnl") > 0})


def paper_status(settlements: DataFrame, *, keys: list[str]) -> DataFrame:
    pnl = F.col("net_pnl")
    return settlements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("settled_trades"), F.sum(pnl).alias("net_pnl"), F.avg(pnl).alias("expected_value_per_trade"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        ratio(F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.abs(F.sum(F.when(pnl <= 0, pnl)))).alias("profit_factor"),
        F.avg("actual_net_return").alias("mean_net_return"))


# Monitoring limits and trigger codes.
LIVE_MIN_TRADES, DRAWDOWN_LIMIT = 30, 0.12
CALIBRATION_MIN_ROWS, CALIBRATION_GAP = 50, 0.12
DRIFT_LIMIT = 0.25
COST_MIN_ROWS, COST_RATIO_LIMIT = 20, 1.5
SPREAD_MIN_ROWS, SPREAD_P95_LIMIT = 20, 0.15
OPEN_INTEREST_FLOOR = 30


def monitor(records: DataFrame, *, keys: list[str], order: list[str], bucket: str,
            drift: DataFrame | None = None) -> DataFrame:
    """Expected against realised results per key, with trigger codes and kill switch.

    ``drift`` may add a ``prediction_psi`` per key.
    """
    exp, act = F.col("expected_net_return"), F.col("actual_net_return")
    both = exp.isNotNull() & act.isNotNull()
    of = lambda c: F.when(both, c)
    p, y = clip(F.col("probability_positive"), 0.0, 1.0), F.col("positive_outcome").cast("double")
    judged = p.isNotNull() & y.isNotNull()
    quoted, paid = F.col("expected_cost_return"), F.col("actual_cost_return")
    priced = quoted.isNotNull() & paid.isNotNull()
    base = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(of(act)).alias("_trades"),
        F.avg(of(exp)).alias("expected_pnl_mean"), F.avg(of(act)).alias("actual_pnl_mean"),
        F.avg(of(act - exp)).alias("pnl_forecast_error_mean"), F.avg(of(F.abs(act - exp))).alias("pnl_forecast_mae"),
        F.stddev_samp(of(act)).alias("_sd"), F.avg(of(((exp > 0) == (act > 0)).cast("double"))).alias("direction_accuracy"),
        F.count(F.when(judged, p)).alias("_judged"), F.avg(F.when(judged, (p - y) * (p - y))).alias("brier"),
        F.abs(F.avg(F.when(judged, p)) - F.avg(F.when(judged, y))).alias("calibration_gap"),
        F.count(F.when(priced, paid)).alias("_priced"),
        (F.sum(F.when(priced, paid)) / F.greatest(F.abs(F.sum(F.when(priced, quoted))), F.lit(1e-12))).alias("execution_cost_ratio"),
        F.avg("relative_spread").alias("mean_relative_spread"), F.count("relative_spread").alias("_spreads"))
    curve = equity_curve(records.filter(both).select(*keys, *order, bucket, "actual_net_return"),
                         keys=keys, order=order, bucket=bucket, net="actual_net_return")
    measures = F.array(*[F.struct(F.lit(c).alias("_measure"), F.col(c).cast("double").alias("_value"))
                         for c in ("relative_spread", "open_interest")])
    marks = exact_quantiles(records.select(*keys, F.inline(measures)), keys=[*keys, "_measure"], value="_value",
                            probabilities={"p50": 0.5, "p95": 0.95})
    marks = marks.groupBy(*keys).agg(
        F.max(F.when(F.col("_measure") == "relative_spread", F.col("p95"))).alias("p95_relative_spread"),
        F.max(F.when(F.col("_measure") == "open_interest", F.col("p50"))).alias("median_open_interest"))
    parts = [base, curve.groupBy(*keys).agg(F.max("drawdown").alias("maximum_drawdown")), marks]
    if drift is not None:
        parts.append(drift)
    d = parts[0]
    for part in parts[1:]:
        d = d.join(part, keys, "left")
    if drift is None:
        d = d.withColumn("prediction_psi", F.lit(None).cast("double"))
    return _judged(d)


def _judged(d: DataFrame) -> DataFrame:
    """Sharpe ratio, triggers and kill switch of monitoring measures."""
    d = d.withColumn("actual_sharpe", F.when((F.col("_trades") > 2) & (F.col("_sd") > 0),
                                             F.col("actual_pnl_mean") / F.col("_sd") * F.sqrt(F.lit(252.0))))
    rules = [
        ("negatieve_live_ev", (F.col("_trades") >= LIVE_MIN_TRADES) & (F.col("actual_pnl_mean") < 0)),
        ("drawdown_limiet", F.col("maximum_drawdown") > DRAWDOWN_LIMIT),
        ("slechte_kalibratie", (F.col("_judged") >= CALIBRATION_MIN_ROWS) & (F.col("calibration_gap") > CALIBRATION_GAP)),
        ("prediction_drift", F.col("prediction_psi") > DRIFT_LIMIT),
        ("execution_kosten_afwijking", (F.col("_priced") >= COST_MIN_ROWS) & (F.col("execution_cost_ratio") > COST_RATIO_LIMIT)),
        ("uitzonderlijke_spreads", (F.col("_spreads") >= SPREAD_MIN_ROWS) & (F.col("p95_relative_spread") > SPREAD_P95_LIMIT)),
        ("liquiditeit_verslechterd", F.col("median_open_interest") < OPEN_INTEREST_FLOOR),
    ]
    d = d.withColumn("triggers", F.array_sort(F.array_compact(F.array(*[F.when(truth(c), F.lit(n)) for n, c in rules]))))
    return d.withColumn("kill_switch", F.size("triggers") > 0).drop("_trades", "_sd", "_judged", "_priced", "_spreads")


# ---------------------------------------------------------------- monitoring in parts
_SUMS = ("rows", "trades", "expected", "actual", "actual_squared", "absolute", "direction", "judged", "probability", "outcome", "brier", "priced", "paid", "quoted", "spreads", "spread")


def monitor_sums(records: DataFrame, *, keys: list[str], order: list[str], bucket: str) -> DataFrame:
    """What ``monitor`` needs of some records besides quantiles, so that parts add up.

    Sums and counts per key, and ``curve``: the logarithms of the part's last, highest and
    lowest compounded value and its own largest drawdown, None without any return.
    """
    exp, act = F.col("expected_net_return"), F.col("actual_net_return")
    both = exp.isNotNull() & act.isNotNull()
    p, y = clip(F.col("probability_positive"), 0.0, 1.0), F.col("positive_outcome").cast("double")
    judged = p.isNotNull() & y.isNotNull()
    quoted, paid, spread = F.col("expected_cost_return"), F.col("actual_cost_return"), F.col("relative_spread")
    priced = quoted.isNotNull() & paid.isNotNull()
    total = lambda where, what: F.coalesce(F.sum(F.when(where, what)), F.lit(0.0))
    sums = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(both).alias("trades"), total(both, exp).alias("expected"), total(both, act).alias("actual"),
        total(both, act * act).alias("actual_squared"), total(both, F.abs(act - exp)).alias("absolute"), total(both, ((exp > 0) == (act > 0)).cast("double")).alias("direction"),
        F.count_if(judged).alias("judged"), total(judged, p).alias("probability"), total(judged, y).alias("outcome"), total(judged, (p - y) * (p - y)).alias("brier"),
        F.count_if(priced).alias("priced"), total(priced, paid).alias("paid"), total(priced, quoted).alias("quoted"), F.count(spread).alias("spreads"), total(spread.isNotNull(), spread).alias("spread"))
    curve = equity_curve(records.filter(both).select(*keys, *order, bucket, "actual_net_return"), keys=keys, order=order, bucket=bucket, net="actual_net_return")
    ends = curve.groupBy(*keys).agg(F.struct(F.ln(F.max_by("curve", F.struct(*order))).alias("last"), F.ln(F.max("curve")).alias("top"), F.ln(F.min("curve")).alias("low"),
                                             F.max("drawdown").alias("drawdown")).alias("curve"))
    return null_safe_join(sums, ends, keys)


def monitor_values(records: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, measure, value, n): the values whose quantiles ``monitor`` reports, counted."""
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("relative_spread", "open_interest")])
    return records.select(*keys, F.inline(measures)).filter(F.col("value").isNotNull()).groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def add_monitor_sums(earlier: DataFrame, later: DataFrame, *, keys: list[str]) -> DataFrame:
    """Sums of the records of two parts, the second of which follows the first in time."""
    rows = earlier.withColumn("_late", F.lit(False)).unionByName(later.withColumn("_late", F.lit(True)))
    d = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], F.max(F.when(~F.col("_late"), F.col("curve"))).alias("_a"), F.max(F.when(F.col("_late"), F.col("curve"))).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    # The later part starts at a's last value; its lowest point may lie below a's peak by more than either part's own drawdown.
    across = F.lit(1.0) - F.exp(a["last"] + b["low"] - a["top"])
    joined = F.struct((a["last"] + b["last"]).alias("last"), F.greatest(a["top"], a["last"] + b["top"]).alias("top"), F.least(a["low"], a["last"] + b["low"]).alias("low"),
                      F.greatest(a["drawdown"], b["drawdown"], across).alias("drawdown"))
    return d.withColumn("curve", F.when(a.isNull(), b).when(b.isNull(), a).otherwise(joined)).drop("_a", "_b")


def monitor_from_sums(sums: DataFrame, values: DataFrame, *, keys: list[str]) -> DataFrame:
    """``monitor`` of all records that went into the sums and counted values."""
    mean = lambda top, n: F.when(F.col(n) > 0, F.col(top) / F.col(n))
    variance = (F.col("actual_squared") - F.col("actual") * F.col("actual") / F.col("trades")) / (F.col("trades") - 1)
    d = sums.select(
        *keys, "rows", F.col("trades").alias("_trades"), mean("expected", "trades").alias("expected_pnl_mean"), mean("actual", "trades").alias("actual_pnl_mean"),
        (mean("actual", "trades") - mean("expected", "trades")).alias("pnl_forecast_error_mean"), mean("absolute", "trades").alias("pnl_forecast_mae"),
        F.when(F.col("trades") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("_sd"), mean("direction", "trades").alias("direction_accuracy"), F.col("judged").alias("_judged"),
        mean("brier", "judged").alias("brier"), F.abs(mean("probability", "judged") - mean("outcome", "judged")).alias("calibration_gap"), F.col("priced").alias("_priced"),
        F.when(F.col("priced") > 0, F.col("paid") / F.greatest(F.abs("quoted"), F.lit(1e-12))).alias("execution_cost_ratio"), mean("spread", "spreads").alias("mean_relative_spread"),
        F.col("spreads").alias("_spreads"), F.col("curve.drawdown").alias("maximum_drawdown"), F.lit(None).cast("double").alias("prediction_psi"))
    marks = exact_quantiles(values, keys=[*keys, "measure"], value="value", probabilities={"p50": 0.5, "p95": 0.95}, weight="n").groupBy(*keys).agg(
        F.max(F.when(F.col("measure") == "relative_spread", F.col("p95"))).alias("p95_relative_spread"),
        F.max(F.when(F.col("measure") == "open_interest", F.col("p50"))).alias("median_open_interest"))
    return _judged(null_safe_join(d, marks, keys))


# Signal thresholds.
EVIDENCE_MIN, EVIDENCE_STRICT, EVEN_ODDS, EDGE_FLOOR = 50, 100, 0.50, 1e-9
STATE_ORDER = ("call_up_put_down", "call_down_put_up", "both_up", "both_down")


def edge_signals(frame: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Expected edges, best side, support flags, most likely state and signal.

    Needs ``{call,put}_extrinsic``, ``{call,put}_return``, ``prob_{call,put}_gross_profit``,
    ``prob_<state>`` and per side ``{call,put}_evidence_{n,hit_rate,ci_low}``.
    """
    out: dict[str, Column] = {}
    for side in ("call", "put"):
        now = F.col(f"{side}_extrinsic")
        out[f"model_expected_{side}_extrinsic"] = now * (1 + F.col(f"{side}_return"))
        out[f"{side}_gross_edge"] = now * (1 + F.col(f"{side}_return")) - now
        out[f"{side}_gross_edge_pct"] = F.when(F.abs(now) > EDGE_FLOOR, (now * (1 + F.col(f"{side}_return")) - now) / now)
    d = frame.withColumns(out)
    pc, pp = F.col("prob_call_gross_profit"), F.col("prob_put_gross_profit")
    call_best = pc >= pp
    pick = lambda name: F.when(call_best, F.col(f"call_{name}")).otherwise(F.col(f"put_{name}"))
    probs = F.array(*[F.col(f"prob_{s}") for s in STATE_ORDER])
    d = d.withColumns({
        "call_edge_per_contract": F.col("call_gross_edge") * 100.0, "put_edge_per_contract": F.col("put_gross_edge") * 100.0,
        "best_gross_profit_probability": F.greatest(pc, pp), "best_profit_side": F.when(call_best, "CALL").otherwise("PUT"),
        "prob_call_up": F.col("prob_call_up_put_down") + F.col("prob_both_up"),
        "prob_put_up": F.col("prob_call_down_put_up") + F.col("prob_both_up"),
        "most_likely_state_probability": F.array_max(probs),
        "most_likely_state": F.element_at(F.array(*[F.lit(s) for s in STATE_ORDER]),
                                          F.array_position(probs, F.array_max(probs)).cast("int")),
        "_edge": pick("gross_edge_pct"), "_n": pick("evidence_n"), "_hit": pick("evidence_hit_rate"), "_low": pick("evidence_ci_low"),
        "_cs": F.greatest(F.coalesce("call_gross_edge_pct", F.lit(-999.0)), F.lit(0.0)) * pc,
        "_ps": F.greatest(F.coalesce("put_gross_edge_pct", F.lit(-999.0)), F.lit(0.0)) * pp,
    })
    case = truth((F.col("best_gross_profit_probability") > EVEN_ODDS) & (F.col("_edge") > 0))
    call_go = truth((F.col("call_gross_edge_pct") > 0) & (pc >= threshold) & (F.col("_cs") >= F.col("_ps")))
    put_go = truth((F.col("put_gross_edge_pct") > 0) & (pp >= threshold) & (F.col("_ps") > F.col("_cs")))
    return d.withColumns({
        "paper_profit_case": case,
        "paper_profit_empirically_supported": case & truth((F.col("_n") >= EVIDENCE_MIN) & (F.col("_hit") > EVEN_ODDS)),
        "paper_profit_strict_ci_supported": case & truth((F.col("_n") >= EVIDENCE_STRICT) & (F.col("_low") > EVEN_ODDS)),
        "paper_signal": F.when(call_go, "CALL_EDGE").when(put_go, "PUT_EDGE").otherwise("NO_EDGE"),
        "paper_opportunity_score": F.when(call_go, F.col("_cs")).when(put_go, F.col("_ps")).otherwise(
            F.greatest("_cs", "_ps", F.lit(0.0))),
    }).drop("_edge", "_n", "_hit", "_low", "_cs", "_ps")
