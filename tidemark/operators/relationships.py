"""Condition flags, joint outcomes, pattern mining and pattern priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.metrics import wilson
from tidemark.operators.ordered import exact_quantiles
from tidemark.schema import ratio, truth

# Learned thresholds (name -> source column, quantile, absolute value?).
THRESHOLDS = {
    "call_gap_hi": ("call_expectation_gap", 0.80, False),
    "call_gap_lo": ("call_expectation_gap", 0.20, False),
    "put_gap_hi": ("put_expectation_gap", 0.80, False),
    "put_gap_lo": ("put_expectation_gap", 0.20, False),
    "pair_div_hi": ("call_put_return_divergence_5m", 0.80, False),
    "pair_div_lo": ("call_put_return_divergence_5m", 0.20, False),
    "parity_abs_hi": ("put_call_parity_residual", 0.90, True),
}
# Condition names in bit order and their cut-offs.
CONDITIONS = (
    "call_up_put_down", "call_down_put_up", "both_options_up", "both_options_down",
    "call_gap_positive", "call_gap_negative", "put_gap_positive", "put_gap_negative",
    "positive_news", "negative_news", "high_news", "high_emotion", "high_surprise",
    "earnings_news", "guidance_news", "analyst_news", "regulatory_news", "earnings_near",
    "call_volume_dominates", "put_volume_dominates", "stock_positive_momentum",
    "stock_negative_momentum", "large_positive_pair_divergence", "large_negative_pair_divergence",
    "parity_dislocation",
)
MOVE, SENTIMENT, NEWS_COUNT, INTENSITY = 0.01, 0.20, 2, 0.35
VOLUME_HIGH, VOLUME_LOW, MOMENTUM, EARNINGS_DAYS = 2.0, 0.5, 0.005, 5
STATES = ("call_up_put_down", "call_down_put_up", "both_up", "both_down")
MIN_DISCOVERY, MIN_VALIDATION, MAX_ORDER = 100, 40, 3
DEFAULT_STATE_PRIOR, DEFAULT_UP_PRIOR = 0.25, 0.5


def learn_thresholds(discovery: DataFrame) -> DataFrame:
    """One row of quantile thresholds, exact and distributed, from discovery rows only."""
    sources = {}
    for column, q, absolute in THRESHOLDS.values():
        sources[(column, absolute)] = sources.get((column, absolute), []) + [q]
    pairs = F.array(*[
        F.struct(F.lit(f"{column}|{absolute}").alias("source"),
                 (F.abs(column) if absolute else F.col(column)).cast("double").alias("value"))
        for column, absolute in sources])
    quantiles = sorted({q for qs in sources.values() for q in qs})
    found = exact_quantiles(discovery.select(F.inline(pairs)), keys=["source"], value="value",
                            probabilities={f"q{int(q * 100)}": q for q in quantiles})
    return found.agg(F.struct(*[
        F.max(F.when(F.col("source") == f"{column}|{absolute}", F.col(f"q{int(q * 100)}"))).alias(name)
        for name, (column, q, absolute) in THRESHOLDS.items()]).alias("thresholds"))


def condition_columns(frame: DataFrame, thresholds: Column) -> dict[str, Column]:
    """The flags as boolean expressions; a missing input or threshold is False."""
    have = set(frame.columns)
    c = lambda name: F.col(name).cast("double") if name in have else F.lit(None).cast("double")
    t = lambda name: thresholds[name]
    call, put = c("call_option_return_5m"), c("put_option_return_5m")
    gap_c, gap_p, spread = c("call_expectation_gap"), c("put_expectation_gap"), c("call_put_return_divergence_5m")
    mood, volume, trend, due = c("sentiment_60m"), c("call_put_volume_ratio"), c("stock_return_30m"), c("days_to_earnings")
    tests = [
        (call > MOVE) & (put < -MOVE), (call < -MOVE) & (put > MOVE), (call > MOVE) & (put > MOVE), (call < -MOVE) & (put < -MOVE),
        gap_c >= t("call_gap_hi"), gap_c <= t("call_gap_lo"), gap_p >= t("put_gap_hi"), gap_p <= t("put_gap_lo"),
        mood >= SENTIMENT, mood <= -SENTIMENT, c("news_count_60m") >= NEWS_COUNT,
        c("emotion_60m") >= INTENSITY, c("surprise_60m") >= INTENSITY,
        c("earnings_news_60m") >= 1, c("guidance_news_60m") >= 1, c("analyst_news_60m") >= 1,
        c("legal_regulatory_news_60m") >= 1, (due >= 0) & (due <= EARNINGS_DAYS),
        volume >= VOLUME_HIGH, volume <= VOLUME_LOW, trend >= MOMENTUM, trend <= -MOMENTUM,
        spread >= t("pair_div_hi"), spread <= t("pair_div_lo"),
        F.abs(c("put_call_parity_residual")) >= t("parity_abs_hi"),
    ]
    return {name: truth(test) for name, test in zip(CONDITIONS, tests)}


def add_conditions(frame: DataFrame, thresholds: DataFrame, out: str = "mask") -> DataFrame:
    """All conditions of a row as one bit mask; thresholds ride along as a scalar."""
    d = frame.withColumn("_th", thresholds.scalar())
    flags = condition_columns(frame, F.col("_th"))
    mask = F.lit(0).cast("long")
    for bit, name in enumerate(CONDITIONS):
        mask = mask.bitwiseOR(F.when(flags[name], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return d.withColumn(out, mask).drop("_th")


def joint_state(call: Column, put: Column) -> Column:
    """Which of call and put gained; a fall or no change counts as down."""
    return (F.when((call > 0) & (put <= 0), STATES[0]).when((call <= 0) & (put > 0), STATES[1])
            .when((call > 0) & (put > 0), STATES[2]).when((call <= 0) & (put <= 0), STATES[3]))


_SUMS = {"n": "n", "up": "up", "returns": "returns", "calls": "calls", "puts": "puts", **{s: s for s in STATES}}


def outcome_sums(frame: DataFrame, *, keys: list[str], stock: str, call: str, put: str) -> DataFrame:
    """Additive outcome statistics per key; everything later is derived from them."""
    state = joint_state(F.col(call), F.col(put))
    d = frame.filter(F.col(stock).isNotNull() & F.col(call).isNotNull() & F.col(put).isNotNull())
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(stock) > 0).cast("long")).alias("up"),
        F.sum(stock).alias("returns"), F.sum(call).alias("calls"), F.sum(put).alias("puts"),
        *[F.sum((state == s).cast("long")).alias(s) for s in STATES])


def outcome_stats(sums: DataFrame, *, keys: list[str], baseline: Column) -> DataFrame:
    """Probabilities, interval, lift and mean returns from additive sums."""
    low, high = wilson(F.col("up"), F.col("n"))
    p = F.col("up") / F.col("n")
    return sums.select(
        *keys, F.col("n").alias("support"), p.alias("prob_stock_up"), low.alias("ci_low"), high.alias("ci_high"),
        (p - baseline).alias("lift"), (F.col("returns") / F.col("n")).alias("mean_stock_return"),
        (F.col("calls") / F.col("n")).alias("mean_call_return"), (F.col("puts") / F.col("n")).alias("mean_put_return"),
        *[(F.col(s) / F.col("n")).alias(f"prob_{s}") for s in STATES])


def _bit_values(mask: Column) -> Column:
    return F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(len(CONDITIONS))]),
                    lambda v: mask.bitwiseAND(v) != 0)


def _subsets(values: Column, max_order: int) -> Column:
    after = lambda a: F.filter(values, lambda b: b > a)
    parts = [values]
    if max_order >= 2:
        parts.append(F.flatten(F.transform(values, lambda a: F.transform(after(a), lambda b: a.bitwiseOR(b)))))
    if max_order >= 3:
        parts.append(F.flatten(F.transform(values, lambda a: F.flatten(F.transform(
            after(a), lambda b: F.transform(F.filter(values, lambda c: c > b), lambda c: a.bitwiseOR(b).bitwiseOR(c)))))))
    return F.concat(*parts)


def mine_patterns(frame: DataFrame, *, part: str, mask: str = "mask", stock: str, call: str, put: str,
                  min_discovery: int = MIN_DISCOVERY, min_validation: int = MIN_VALIDATION,
                  max_order: int = MAX_ORDER) -> DataFrame:
    """Condition sets of up to three with enough support in discovery and validation.

    Rows first collapse to distinct masks (all outcome statistics are sums), then
    bits without support are dropped, and only subsets of bits that are *true* in
    some mask are ever formed.  The input size no longer matters after the first
    aggregate.
    """
    masks = outcome_sums(frame.filter(F.col(part).isin("discovery", "validation")), keys=[part, mask],
                         stock=stock, call=call, put=put)
    enough = lambda split, least: F.sum(F.when(F.col(part) == split, F.col("n")).otherwise(0)) >= least
    bits = masks.select(part, "n", F.explode(_bit_values(F.col(mask))).alias("bit")).groupBy("bit").agg(
        (enough("discovery", min_discovery) & enough("validation", min_validation)).alias("ok"))
    frequent = bits.filter("ok").agg(F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("b"))
    live = masks.withColumn("_live", F.col(mask).bitwiseAND(frequent.scalar()))
    fanned = live.select(part, *_SUMS, F.explode(_subsets(_bit_values(F.col("_live")), max_order)).alias("pattern"))
    sums = fanned.groupBy("pattern", part).agg(*[F.sum(c).alias(c) for c in _SUMS])
    total = masks.groupBy(part).agg((F.sum("up") / F.sum("n")).alias("_base"))
    stats = outcome_stats(sums.join(total, part), keys=["pattern", part], baseline=F.col("_base"))
    side = lambda s, p: stats.filter(F.col(part) == s).select(
        "pattern", *[F.col(c).alias(p + c) for c in stats.columns if c not in ("pattern", part)])
    both = side("discovery", "discovery_").filter(F.col("discovery_support") >= min_discovery).join(
        side("validation", "").filter(F.col("support") >= min_validation), "pattern")
    concentration = F.greatest(*[F.col(f"prob_{s}") for s in STATES]) - 0.25
    root = F.sqrt("support")
    return both.withColumns({
        "order": F.bit_count("pattern"),
        "score": F.abs("lift") * root + F.greatest(F.lit(0.0), concentration) * root * 0.5,
        "direction": F.when(F.col("mean_stock_return") > 0, "up").when(F.col("mean_stock_return") < 0, "down").otherwise("flat"),
    })


def strongest(patterns: DataFrame, n: int | None = None) -> DataFrame:
    """All patterns, or the ``n`` strongest; equal scores (to nine digits) go by pattern code."""
    return patterns if n is None else patterns.orderBy(F.round("score", 9).desc(), "pattern").limit(n)


_PRIORS = {**{s: f"prob_{s}" for s in STATES}, "stock_up": "prob_stock_up"}


def _matches(frame: DataFrame, patterns: DataFrame, mask: str) -> DataFrame:
    """Patterns that each distinct mask holds.  A mask forms its own subsets, which meet
    the patterns by equality, so neither side is collected whatever its size."""
    masks = frame.select(mask).distinct()
    subsets = masks.select(mask, F.explode(_subsets(_bit_values(F.col(mask)), MAX_ORDER)).alias("pattern"))
    return subsets.join(patterns.select("pattern", "support", "lift", "score", *_PRIORS.values()), "pattern")


def add_pattern_priors(frame: DataFrame, patterns: DataFrame, defaults: dict[str, float] | None = None,
                       mask: str = "mask") -> DataFrame:
    """Support-weighted mean probabilities of the matched patterns, else defaults."""
    defaults = defaults or {}
    weight = F.sqrt(F.greatest(F.col("support").cast("double"), F.lit(1.0)))
    sums = {f"_{name}": F.sum(F.coalesce(F.col(column), F.lit(0.0)) * weight) for name, column in _PRIORS.items()}
    hits = _matches(frame, patterns, mask).groupBy(mask).agg(
        F.count(F.lit(1)).alias("_hits"), F.sum(weight).alias("_w"), F.sum(F.abs("lift") * weight).alias("_lift"), *[c.alias(n) for n, c in sums.items()])
    d = frame.join(hits, mask, "left")
    out = {}
    for name in _PRIORS:
        fallback = defaults.get(name, DEFAULT_UP_PRIOR if name == "stock_up" else DEFAULT_STATE_PRIOR)
        out[f"relationship_prior_{name}"] = F.coalesce(ratio(F.col(f"_{name}"), F.col("_w")), F.lit(fallback))
    out["relationship_match_count"] = F.coalesce("_hits", F.lit(0))
    out["relationship_strength"] = F.coalesce(ratio(F.col("_lift"), F.col("_w")), F.lit(0.0))
    return d.withColumns(out).drop("_hits", "_w", "_lift", *sums)


def explain(frame: DataFrame, patterns: DataFrame, *, limit: int | None = None, mask: str = "mask") -> DataFrame:
    """The matched patterns of every row, strongest first, as rows; all, or the ``limit`` strongest."""
    order = Window.partitionBy(mask).orderBy(F.round("score", 9).desc(), "pattern")
    hits = _matches(frame, patterns, mask).select(mask, F.row_number().over(order).alias("position"), "pattern", "support", "score", "prob_stock_up")
    if limit is not None:
        hits = hits.filter(F.col("position") <= limit)
    return frame.join(hits, mask).select(*frame.columns, "position", "pattern", "support", "score", "prob_stock_up")
