"""Text scoring, event categories, source preference, event histograms and pooling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import clip


@dataclass(frozen=True)
class Lexicon:
    """Word lists and ordered event terms."""
    positive: tuple[str, ...] = (
        "beat", "beats", "growth", "record", "strong", "surge", "surges", "upgrade", "upgraded", "raises", "raised",
        "outperform", "profit", "profits", "approval", "approved", "win", "wins", "positive", "higher", "expands",
        "expansion", "bullish", "rebound", "exceeds")
    negative: tuple[str, ...] = (
        "miss", "misses", "weak", "decline", "declines", "downgrade", "downgraded", "cuts", "cut", "lawsuit", "probe",
        "investigation", "recall", "loss", "losses", "lower", "warning", "negative", "bearish", "fraud", "halt",
        "layoff", "layoffs", "risk", "falls")
    surprise: tuple[str, ...] = (
        "unexpected", "surprise", "surprises", "beat", "beats", "miss", "misses", "raises", "cuts", "halt", "plunge",
        "surge", "shock", "record", "warning", "exceeds")
    events: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("earnings", ("earnings", "eps", "quarter", "quarterly results", "revenue", "profit")),
        ("guidance", ("guidance", "outlook", "forecast", "expects", "raises forecast", "cuts forecast")),
        ("analyst", ("analyst", "upgrade", "downgrade", "price target", "outperform", "underperform")),
        ("product", ("launch", "product", "chip", "drug", "trial", "approval", "contract", "order")),
        ("legal_regulatory", ("lawsuit", "court", "regulator", "regulatory", "sec ", "doj", "ftc", "probe", "investigation")),
        ("mna", ("acquisition", "acquire", "merger", "takeover", "buyout")),
        ("management", ("ceo", "cfo", "management", "resigns", "resignation", "appoints", "appointed")),
        ("macro", ("fed", "inflation", "interest rate", "jobs report", "gdp", "tariff", "treasury", "recession")),
    )


# Scoring constants and the provider override.
EMOTION_WORDS, EXCLAMATION, SURPRISE_WORDS = 6.0, 0.08, 3.0
PROVIDER_STRENGTH, NEUTRAL_BAND = 0.65, 0.25
TEXT_COLUMNS = ("headline", "title", "article_title", "description", "article_description", "article_text", "google_context")


def score_text(frame: DataFrame, text: str | Column, lexicon: Lexicon = Lexicon(), provider: str | None = None) -> DataFrame:
    """Polarity, emotion and surprise of whole texts; all JVM-side."""
    raw = F.col(text) if isinstance(text, str) else text
    d = frame.withColumn("_words", F.regexp_extract_all(F.lower(raw), F.lit("[a-z]+"), 0))
    hits = lambda words: F.size(F.filter("_words", lambda w: w.isin(*words)))
    d = d.withColumns({"_p": hits(lexicon.positive), "_n": hits(lexicon.negative), "_s": hits(lexicon.surprise),
                       "_bang": F.length(raw) - F.length(F.replace(raw, F.lit("!"), F.lit("")))})
    any_word = F.size("_words") > 0
    both = F.col("_p") + F.col("_n")
    polarity = F.when(any_word, (F.col("_p") - F.col("_n")) / F.greatest(F.lit(1), both)).otherwise(F.lit(0.0))
    if provider:
        said = F.lower(F.coalesce(provider, F.lit("")))
        polarity = (F.when(said.contains("positive"), F.greatest(polarity, F.lit(PROVIDER_STRENGTH)))
                    .when(said.contains("negative"), F.least(polarity, F.lit(-PROVIDER_STRENGTH)))
                    .when(said.contains("neutral") & (F.abs(polarity) < NEUTRAL_BAND), F.lit(0.0)).otherwise(polarity))
    return d.withColumns({
        "sentiment_score": polarity,
        "emotion_intensity": F.when(any_word, F.least(F.lit(1.0), both / EMOTION_WORDS + F.col("_bang") * EXCLAMATION)).otherwise(0.0),
        "surprise_score": F.when(any_word, F.least(F.lit(1.0), F.col("_s") / SURPRISE_WORDS)).otherwise(0.0),
    }).drop("_words", "_p", "_n", "_s", "_bang")


def event_category(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """First category, in order, with a term inside the text; else other."""
    low = F.lower(text)
    out = None
    for name, terms in lexicon.events:
        test = low.contains(terms[0])
        for term in terms[1:]:
            test = test | low.contains(term)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other") if out is not None else F.lit("other")


def prefer_source(rows: DataFrame, *, keys: list[str], rank: str) -> DataFrame:
    """Keep the rows of the best source each key has.  The best rank is a small
    grouped minimum joined back, so a large key is not held in one window."""
    best = rows.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return rows.join(best, keys).filter(F.col(rank) == F.col("_best")).drop("_best")


# --------------------------------------------------------------- embeddings
# Attention weights of the chunk signals, and their default.
ATTENTION = {"quality": 1.4, "relevance": 1.8, "importance": 1.5, "novelty": 0.8, "recency": 0.5}
SIGNAL_DEFAULT = 0.5


def availability(frame: DataFrame, *, effective: str, published: str, first_seen: str) -> DataFrame:
    """When a chunk became usable, and on what evidence."""
    clock = F.when(F.col(effective).isNotNull(), F.col(effective)).when(
        F.col(published).isNotNull() & F.col(first_seen).isNotNull(), F.greatest(published, first_seen)).otherwise(F.col(published))
    basis = (F.when(F.col(effective).isNotNull(), "effective_available_at")
             .when(F.col(published).isNotNull() & F.col(first_seen).isNotNull(), "max_published_first_seen")
             .when(F.col(published).isNotNull(), "legacy_publication_only").otherwise("missing"))
    return frame.withColumns({"available": clock, "availability_basis": basis})


def pool_embeddings(chunks: DataFrame, *, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """Attention-weighted, length-normalised mean vector per key, with its spread.

    Logits lie in [0, 6], so the softmax needs no shift by the maximum and the
    whole pooling is one weighted aggregate that combines before the shuffle.
    """
    have = set(chunks.columns)
    signal = {n: clip(F.coalesce(F.col(n).cast("double"), F.lit(SIGNAL_DEFAULT)), 0.0, 1.0) if n in have else F.lit(SIGNAL_DEFAULT)
              for n in ATTENTION}
    d = chunks.select(*keys, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"),
                      *[c.alias(n) for n, c in signal.items()])
    d = d.withColumn("_z", sum((F.col(n) * w for n, w in ATTENTION.items()), F.lit(0.0))).withColumn("_w", F.exp("_z"))
    g = d.groupBy(*keys).agg(
        Summarizer.mean(F.col("_v"), F.col("_w")).alias("_mean"), F.count(F.lit(1)).alias("chunks"),
        F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_z")).alias("_swz"), F.max("_w").alias("_top"),
        *[F.avg(n).alias(f"mean_{n}") for n in ("quality", "relevance", "importance", "novelty")])
    values = vector_to_array("_mean")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    g = g.withColumn("_norm", norm).withColumn("_values", values)
    unit = F.transform("_values", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x).cast("float"))
    return g.select(*keys, unit.alias("embedding"), "chunks",
                    F.exp(F.ln("_sw") - F.col("_swz") / F.col("_sw")).alias("effective_chunks"),
                    (F.col("_top") / F.col("_sw")).alias("max_attention"),
                    *[f"mean_{n}" for n in ("quality", "relevance", "importance", "novelty")])


# ------------------------------------------------------------- event histogram
# The category vocabulary and normalisers of the event block.
EVENT_VOCABULARY = {
    "event_type": ("earnings", "guidance", "mna", "regulatory", "legal", "analyst", "product", "management", "capital",
                   "macro", "operations", "other"),
    "direction": ("positive", "negative", "mixed", "neutral", "unclear"),
    "market_impact": ("low", "medium", "high", "unknown"),
    "time_horizon": ("intraday", "days", "weeks", "months", "long_term", "unknown"),
    "expected_vs_surprise": ("expected", "surprise", "unclear"),
}
EVENT_MEASURES = ("ticker_relevance", "importance", "uncertainty", "novelty")
EVENT_COUNT_CAP, FACTS_SCALE, CHAIN_SCALE = 101.0, 8.0, 6.0


def event_feature_names() -> list[str]:
    shares = [f"{f}_{v}" for f, vs in EVENT_VOCABULARY.items() for v in vs]
    return ([f"{n}_share" for n in shares] + [f"{n}_importance_share" for n in shares]
            + [f"{f}_{s}" for f in EVENT_MEASURES for s in ("mean", "max")]
            + ["event_count_log", "facts_mean", "causal_chain_mean", "llm_error_share"])


def event_histogram(events: DataFrame, *, keys: list[str], available: str, published: str, as_of: str) -> DataFrame:
    """72 features of the events known at ``as_of``, and how many were left out.

    An unknown category counts for none; an absent one for the field's last.
    """
    seen = F.coalesce(F.col(available), F.col(published))
    d = events.withColumns({"_seen": seen, "_on": F.coalesce(seen <= F.col(as_of), F.lit(False))})
    bounded = lambda n: clip(F.coalesce(F.col(n).cast("double"), F.lit(0.5)), 0.0, 1.0)
    d = d.withColumns({f"_{n}": bounded(n) for n in EVENT_MEASURES})
    d = d.withColumns({f"_c_{f}": F.lower(F.coalesce(f, F.lit(vs[-1]))) for f, vs in EVENT_VOCABULARY.items()})
    on = lambda c: F.when(F.col("_on"), c)
    one = lambda f, v: F.when(F.col("_on") & (F.col(f"_c_{f}") == v), F.lit(1.0)).otherwise(0.0)
    aggs = [F.count_if("_on").alias("events"), F.count(F.lit(1)).alias("source_events"),
            F.count_if(F.col("_seen") > F.col(as_of)).alias("excluded_after_asof"),
            F.count_if(F.col("_seen").isNull()).alias("excluded_missing_time"), F.sum(on(F.col("_importance"))).alias("_imp")]
    for f, vs in EVENT_VOCABULARY.items():
        for v in vs:
            aggs += [F.sum(one(f, v)).alias(f"_n_{f}_{v}"), F.sum(one(f, v) * F.col("_importance")).alias(f"_i_{f}_{v}")]
    for f in EVENT_MEASURES:
        aggs += [F.avg(on(F.col(f"_{f}"))).alias(f"_mean_{f}"), F.max(on(F.col(f"_{f}"))).alias(f"_max_{f}")]
    aggs += [F.avg(on(F.coalesce("facts", F.lit(0)))).alias("_facts"), F.avg(on(F.coalesce("causal_chain", F.lit(0)))).alias("_chain"),
             F.avg(on(F.coalesce("llm_error", F.lit(False)).cast("double"))).alias("_error")]
    g = d.groupBy(*keys).agg(*aggs)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for f, vs in EVENT_VOCABULARY.items():
        for v in vs:
            out.append(zero(F.try_divide(F.col(f"_n_{f}_{v}"), F.col("events"))).alias(f"{f}_{v}_share"))
            out.append(zero(F.col(f"_i_{f}_{v}") / F.greatest("_imp", F.lit(1e-8))).alias(f"{f}_{v}_importance_share"))
    for f in EVENT_MEASURES:
        out += [zero(F.col(f"_mean_{f}")).alias(f"{f}_mean"), zero(F.col(f"_max_{f}")).alias(f"{f}_max")]
    out += [F.least(F.lit(1.0), F.log1p(F.col("events").cast("double")) / F.ln(F.lit(EVENT_COUNT_CAP))).alias("event_count_log"),
            zero(F.col("_facts") / FACTS_SCALE).alias("facts_mean"), zero(F.col("_chain") / CHAIN_SCALE).alias("causal_chain_mean"),
            zero(F.col("_error")).alias("llm_error_share")]
    return g.select(*keys, "events", "source_events", "excluded_after_asof", "excluded_missing_time", *out)
