"""Targets, pairs, anchors, news, vectors and risk on small fixtures."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import news, options, pages, relationships, risk, signals, targets, vectors
from tidemark.schema import safe_inputs


def ts(text):
    return pd.Timestamp(text).to_pydatetime()


def test_target_stays_in_its_contract(spark):
    rows = [(c, ts(f"2025-01-02 14:3{m}:00"), float(o + m + 1)) for c, o in (("C", 0), ("P", 100)) for m in (0, 1, 2, 4, 5)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, px double")
    out = targets.forward_target(d, d.select("ticker", "ts", F.col("px").alias("future")), keys=["ticker"], ts="ts", minutes=2, take=["future"], tie=[])
    got = {(r["ticker"], r["ts"]): r for r in out.collect()}
    assert len(got) == 10 and got[("C", ts("2025-01-02 14:30:00"))]["future"] == 3.0
    assert got[("C", ts("2025-01-02 14:31:00"))]["target_ts"] == ts("2025-01-02 14:34:00")


def test_close_anchor(spark):
    rows = [("a", ts("2025-01-02 20:00:00")), ("a", ts("2025-01-02 20:50:00")), ("b", ts("2025-01-02 19:00:00"))]
    out = targets.close_anchor(spark.createDataFrame(rows, "k string, ts timestamp"), keys=["k"], ts="ts", tie=[]).collect()
    assert [(r["k"], r["ts"], r["source_staleness_minutes"]) for r in out] == [("a", ts("2025-01-02 21:00:00"), 10.0)]


def test_close_follows_daylight_saving(spark):
    d = spark.createDataFrame([("2025-01-15",), ("2025-07-15",)], "d string").select(F.hour(clock.market_close(F.col("d").cast("date"))).alias("h"))
    assert sorted(r["h"] for r in d.collect()) == [20, 21]


def test_pair_keeps_last_of_each_side(spark):
    rows = [("k", "call", 1, 10.0), ("k", "call", 2, 11.0), ("k", "put", 1, 5.0), ("lonely", "call", 1, 1.0)]
    out = options.pair(spark.createDataFrame(rows, "k string, t string, i int, px double"), keys=["k"], option_type="t", order=["i"], measures=["px"]).collect()
    assert [(r["k"], r["call_px"], r["put_px"]) for r in out] == [("k", 11.0, 5.0)]


def test_symbol_parts(spark):
    r = options.parse_symbol(spark.createDataFrame([("O:NVDA260101C00100000",), ("bad",)], "s string"), "s").collect()
    assert (r[0]["underlying"], str(r[0]["expiry"]), r[0]["option_type"], r[0]["strike"]) == ("NVDA", "2026-01-01", "call", 100.0)
    assert r[1]["underlying"] is None and r[1]["strike"] is None


def test_events_known_at_the_close(spark):
    d = spark.createDataFrame([("k", ts("2025-01-02 21:00:00"), "guidance", ts("2025-01-02 19:00:00")), ("k", ts("2025-01-02 21:00:00"), "legal", ts("2025-01-02 22:00:00"))],
                              "k string, as_of timestamp, event_type string, available timestamp")
    for c in ("direction", "market_impact", "time_horizon", "expected_vs_surprise"):
        d = d.withColumn(c, F.lit(None).cast("string"))
    for c in news.EVENT_MEASURES:
        d = d.withColumn(c, F.lit(None).cast("double"))
    d = d.withColumns({"published": F.lit(None).cast("timestamp"), "facts": F.lit(0), "causal_chain": F.lit(0), "llm_error": F.lit(False)})
    r = news.event_histogram(d, keys=["k"], available="available", published="published", as_of="as_of").first()
    assert (r["events"], r["excluded_after_asof"], r["event_type_guidance_share"], r["direction_unclear_share"]) == (1, 1, 1.0, 1.0)
    assert len(news.event_feature_names()) == 72


def test_pooling_gives_a_unit_vector(spark):
    rows = [("k", [float((i * 7 + j) % 5 - 2) for j in range(32)], i / 5) for i in range(6)]
    r = news.pool_embeddings(spark.createDataFrame(rows, "k string, embedding array<float>, relevance double"), keys=["k"]).first()
    assert sum(x * x for x in r["embedding"]) == pytest.approx(1, abs=1e-5) and r["chunks"] == 6 and 1 <= r["effective_chunks"] <= 6


def test_text_scores(spark):
    d = spark.createDataFrame([("Profit beats, strong growth!", None), ("", None), ("calm", "Negative"), ("lawsuit2 filed", "x")], "t string, p string")
    r = news.score_text(d, "t", provider="p").collect()
    assert r[0]["sentiment_score"] == 1.0 and r[0]["emotion_intensity"] == pytest.approx(4 / 6 + .08) and r[1]["sentiment_score"] == 0.0
    assert r[2]["sentiment_score"] == -.65 and r[3]["sentiment_score"] == -1.0
    cats = [x[0] for x in d.select(news.event_category(F.col("t"))).collect()]
    assert cats == ["earnings", "other", "other", "legal_regulatory"]


def test_page_fields(spark):
    html = ('<html><head><title>T &amp; U</title><meta name="description" content=" a  b "><script type="application/ld+json">'
            '{"@type":"NewsArticle","author":[{"name":"Ann"}],"articleBody":"' + "word " * 60 + '"}</script></head><body><a href="/x">A title that is long enough</a>'
            "<p>Open</p><b>12.5</b></body></html>")
    d = spark.createDataFrame([(1, "https://www.site.com/p", html)], "id long, url string, html string")
    r = pages.extract_articles(d, key="id", url="url", html="html").first()
    assert (r["article_title"], r["article_description"], r["author"], r["article_word_count"], r["source_domain"]) == ("T & U", "a b", "Ann", 60, "site.com")
    link = pages.harvest_links(d, key="id", url="url", html="html").first()
    assert link["href"] == "https://www.site.com/x"
    assert pages.labelled_facts(d, key="id", html="html", labels={"open": ("Open",)}).first()["open"] == "12.5"
    now = F.lit("2025-01-02 12:00:00").cast("timestamp")
    got = d.select(*[F.date_format(pages.relative_time(F.lit(x), now), "dd HH:mm") for x in ("3 hours ago", "20 min ago", "Yesterday", "soon")]).first()
    assert tuple(got) == ("02 09:00", "02 11:40", "01 12:00", None)


def test_vector_layouts_and_ablation(spark):
    assert vectors.layout(384) == {"news": 192, "options": 96, "stock": 48, "expectation": 32, "quality": 16}
    assert list(vectors.layout(128).values()) == [61, 32, 16, 11, 8]
    d = spark.createDataFrame([("k", *[[float(i + o) for i in range(10)] for o in range(7)])],
                              "k string, " + ", ".join(f"{b} array<double>" for b in vectors.BLOCKS))
    got = {r["variant"]: r["vector"] for r in vectors.ablate(d).collect()}
    assert {len(v) for v in got.values()} == {384} and all(x == 0 for x in got["without_news"][:192])
    assert got["without_news"][192:] == got["all_layers"][192:] and any(got["all_layers"][:192])
    assert len(vectors.assemble(d, 256).first()["vector"]) == 256
    assert safe_inputs(["safe_feature", "future_return", "target_payoff", "label_up"]) == ["safe_feature"]


def candidate(spark, **changes):
    base = dict(ticker="NVDA", side="call", expected_return=.25, expected_cost_return=.04, uncertainty=.05, option_price=2.0, contract_multiplier=100,
                relative_spread=.04, open_interest=1000, daily_volume=500, data_age_minutes=1.0, feature_complete=True, leakage_valid=True, model_valid=True,
                system_healthy=True, drift_alert=False, equity=100000.0, gross_exposure=0.0, ticker_exposure=0.0, sector_exposure=0.0, daily_pnl=0.0,
                drawdown_pct=0.0, correlated_exposure_pct=0.0)
    d = spark.createDataFrame(pd.DataFrame([{**base, **{k: v for k, v in changes.items() if v is not None}}]))
    for name, value in changes.items():
        if value is None:
            d = d.withColumn(name, F.lit(None).cast("double"))
    return risk.evaluate_risk(d).first()


def test_risk_limits(spark):
    good = candidate(spark)
    assert good["decision"] == "TRADE" and good["contracts"] == 2 and good["reasons"] == []
    leak = candidate(spark, leakage_valid=False)
    assert leak["kill_switch"] and leak["decision"] == "NO_TRADE" and leak["reasons"] == ["leakage_audit_mislukt"]
    assert candidate(spark, relative_spread=None)["reasons"] == ["spread_onbekend"]
    assert candidate(spark, option_price=900.0)["reasons"] == ["positie_binnen_risicolimieten_te_klein"]


def test_monitor_stops_on_losses(spark):
    d = spark.createDataFrame([("b", i, .02, -.03, .8, 0.0, None, None, .2, 10.0) for i in range(40)],
                              "k string, i int, expected_net_return double, actual_net_return double, probability_positive double, positive_outcome double, "
                              "expected_cost_return double, actual_cost_return double, relative_spread double, open_interest double")
    r = risk.monitor(d, keys=["k"], order=["i"], bucket="i").first()
    assert r["kill_switch"] and "negatieve_live_ev" in r["triggers"] and "liquiditeit_verslechterd" in r["triggers"]


def test_event_rows_and_labels(spark):
    d = spark.createDataFrame([("T", ts("2025-01-02 15:00:10"), 1.0, 0.0, 3.0), ("T", ts("2025-01-02 15:00:40"), 0.0, 1.0, None), ("T", ts("2025-01-02 15:01:00"), 0.0, 0.0, 0.0)],
                              "ticker string, ts timestamp, event_stock_breakout_up_30m double, event_high_realized_vol double, news_count_60m double")
    r = signals.detect_events(d, keys=["ticker"]).collect()
    assert len(r) == 1 and r[0]["event_labels"] == "stock_breakout_up_30m|high_realized_vol|professional_news"


def test_pattern_subsets_match_brute_force(spark):
    from itertools import combinations
    rows = [(p, i % 8, (i % 3 - 1) / 10.0, .1 if i % 2 else -.1, -.1) for p in ("discovery", "validation") for i in range(64)]
    d = spark.createDataFrame(rows, "part string, mask long, s double, c double, p double")
    got = {r["pattern"]: r["support"] for r in relationships.mine_patterns(d, part="part", stock="s", call="c", put="p", min_discovery=1, min_validation=1).collect()}
    want = {}
    for n in (1, 2, 3):
        for combo in combinations((1, 2, 4), n):
            code = sum(combo)
            want[code] = sum(1 for p, m, *_ in rows if p == "validation" and m & code == code)
    assert got == want
