"""Earnings, splits, research, sources, streams and leakage."""
import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import audits, earnings, regimes, research, scan, splits
from tidemark.sources import inventory, results, snapshots


def fact(**k):
    return {"start": None, "end": "2025-04-27", "val": 1.0, "accn": "A1", "fy": 2026, "fp": "Q1", "form": "10-Q", "filed": "2025-05-01", **k}


def company(extra=()):
    usd = lambda *f: {"units": {"USD": list(f)}}
    return json.dumps({"facts": {"us-gaap": {
        "Revenues": usd(fact(start="2025-01-27", val=44e9)), "Assets": usd(fact(val=140e9)), "StockholdersEquity": usd(fact(val=90e9)),
        "EarningsPerShareDiluted": {"units": {"USD/shares": [fact(start="2025-01-27", val=.95), *extra]}}, "Ignored": usd(fact())}}})


def picked(spark, doc):
    facts = earnings.explode_facts(spark.createDataFrame([("NVDA", doc)], "ticker string, json string"), keys=["ticker"], json="json")
    return earnings.pick_facts(facts, earnings.majority_period(facts, keys=["ticker"]), keys=["ticker"])


def test_filing_facts(spark):
    p = picked(spark, company())
    r = earnings.derive_liabilities(p, keys=["ticker"]).first()
    assert (r["revenue"], r["eps_actual_sec"], r["liabilities"]) == (44e9, .95, 50e9)


def test_annual_eps_is_never_split(spark):
    annual = fact(start="2024-01-29", end="2025-01-26", val=4.0, accn="A0", fy=2025, fp="FY", form="10-K", filed="2025-02-26")
    q = {r["accn"]: r for r in earnings.quarterise(picked(spark, company([annual])), keys=["ticker"]).filter("metric = 'eps_actual_sec'").collect()}
    assert q["A0"]["value"] is None and q["A0"]["derivation"] == "non_additive_period_rejected" and q["A1"]["value"] == .95


def test_acceptance_clock(spark):
    doc = json.dumps({"filings": {"recent": {"accessionNumber": ["A1", "A2"], "acceptanceDateTime": ["2025-05-01T20:15:00Z", None], "filingDate": ["2025-05-01", "2025-06-01"],
                                             "reportDate": ["2025-04-27", None], "form": ["10-Q", "8-K"]}}})
    d = earnings.acceptance_clock(spark.createDataFrame([("NVDA", doc)], "t string, json string"), keys=["t"], json="json")
    got = {r["accn"]: r["c"] for r in d.withColumn("c", F.date_format(earnings.filing_available(F.col("accepted"), F.col("filing_date")), "yyyy-MM-dd HH:mm")).collect()}
    assert got == {"A1": "2025-05-01 20:15", "A2": "2025-06-02 00:00"}


def estimates(spark, time, rows):
    d = spark.createDataFrame([("N", dt.date(2025, 5, 28), time, dt.datetime.fromisoformat(o), e, a) for o, e, a in rows],
                              "ticker string, earnings_date date, raw string, observed_at timestamp, eps_estimated double, eps_actual double")
    d = d.withColumns({"revenue_estimated": F.lit(None).cast("double"), "revenue_actual": F.lit(None).cast("double"), "label": earnings.release_label(F.col("raw"))})
    return earnings.select_estimates(d.withColumn("cutoff", earnings.estimate_cutoff(F.col("earnings_date"), F.col("label"))), keys=["ticker", "earnings_date"]).first()


def test_estimate_before_the_event_is_kept(spark):
    r = estimates(spark, "amc", [("2025-05-20 12:00:00", .90, None), ("2025-05-29 12:00:00", .97, .95)])
    assert (r["eps_estimated"], r["eps_actual"], r["estimate_status"]) == (.90, .95, "observed_pre_event")
    r = estimates(spark, None, [("2025-05-28 12:00:00", .90, None)])
    assert not r["estimate_safe"] and r["estimate_status"] == "backfill_unverified"


def test_earnings_features_wait_for_their_clock(spark):
    t = lambda x: dt.datetime.fromisoformat(x)
    rec = {"event_id": "e", "earnings_date": dt.date(2025, 5, 28), "earnings_time": "after_market_close", "filing_date": None, "event_schedule_available": t("2025-05-01 00:00:00"),
           "estimate_available": t("2025-05-20 00:00:00"), "actual_available": t("2025-05-28 20:05:00"), "surprise_available": t("2025-05-28 20:05:00"), "sec_available": None,
           "estimate_safe": True, "eps_estimated": .9, "eps_actual": .95, "eps_surprise": .05}
    schema = ("ticker string, event_id string, earnings_date date, earnings_time string, filing_date date, event_schedule_available timestamp, estimate_available timestamp, "
              "actual_available timestamp, surprise_available timestamp, sec_available timestamp, estimate_safe boolean, eps_estimated double, eps_actual double, eps_surprise double")
    d = spark.createDataFrame([{"ticker": "N", **rec}], schema)
    for c in ("revenue_estimated", "revenue_actual", "eps_surprise_pct", "revenue_surprise", "revenue_surprise_pct", "net_income", "assets", "liabilities", "cash_flow"):
        d = d.withColumn(c, F.lit(None).cast("double"))
    rows = spark.createDataFrame([("N", t(x)) for x in ("2025-04-30 12:00:00", "2025-05-10 12:00:00", "2025-05-21 12:00:00", "2025-05-28 15:00:00", "2025-05-28 21:00:00", "2025-06-01 12:00:00")], "ticker string, ts timestamp")
    r = earnings.attach_features(rows, d, keys=["ticker"], ts="ts").orderBy("ts").collect()
    assert [x["days_to_earnings"] for x in r] == [None, 18.0, 7.0, 0.0, 0.0, None]
    assert [x["eps_estimated"] for x in r] == [None, None, .9, .9, .9, .9] and [x["eps_actual"] for x in r] == [None, None, None, None, .95, .95]
    assert [x["days_since_earnings"] for x in r] == [None, None, None, 0.0, 0.0, 4.0] and r[3]["earnings_event_today"] == 1.0


def _records(spark, rows):
    """(event_id, earnings_date, schedule, actual, sec clocks in hours, safe) as records of one ticker."""
    schema = ("ticker string, event_id string, earnings_date date, event_schedule_available timestamp, actual_available timestamp, surprise_available timestamp, sec_available timestamp, "
              "estimate_safe boolean, eps_actual double, tie long")
    at = lambda h: None if h is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    d = spark.createDataFrame([("N", e, None if d is None else dt.date(2025, 1, 1) + dt.timedelta(days=d), at(s), at(a), at(a), at(f), safe, float(n), n)
                               for n, (e, d, s, a, f, safe) in enumerate(rows)], schema)
    for c in ("earnings_time", "filing_date", "estimate_available"):
        d = d.withColumn(c, F.lit(None).cast({"earnings_time": "string", "filing_date": "date"}.get(c, "timestamp")))
    for c in ("eps_estimated", "revenue_estimated", "revenue_actual", "eps_surprise", "eps_surprise_pct", "revenue_surprise", "revenue_surprise_pct", "net_income", "assets", "liabilities", "cash_flow"):
        d = d.withColumn(c, F.lit(None).cast("double"))
    return d


def test_change_points_agree_with_every_record_compared(spark):
    import random
    rng = random.Random(7)
    some = lambda n, share=.85: rng.randrange(n) if rng.random() < share else None
    rows = [(f"e{rng.randrange(6)}", some(12), some(200), some(400), some(400), rng.choice([True, False, None])) for _ in range(40)]
    got = earnings.change_points(_records(spark, rows), keys=["ticker"]).select(
        "t", "next.tie", "last_date", *[F.col(f"{c}.tie").alias(c) for c in ("facts", "actual", "surprise")]).orderBy("t").collect()
    day = lambda h: h // 24
    state = [None] * 5
    held = {int((r["t"] - dt.datetime(2025, 1, 1)).total_seconds() // 3600): r for r in got}
    assert len(held) == len(got)
    for h in range(450):
        if h in held:
            r = held[h]
            state = [r["tie"], None if r["last_date"] is None else (r["last_date"] - dt.date(2025, 1, 1)).days, r["facts"], r["actual"], r["surprise"]]
        first = {}
        for n, (e, d, s, a, f, safe) in enumerate(rows):
            if d is not None and s is not None and s <= h:
                first[e] = min(first.get(e, (d, s, n)), (d, s, n), key=lambda x: (x[0], x[1], _after(rows[x[2]]), x[2]))
        due = lambda test, key: max(((key(n, *r), n) for n, r in enumerate(rows) if test(*r)), default=(0, None))[1]
        past = lambda e, d, s, a, f, safe: a is not None and d is not None and a <= h and d <= day(h)
        ahead = sorted((d, s, _after(rows[n]), n) for d, s, n in first.values() if d >= day(h))
        assert state == [
            ahead[0][-1] if ahead else None, max((d for d, _, _ in first.values() if d <= day(h)), default=None),
            due(lambda e, d, s, a, f, safe: f is not None and f <= h, lambda n, e, d, s, a, f, safe: (f, n)),
            due(past, lambda n, e, d, s, a, f, safe: (d, a, n)),
            due(lambda *r: past(*r) and bool(r[-1]), lambda n, e, d, s, a, f, safe: (d, a, n))], h


def _after(row):
    """What decides between listings of one report, date and schedule clock: the rest of the record in order, nulls first."""
    e, d, s, a, f, safe = row
    none = lambda x: (x is not None, x or 0)
    return e, none(a), none(f), none(safe)


def test_change_points_of_a_ticker_with_many_records(spark):
    import time
    rows = [(f"e{n % 30}", n % 30, n % 700, 24 * (n % 30) + n % 17, n, n % 3 == 0) for n in range(8000)]
    began = time.time()
    assert earnings.change_points(_records(spark, rows), keys=["ticker"]).select("facts.tie").distinct().count() == 8000
    assert time.time() - began < 60  # every point against every record took minutes


def panel(spark, days=180, tickers=1):
    rng = np.random.default_rng(7)
    rows = [(f"T{k}", d.date(), float(s), float(n), float(.14 + .08 * s + e)) for k in range(tickers) for d, s, n, e in zip(
        pd.bdate_range("2024-01-02", periods=days), rng.normal(size=days), rng.normal(size=days), rng.normal(0, .02, days))]
    return spark.createDataFrame(rows, "ticker string, day date, feature_signal double, feature_noise double, ret double")


def test_folds_are_purged_and_apart(spark):
    cfg = splits.WalkForward(min_train_sessions=60, test_sessions=15, purge_sessions=2, n_splits=4)
    d = splits.walk_forward_folds(panel(spark), day="day", config=cfg).toPandas()
    index = {x: i for i, x in enumerate(sorted(panel(spark).toPandas().day))}
    tests = []
    for n, g in d.groupby("fold"):
        train, test = g[g.role == "train"].day.map(index), g[g.role == "test"].day.map(index)
        assert len(test) == 15 and test.min() - train.max() > 2
        tests.append(set(test))
    assert len(tests) == 4 and not set.intersection(*tests)


def test_partitions_keep_their_distance(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(100)], "day date")
    p = splits.time_partitions(d, day="day", purge=5, shares={"a": .55, "b": .15, "c": .15, "d": .15}).toPandas()
    span = p[p.part != "purged"].groupby("part").day.agg(["min", "max"]).sort_values("min")
    assert all((b - a).days > 5 for a, b in zip(span["max"][:-1], span["min"][1:]))


def test_ridge_equals_closed_form(spark):
    d = panel(spark)
    predict = research.ridge(d, ["feature_signal", "feature_noise"], "ret")
    got = predict(d).orderBy("day").toPandas().expected_return.to_numpy()
    pdf = d.orderBy("day").toPandas()
    x = pdf[["feature_signal", "feature_noise"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = pdf.ret.to_numpy()
    b = np.linalg.solve(x.T @ x + 25 * np.eye(2), x.T @ (y - y.mean()))
    np.testing.assert_allclose(got, y.mean() + x @ b, rtol=1e-6)


def test_overlapping_labels_stop_the_research(spark):
    d = panel(spark).withColumns({"label_end": F.date_add("day", 40), "cost": F.lit(.01), "month": F.date_trunc("month", "day")})
    with pytest.raises(audits.LeakageError):
        research.evaluate(d, research.Candidate("c", ("feature_signal",)), target="ret", cost="cost", day="day", label_end="label_end", order=["day"], bucket="month",
                          config=splits.WalkForward(min_train_sessions=60, test_sessions=15, purge_sessions=2, n_splits=2))


def test_only_the_true_relation_is_confirmed(spark):
    rng = np.random.default_rng(21)
    rows = [(f"T{k}", dt.date(2024, 1, 1) + dt.timedelta(i), float(s), float(n), float(.8 * s + e)) for k in range(10) for i, (s, n, e) in enumerate(
        zip(rng.normal(size=90), rng.normal(size=90), rng.normal(0, .25, 90)))]
    d = spark.createDataFrame(rows, "ticker string, day date, signal double, noise double, future_ret double")
    r = {x["feature"]: x for x in scan.relationship_scan(d, features=["signal", "noise"], target="future_ret", ticker="ticker", day="day").collect()}
    assert r["signal"]["confirmed"] and not r["signal"]["causal_claim"] and not (r.get("noise") and r["noise"]["confirmed"])


def test_sketched_terciles_see_only_earlier_sessions(spark):
    rows = [(f"T{k}", dt.date(2024, 1, 1) + dt.timedelta(i), float((i * 31 + k * 17) % 100)) for i in range(30) for k in range(5)]
    d = spark.createDataFrame(rows, "ticker string, day date, v double")
    got = {r["day"]: r["_low"] for r in regimes.prior_terciles_by_session(d, day="day", value="v").collect()}
    pdf = d.toPandas()
    assert got[dt.date(2024, 1, 6)] is None and abs(got[dt.date(2024, 1, 20)] - pdf[pdf.day < dt.date(2024, 1, 20)].v.quantile(.33)) <= 2


def test_newest_version_is_in_the_file_name(spark):
    d = spark.createDataFrame([("T", "a/2030-01-01/20240101T000000Z_x.json"), ("T", "a/2020-01-01/20250101T000000Z_y.json")], "t string, path string")
    assert snapshots.newest_versions(d, group=["t"], path="path").first()["path"].endswith("_y.json")


def test_append_is_idempotent_and_history_survives_bad_files(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "i int, s string")
    for _ in range(2):
        snapshots.append_content(d, str(tmp_path / "store"), columns=["i", "s"])
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "20240101T000000Z_a.json").write_text('{"t":"T","v":1.0}\n')
    (tmp_path / "h" / "20250101T000000Z_b.json").write_text('{"t":"T","v":2.0}\n{broken\n')
    schema = StructType.fromDDL("t string, v double")
    assert snapshots.read_history(spark, str(tmp_path / "h"), schema, max_bad_share=.5).count() == 2
    with pytest.raises(ValueError):
        snapshots.read_history(spark, str(tmp_path / "h"), schema)
    newest = snapshots.read_newest(spark, str(tmp_path / "h"), schema, group=["t"]).collect()
    assert [r["v"] for r in newest if r["v"] is not None] == [2.0]


def test_dynamic_partitions_and_runs(spark, tmp_path):
    d = spark.createDataFrame([("A", "2024-01-01", 1.0), ("B", "2024-01-01", 2.0)], "ticker string, day string, v double")
    path = str(tmp_path / "s")
    results.write_store(d, path, partitions=["ticker", "day"])
    results.write_store(d.filter("ticker = 'A'").withColumn("v", F.lit(9.0)), path, partitions=["ticker", "day"])
    assert {r["ticker"]: r["v"] for r in spark.read.parquet(path).collect()} == {"A": 9.0, "B": 2.0}
    for run in ("r1", "r2"):
        results.append_run(d, str(tmp_path / "runs"), run_id=run)
    assert {r["run_id"] for r in results.latest_run(spark, str(tmp_path / "runs")).collect()} == {"r2"}


def test_inventory_and_gate(spark):
    d = spark.createDataFrame([("market-data/v5/gpu-news-agent/receipts/NVDA/2025/2025-01-01_2025-01-31.json", 5, dt.datetime(2025, 2, 1)), ("x/y", 1, dt.datetime(2025, 2, 1))],
                              "key string, size long, last_modified timestamp")
    r = inventory.classify(d).filter("dataset is not null").collect()
    assert [(x["dataset"], x["ticker"], len(x["days"])) for x in r] == [("news_coverage", "NVDA", 2)]
    ready = inventory.readiness(inventory.summarise(inventory.classify(d)), companies=["NVDA"], end="2025-01-31")
    g = inventory.gate(ready).first()
    assert ready.count() == 22 and not g["training_ready"] and g["blocker_count"] > 0
    states = {x["id"]: x["state"] for x in ready.collect()}
    assert states["option_quotes"] == "uitgesteld" and states["stock_minute"] == "ontbreekt" and states["news_coverage"] == "gedeeltelijk"


def test_values_known_only_later_stop_an_evaluation(spark):
    from tidemark.operators import audits, research
    d = spark.range(200).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 7 / 100.0).alias("ret"), F.lit(0.001).alias("cost"))
    d = d.withColumns({"label_end": F.date_add("day", 1), "month": F.date_trunc("month", "day"), "known": F.when(F.dayofmonth("day") == 9, F.date_add("day", 2)).otherwise(F.col("day"))})
    settings = {"target": "ret", "cost": "cost", "day": "day", "label_end": "label_end", "order": ["day"], "bucket": "month"}
    base = research.Candidate("base", (), "historical_mean")
    with pytest.raises(audits.LeakageError):
        research.evaluate(d, base, available=("known",), **settings)
    metrics, made = research.evaluate(d.withColumn("rough", F.dayofmonth("day") == 3), base, open_holdout=True, walk=False, provisional="rough", **settings)
    assert [(r["part"], r["costs_provisional"]) for r in metrics.collect()] == [("holdout", True)] and made.select("fold").distinct().count() == 1
