"""Registered queries: naming, plans, and agreement with SQL on the smoke tables."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no smoke tables")
JVM_ONLY = ("rolling_stats", "macd", "asof_backward", "asof_nearest", "news_rolling_asof", "multi_horizon_intraday", "trade_minute", "bs_valuation", "pair_join",
            "lexicon_score", "risk_decision", "summary9", "earn_pit_features", "attention_pool")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 120


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", ["rolling_stats", "asof_backward", "pair_join", "earn_pit_features", "risk_decision", "event_histogram"])
def test_agrees_with_sql(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", JVM_ONLY)
def test_hot_plans(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "ArrowEvalPython", "BatchEvalPython", "InPandas"):
        assert word not in plan, word
