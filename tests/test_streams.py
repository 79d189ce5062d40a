"""The streams give what the same job gives over all rows at once."""
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no smoke tables")


@pytest.mark.parametrize("name", ["stream_trade_minute", "stream_news_sliding", "stream_dedup", "stream_latest_state", "stream_settle"])
def test_stream_agrees_with_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    frame = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_monitor_stream_covers_every_row(spark):
    out = entry.queries()["stream_monitor"](spark, FOLDER).collect()
    assert sum(r["rows"] for r in out) == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_stream_reads_a_table_of_one_file_or_of_part_files(spark, tmp_path, parts):
    rows = pa.table({"doc_id": list(range(400)), "n_chars": [7 * n for n in range(400)]})
    if parts:
        (tmp_path / "documents.parquet").mkdir()
    for n in range(max(parts, 1)):
        pq.write_table(rows.take(list(range(n, 400, max(parts, 1)))), tmp_path / "documents.parquet" / f"part-{n}.parquet" if parts else tmp_path / "documents.parquet")
    pq.write_table(rows, tmp_path / "other.parquet")  # another table of the folder is not read
    got = [tuple(r) for r in entry.queries()["stream_news_sliding"](spark, str(tmp_path)).collect()]
    import duckdb
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.register("documents", rows)
    cur = con.execute(entry.oracle_sql()["stream_news_sliding"])
    names = [d[0] for d in cur.description]
    assert got and rows_of(names, got) == rows_of(names, cur.fetchall())
