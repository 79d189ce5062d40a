"""Landing with rejects, day splits with receipts, usage counts, folds by rows."""
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from tidemark.operators import research, splits
from tidemark.sources import snapshots, usage

SCHEMA = StructType([StructField("ticker", StringType()), StructField("day", DateType()), StructField("px", DoubleType())])


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    with gzip.open(folder / f"{name}.csv.gz", "wt") as out:
        out.write("\n".join(["ticker,day,px", *lines]) + "\n")


def test_rejects_are_kept_and_stop_the_job_when_many(spark, tmp_path):
    raw = tmp_path / "raw"
    write(raw, "a", [f"T{i % 3},2024-01-{1 + i % 4:02d},{i}.5" for i in range(40)])
    write(raw, "b", ["T1,2024-13-77,1.0", "T2,2024-01-02,abc", "T0,2024-01-09,7.0"])
    with pytest.raises(snapshots.TooManyRejects):
        snapshots.land_csv(spark, str(raw), SCHEMA, str(tmp_path / "no"), day=F.col("day"), stop_share=0.01)
    assert not (tmp_path / "no").exists()
    counts = snapshots.land_csv(spark, str(raw), SCHEMA, str(tmp_path / "out"), day=F.col("day"), stop_share=0.1).first()
    assert (counts["landed"], counts["rejected"]) == (41, 2)
    kept = spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()
    assert sorted(r["text"] for r in kept) == ["T1,2024-13-77,1.0", "T2,2024-01-02,abc"] and all("b.csv.gz" in r["file"] for r in kept)
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 41 and len(list((tmp_path / "out" / "rows").glob("day=*"))) == 5


def test_days_without_articles_are_verified_empty(spark, tmp_path):
    articles = spark.createDataFrame([("A", "2024-01-02 23:59:59", 1), ("A", "2024-01-03 00:00:00", 2), ("B", "2024-01-03 12:00:00", 3), ("B", None, 4), ("C", "2024-01-03 01:00:00", 5)],
                                     "ticker string, at string, id int").withColumn("at", F.to_timestamp("at"))
    plan = spark.createDataFrame([(k, d) for k in "AB" for d in ("2024-01-02", "2024-01-03", "2024-01-04")], "ticker string, day string").withColumn("day", F.to_date("day"))
    got = {(r["ticker"], str(r["day"])): (r["rows"], r["status"]) for r in snapshots.split_by_day(articles, plan, str(tmp_path / "n"), ticker="ticker", published="at").collect()}
    assert got == {("A", "2024-01-02"): (1, "stored"), ("A", "2024-01-03"): (1, "stored"), ("A", "2024-01-04"): (0, "verified_empty"),
                   ("B", "2024-01-02"): (0, "verified_empty"), ("B", "2024-01-03"): (1, "stored"), ("B", "2024-01-04"): (0, "verified_empty")}


def test_usage_tells_a_cap(spark, tmp_path):
    spark = usage.observing(spark)
    d = spark.range(100).select(F.lit("A").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("day"), "id")
    seen = usage.Usage()
    kept = seen.watch(d, "load", day="day", usable=F.col("id") >= 10).filter(F.col("id") >= 10).filter(F.col("id") < 60)
    seen.watch(kept, "use", day="day").write.parquet(str(tmp_path / "run"))
    row = usage.usage_report(seen.table(spark), d, ticker="ticker", day="day", eligible="load", used="use").first()
    assert (row["loaded_rows"], row["eligible_rows"], row["used_rows"], row["capped_rows"], row["hidden_row_cap_applied"], row["catalog_ticker_days"]) == (100, 90, 50, 40, True, 7)


@pytest.mark.parametrize("n", [0, 99, 100, 137, 1000])
def test_row_folds_are_those_of_the_rule(n):
    want, first = [], max(30, int(n * 0.4))
    width = max(20, (n - first) // 5)
    for start in range(first, n, width) if n >= 100 else ():
        stop = min(n, start + width)
        if start - 5 >= 30 and stop - start >= 10:
            want.append((start - 5, start, stop))
    assert splits.row_fold_ranges(n) == want[:5]


@pytest.mark.parametrize("binary", [True, False])
def test_more_dimensions_help_where_the_signal_is(spark, binary):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6))
    y = x[:, 4] + 0.1 * r.normal(size=400)
    rows = spark.createDataFrame([(int(i // 7), i, x[i].tolist(), float(y[i] > 0) if binary else float(y[i])) for i in range(400)], "day long, i long, v array<double>, y double")
    out = research.dimension_matrix(rows, vector="v", target="y", order=["day", "i"], bucket="day", sizes=(2, 6), binary=binary).toPandas()
    assert len(out) == 10 and set(out["n_train"]) == {f[0] for f in splits.row_fold_ranges(400)}
    name = "brier" if binary else "mae"
    mean = out.groupby("dimensions")[name].mean()
    assert mean[6] < 0.6 * mean[2]
