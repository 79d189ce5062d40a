"""Market regimes from what was known at the time."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running_sum
from tidemark.schema import truth
from tidemark.session import cut

# Sector of each ticker, trend limits, tercile marks and their fall-backs.
SECTORS = {
    "NVDA": "Technology", "AMD": "Technology", "AVGO": "Technology", "AAPL": "Technology", "MSFT": "Technology",
    "GOOGL": "Communication", "META": "Communication", "AMZN": "Consumer Discretionary", "TSLA": "Consumer Discretionary",
    "JPM": "Financials", "BAC": "Financials", "GS": "Financials", "LLY": "Health Care", "UNH": "Health Care",
    "XOM": "Energy", "CVX": "Energy", "CAT": "Industrials", "BA": "Industrials", "WMT": "Consumer Staples",
    "COST": "Consumer Staples", "SPY": "Broad Market", "QQQ": "Broad Market",
}
TREND = 0.01
LOW_MARK, HIGH_MARK, MIN_HISTORY = 0.33, 0.67, 30
LOW_FALLBACK, HIGH_FALLBACK = 0.30, 0.70
SKETCH_K = 4096


def prior_terciles(rows: DataFrame, *, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Exact expanding 33/67% marks of the rows before each row, per key.

    A key is one ticker, whose sessions the calendar bounds to a few thousand; without
    such a key use ``prior_terciles_over_all``, or a sketch by ``prior_terciles_by_session``.
    """
    past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("_marks", F.when(F.count(value).over(past) >= MIN_HISTORY, F.percentile(value, F.array(F.lit(LOW_MARK), F.lit(HIGH_MARK))).over(past)))
    return d.withColumns({"_low": F.col("_marks")[0], "_high": F.col("_marks")[1]}).drop("_marks")


#: Values of a block of the time order at least; the size grows with the root of the rows.
LEAST_BLOCK = 512
_FAN = 64


def prior_terciles_over_all(rows: DataFrame, *, bucket: str, order: list[str], value: str, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Exact expanding 33/67% marks of all rows before each row, over one order of the whole table.

    The order is cut into blocks of about the square root of all values, and the values
    into as many ranges.  Counts by block and range say in which ranges the wanted order
    statistics of everything before a block lie; as a block moves a rank by no more than
    its own size, it needs about as many earlier values around each mark as it has itself.
    They go to the block with its own values, and one task runs through both.  No task and
    no window holds more than a block, a range or one count for each of them.  ``bucket``
    must not decrease in ``order``, which must be total.
    """
    d = running_sum(rows.withColumn("_one", F.col(value).isNotNull().cast("long")), keys=[], bucket=bucket, order=order, value="_one", out="_n")
    d = cut(d.withColumn("_n", F.col("_n") - F.col("_one")).drop("_one"))
    values = d.filter(F.col(value).isNotNull()).select("_n", F.col(value).cast("double").alias("value"))
    total = values.count()
    size = max(least_block, math.isqrt(total))
    blocks = -(-total // size) if total else 0
    located = values.select((F.col("_n") / size).cast("long").alias("block"), "_n", "value", F.lit(0).cast("long").alias("range"))
    for _ in range(max(1, math.ceil(math.log(max(blocks, 2), _FAN)))):
        edges = located.groupBy("range").agg(F.percentile_approx("value", F.array(*[F.lit(i / _FAN) for i in range(1, _FAN)]), F.lit(2000)).alias("edges"))
        located = located.join(edges, "range").select("block", "_n", "value", (F.col("range") * _FAN + F.size(F.filter("edges", lambda e: e < F.col("value")))).alias("range"))
    located = cut(located)
    cells = located.groupBy("range", "block").agg(F.count(F.lit(1)).alias("n"))
    grid = located.select("range").distinct().select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long"))).alias("block"))
    earlier = F.sum("n").over(Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.join(cells, ["range", "block"], "left").select("range", "block", F.coalesce(earlier, F.lit(0)).alias("before"))
    below = F.sum("before").over(Window.partitionBy("block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("below", F.coalesce(below, F.lit(0)))
    start = F.col("block") * size
    marks = F.explode(F.array(*[F.struct(F.lit(i).alias("mark"), F.greatest(F.floor(F.lit(q) * (start - 1)) - size, F.lit(0)).alias("first"),
                                         F.least(F.ceil(F.lit(q) * (start + size)) + 1, start).alias("last")) for i, q in enumerate((LOW_MARK, HIGH_MARK))]))
    wanted = grid.select("range", "block", "before", "below", marks.alias("w")).select("range", "block", "below", "w.*").filter(
        (F.col("before") > 0) & (F.col("below") <= F.col("last")) & (F.col("below") + F.col("before") > F.col("first")))
    folded = located.groupBy("range", "value", F.col("block").alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    known = folded.join(wanted, "range").filter(F.col("_of") < F.col("block")).groupBy("block", "mark", "value", "first", "last").agg(
        F.sum("n").alias("n"), F.min("below").alias("below"))
    known = known.select(*[F.col(c).alias(c) for c in known.columns])  # columns of their own, for the cogroup

    def run(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_n")
        out = pd.DataFrame({"_n": own["_n"], "_low": np.nan, "_high": np.nan})
        for mark, (name, q) in enumerate((("_low", LOW_MARK), ("_high", HIGH_MARK))):
            part = before[before["mark"] == mark].sort_values("value")
            held, first = [], 0
            if len(part):
                first, last = int(part["first"].iloc[0]), int(part["last"].iloc[0])
                ends = int(part["below"].min()) + part["n"].cumsum().to_numpy()
                copies = np.clip(ends, first, last + 1) - np.clip(ends - part["n"].to_numpy(), first, last + 1)
                held = np.repeat(part["value"].to_numpy(), copies).tolist()
            found = []
            for n, x in zip(own["_n"].tolist(), own["value"].tolist()):
                if n >= MIN_HISTORY:
                    place = q * (n - 1)
                    at = int(place)
                    a = held[at - first]
                    found.append(a if place == at else a + (held[at + 1 - first] - a) * (place - at))
                else:
                    found.append(None)
                insort(held, x)
            out[name] = pd.array(found, dtype="Float64")
        return out
    found = located.select("block", "_n", "value").groupBy("block").cogroup(known.groupBy("block")).applyInPandas(run, "_n long, _low double, _high double")
    if not total:
        found = found.limit(0)
    # A row without a value has as many values before it as the next one with a value; after the last value the marks are of all values.
    tail = {f"_{n}": q for n, q in (("low", LOW_MARK), ("high", HIGH_MARK))}
    whole = values.agg(*[F.when(F.count("value") >= MIN_HISTORY, F.percentile("value", F.lit(q))).alias(n) for n, q in tail.items()]).select(F.lit(total).cast("long").alias("_n"), *tail) \
        if d.filter((F.col("_n") == total) & F.col(value).isNull()).take(1) else found.limit(0)
    return d.join(found.unionByName(whole), "_n", "left").drop("_n")


def prior_terciles_by_session(rows: DataFrame, *, day: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """Approximate marks of all earlier *sessions* over all tickers.

    One quantile sketch per session (rank error about 1/k), merged along the
    calendar; no task sees more than sketches.
    """
    daily = rows.groupBy(day).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("_s"), F.count(value).alias("_n"))
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    merged = daily.select(day, F.kll_merge_agg_double("_s", F.lit(k)).over(w).alias("_m"), F.sum("_n").over(w).alias("_before"))
    known = F.col("_before") >= MIN_HISTORY
    marks = merged.select(
        day, F.when(known, F.kll_sketch_get_quantile_double("_m", F.lit(LOW_MARK))).alias("_low"),
        F.when(known, F.kll_sketch_get_quantile_double("_m", F.lit(HIGH_MARK))).alias("_high"))
    return rows.join(marks, day, "left")


def assign(rows: DataFrame, *, ticker: str, trend: str, volatility: str, earnings_today: str, news_count: str,
           sectors: dict[str, str] | None = None) -> DataFrame:
    """Sector, trend, volatility and event regime; needs ``_low``/``_high`` marks."""
    table = F.create_map(*[F.lit(x) for kv in (sectors or SECTORS).items() for x in kv])
    v = F.col(volatility)
    return rows.withColumns({
        "sector": F.coalesce(F.try_element_at(table, F.upper(F.col(ticker).cast("string"))), F.lit("Unknown")),
        "market_regime": F.when(F.col(trend) >= TREND, "bull").when(F.col(trend) <= -TREND, "bear").otherwise("sideways"),
        "volatility_regime": F.when(truth(v <= F.coalesce("_low", F.lit(LOW_FALLBACK))), "low")
                              .when(truth(v >= F.coalesce("_high", F.lit(HIGH_FALLBACK))), "high").otherwise("medium"),
        "event_type": F.when(F.coalesce(earnings_today, F.lit(0.0)) > 0, "earnings")
                       .when(F.coalesce(news_count, F.lit(0.0)) > 0, "news").otherwise("none"),
    }).drop("_low", "_high")
