"""What a run used of what there was: rows counted while they pass, not by another pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare

SCHEMA = "stage string, rows long, usable long, first_day date, last_day date"


class Usage:
    """Stages of one run.  ``watch`` counts a frame's rows when a later action runs it once.

    Frames should belong to a session of their own (``observing``): in this version of Spark
    a session that has observed cannot ship MLlib models with training summaries.
    """

    def __init__(self):
        self.stages: list[tuple[str, Observation]] = []

    def watch(self, frame: DataFrame, stage: str, *, day: str, usable: Column | None = None) -> DataFrame:
        """The same frame; ``usable`` says which of its rows the next stage may take."""
        seen = Observation(f"{len(self.stages)}-{stage}")
        self.stages.append((stage, seen))
        return frame.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))).alias("usable"),
                             F.min(F.col(day).cast("date")).alias("first_day"), F.max(F.col(day).cast("date")).alias("last_day"))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a stage, after the run: what came in, what was usable, over which days."""
        rows = [(stage, *(seen.get[c] for c in ("rows", "usable", "first_day", "last_day"))) for stage, seen in self.stages]
        return spark.createDataFrame(rows, SCHEMA)


def observing(spark: SparkSession) -> SparkSession:
    """A session for watched frames; it shares the context and the catalog with ``spark``."""
    return prepare(spark.newSession())


def usage_report(stages: DataFrame, catalog: DataFrame, *, ticker: str, day: str, used: str, eligible: str) -> DataFrame:
    """Catalogued ticker-days, eligible and used rows, and whether a cap took some away.

    ``eligible`` and ``used`` name stages; a cap is what is missing between them.
    """
    days = catalog.select(ticker, day).distinct().agg(F.count(F.lit(1)).alias("catalog_ticker_days"))
    of = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))
    g = stages.agg(of(eligible, "rows").alias("loaded_rows"), of(eligible, "usable").alias("eligible_rows"), of(used, "rows").alias("used_rows"), of(used, "first_day").alias("first_day"), of(used, "last_day").alias("last_day"))
    return g.withColumns({"capped_rows": F.col("eligible_rows") - F.col("used_rows"), "hidden_row_cap_applied": F.col("eligible_rows") > F.col("used_rows"),
                          "catalog_ticker_days": days.scalar()})
