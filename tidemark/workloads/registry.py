"""Registry of runnable queries: a Spark callable and, where SQL can state the
same result, the SQL text that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare


@dataclass(frozen=True)
class Workload:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


WORKLOADS: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None):
    def register(build: Callable[["Tables"], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(prepare(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in WORKLOADS:
            raise ValueError(f"{name} is registered twice")
        WORKLOADS[name] = Workload(name, run, sql)
        return build
    return register


class Tables:
    """Lazy access to the parquet tables of one folder, normalised at the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        from tidemark.schema import scan
        return scan(self.raw(name))
