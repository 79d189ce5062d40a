"""The corpus queries and the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, chat, filteraudit, language, nearvec, packing, pii, pitmanyor, quality, sampling, simhash, topk, toxicity
from tidemark.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(table(spark, sf_dir, "embeddings"))


def op6_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.query(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.query(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(table(spark, sf_dir, "documents"))


def op10_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.query(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_simhash, op4_quality, op5_topk, op6_sampling, op7_packing, op8_pitman_yor, op9_language, op10_near_embeddings, op11_filter_audit, op12_chat, op13_alignment)}
SQL: dict[str, str] = {"op5_topk": topk.SQL, "op10_near_embeddings": nearvec.SQL, "op11_filter_audit": filteraudit.SQL, "op12_chat": chat.SQL}
