"""The corpus pipeline: documents through filters, deduplication, redaction and packing.

Every stage takes the documents that its predecessor kept, with the columns of
``documents``, and its decision takes effect: rejected rows are gone, near copies are
one row, personal data is replaced in the text, a sequence holds documents of one
recognised language.  ``run`` writes each stage's rows to the
shared folder before the next one starts, so a lost executor never repeats a stage.

Rows with a null text or doc_id pass through the stages like others: the quality score
of an empty text decides on it, no language is recognised in it, so it goes there.
Other columns of the input are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, packing, pii, quality, simhash
from tidemark.llm.common import cut, started, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of these documents."""
    docs = docs.select(*COLUMNS)
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, which becomes their ``lang``."""
    started(spark)
    return language.kept(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    started(spark)
    return simhash.representatives(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind."""
    started(spark)
    return pii.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their place in a sequence, which holds one language."""
    started(spark)
    return packing.packed(docs, apart="lang")


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_copies", drop_near_copies), ("redaction", redact), ("packing", pack)]

#: The learned stages have no SQL form; tests hold each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
