"""Corpus pipeline: quality filter, exact dedup, near dedup, personal data,
packing. Each stage calls one operator of ``terrane.llm`` on all rows its
predecessor kept; its result is written as Parquet and read as the next
stage's documents.

Edge cases are those of the operators: null and empty texts are scored like
any text, equal texts keep one row, documents without words have no near
copies, and an empty table gives empty stages. Extra columns are dropped; a
stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import DOC_COLUMNS, documents, table
from terrane.llm.exact import drop_exact_copies
from terrane.llm.ngram_join import drop_near_copies
from terrane.llm.packing import pack_documents
from terrane.llm.pii import sanitise
from terrane.llm.quality import fit_quality, quality_scores
from terrane.llm.queries import BYTE_BPE
from terrane.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorisation machine accepts; it learns from
    the labelled rows among ``docs``."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return (quality_scores(docs.select(*DOC_COLUMNS), model)
            .filter(F.col("predicted") == 1).select(*DOC_COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, by the digest index."""
    return drop_exact_copies(docs.select(*DOC_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, by the n-gram join."""
    return drop_near_copies(docs.select(*DOC_COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced;
    n_chars follows the new text."""
    clean = sanitise(docs.select(*DOC_COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*DOC_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids."""
    return pack_documents(docs, BYTE_BPE)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier and tokenizers stand in the way of SQL for the whole;
#: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
