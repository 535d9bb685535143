"""A corpus from raw documents to packed training windows.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. Part of the training-data subpackage.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, mixing, packing, pii, simhash
from ledgerloom.llm.common import scratch, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language network rejects go: those without text or without a letter, which have no language.
    Rows without id or language are kept like any other, repeated rows too."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest id stays, a null id
    last. Texts without words are copies of each other; of rows that repeat id and text one stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; all rows stay, null and spanless texts unchanged."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it. Null is a source of its own, a text without words weighs
    nothing, rows alike in id and text are taken alike."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, one row per piece of a document; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL has neither the classifier nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage has settled on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(settle(stage(spark, docs, sf_dir), name))
    return docs
