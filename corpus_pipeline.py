"""A corpus pipeline over ``documents``: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and calls one
operator. Between stages the rows are written as Parquet to the shared folder and read
again. All but the last return the columns of ``documents``, whatever further columns and
names there are; the last returns the pieces of the packed sequences.

Defined cases: rows with a null or letterless text go in the first stage, so the others meet
none; rows that repeat doc_id and text are one document after the second; a null doc_id or
source is a value like any other, but a row without doc_id links with nothing; an empty table
gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import language_id, mixing, ngram_join, packing, pii
from prosemill.llm.common import materialize, release

#: SQL cannot express language identification and packing; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language codes better than a code without one go; ``lang`` is set to the language found. Without any label, what has a letter stays."""
    return language_id.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 or more over five-word shingles the document with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; all rows stay."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, left out or cut as the target weights of their sources ask; rows that differ in any column count apart."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            release(spark)
    return docs
