"""A corpus pipeline: quality filter, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last give the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import packing, quality, secrets, simhash
from lectern.llm.queries import BYTE_BPE, table
from lectern.llm.shared import discard, materialise, release


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; learns from the labels of the documents it is given."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingle similarity of 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each found secret in its text replaced by a mark; n_chars counts the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    return packing.pack(docs, BYTE_BPE, with_ids=False)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what each gives is a table in the shared folder until the next is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
