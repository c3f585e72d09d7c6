"""A corpus pipeline over documents: language, near-duplicates, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared
folder and hands the reread table to the next. All stages but the last return the columns of documents. What a
stage staged on its way, and the table that it read, go once its own is written.

No rows give no rows. Rows that repeat are rows of their own, but for near-duplicates; ties don't arise, for each stage
decides by text, and by id where it says so. Columns beyond those of documents pass through.

Texts go to Python workers in small batches, for a worker serves one stage after another and keeps what it once took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.llm import decontaminate, language, mixing, near_dedup, secrets
from evalgrove.llm.common import Staged, scratch, small_batches, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a learned language, by its bits a character against labelled texts of like length.

    Null, empty and letterless texts go.
    """
    small_batches(spark)
    return language.with_language(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies.

    Rows without an id go if a row with one is like them, else one text of the group stays; rows equal in id and
    text stay or go together.
    """
    small_batches(spark)
    return near_dedup.first_of_copies(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of the benchmark occurs. Null and wordless texts stay."""
    small_batches(spark)
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text. Null texts stay null, with n_chars null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, numbered in column copy.

    A null source is one of its own; a null text has no words and weighs nothing.
    """
    return mixing.emit(docs, mixing.mix(docs))


STAGES = [
    ("language", by_language),
    ("near_dedup", one_of_near_copies),
    ("decontaminate", without_leaks),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: Neither cross-parsing nor MinHash can be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        keep: list[Staged] = []
        with scratch(keep):
            keep.append(Staged(stage(spark, docs, sf_dir), name))
        if before is not None:
            before.drop()
        before, docs = keep[0], keep[0].df
    return docs
