"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import common, language, nearcopies, packing, suffixes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that no language profile fits go.

    Among these are NULL and empty texts and texts without a letter. A NULL id makes no difference; repeated rows all stay or all go; texts are judged
    whole; other columns stay as they are. An empty table stays empty.
    """
    return language.keep_identified(docs, language.train_profiles(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near copies the first document stays, by (id, md5 of the text).

    Of rows equal in id and text one stays; rows that share only the id are different documents. Rows with a NULL id or text and texts without a
    word stay. Texts are compared whole; other columns stay as they are. An empty table stays empty.
    """
    return nearcopies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each passage of 50 words or more that occurs again the first occurrence stays, by (id, md5 of the text, position).

    A document of which nothing is left goes. Rows with a NULL id or text stay. Rows that share only the id are different documents, rows
    equal in both are cut alike. Texts are read whole; n_chars follows the text, other columns stay. An empty table stays empty.
    """
    return suffixes.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: training sequences of token ids with the documents in each.

    Rows without id and NULL or empty texts are in none; a repeated row is packed again; long texts fill sequences of their own. An empty table
    gives no sequence.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash", near_duplicates),
    ("suffix_array", repeated_passages),
    ("packing", packed),
]

#: SQL can't express sum-of-squares packing; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
