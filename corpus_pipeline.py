"""From raw documents to packed training sequences: toxicity, near-duplicates, leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first
four return the columns of documents; the last returns the packed pieces. Texts
may have any length in each; repeated rows are rows of their own but where a stage says
otherwise; an empty table gives an empty result; columns beyond those of documents are
kept as they are by the first four, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, packing, secret_scan, simhash, toxicity
from quern.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go.

    Null and empty texts hold no evidence and stay; null ids are scored like others; repeated rows go or stay together.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null and empty texts have one fingerprint and are a group; rows without an id stay; of rows with an equal id and
    text one stays.
    """
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as do all where the benchmark is empty; null ids are searched like others.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays.

    Null texts stay null; overlapping secrets become one mark; n_chars is that of the new text where something was masked.
    """
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 ids.

    Null and empty texts are one end id; of ties any order gives the same rows; other columns are left aside.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No SQL expresses these stages; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs)
    return docs
