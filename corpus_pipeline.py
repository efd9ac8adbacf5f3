"""A corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, langid, neardup, packing, secrets
from tidemill.llm._spark import shared_folder, table, unused


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; those without a letter or a text go.

    The predicted language replaces ``lang``, also where that was null. Repeated rows are
    rows of their own, an empty table stays empty, no other column is touched.
    """
    predicted, scored = unused(docs, "lang_pred"), unused(docs, "score")
    found = langid.identify(docs, langid.learn(docs), predicted, scored).where(F.col(predicted) != "und")
    return found.withColumn("lang", F.col(predicted)).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Null texts, ties, repeated rows and clashing names are as ``neardup.keep_one`` says.
    """
    return neardup.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``; those that are mostly benchmark go.

    Null and empty texts, repeated rows and other columns stay as they are; with an empty
    table on either side nothing changes.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by its kind.

    Null and empty texts, repeated rows and other columns stay as they are.
    """
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens.

    Null texts are empty: their one id ends them. Repeated rows are packed each, an empty
    table gives no rows, and columns other than doc_id and text are left out.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("decontamination", no_benchmark),
    ("secret_scan", no_secrets),
    ("packing", packed),
]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
