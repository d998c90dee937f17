"""A training corpus from raw documents: toxic ones out, one of each group of near copies, no benchmark passages, secrets masked, encoded.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last returns one
row of token digests for each document that is left. Between stages documents are written as Parquet and read again.

A null text is the empty text: it is scored, is a copy of nothing, holds nothing, and is encoded to no ids. A null doc_id keeps its row
through every stage. Of rows that share a doc_id and a text one stays; where a doc_id has several texts each is a document of its
own. Of equal documents the one with the smallest doc_id stays; a score of exactly 0.5 is toxic. Without any labels, or without toxic ones, every
document passes the first stage; with toxic ones alone none does. An empty table gives no rows. Further columns are carried along, whatever they are called; helper
columns take names that are free. Texts are handled whole, a very long one in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from factloom.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, fitted on the labelled documents of its input; scores of 0.5 and more go."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    if not model[0].any() and model[1] == 0:  # no labels at all: nothing is known to be toxic
        return docs
    scored = toxicity.score(docs, model, name="toxicity")
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 over five-word shingles; the smallest doc_id of a group stays."""
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; secrets are masked, every document stays."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: ids and decoded text of each document, as counts and digests."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("encode", encode),
]

#: Hashing, a fitted classifier and a tokenizer are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
