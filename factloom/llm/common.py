"""Helpers shared by the training-data operators: text columns, free column names, batch sizes, tokenizer files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import Workspace, shared_root

__all__ = ["Workspace", "block_batches", "fresh_name", "shared_root", "small_batches", "table", "tokenizer_spec"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows that Spark hands a Python worker at once, so that long texts don't add up.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``ARROW_ROWS`` for the jobs that follow; never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextmanager
def block_batches(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """A few rows at once for the jobs run inside, where a row is a block of some megabytes; the session's batch size is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tokenizer_spec(path: str | None = None) -> str:
    """The text of a tokenizer file; by default the public 49k word vocabulary of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
