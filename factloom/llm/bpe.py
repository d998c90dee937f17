"""Operator 8: BPE encoding and decoding with a tokenization automaton.

The merges of a tokenizer file are compiled to integer tables (see ``tokenizer``). Texts are cut at ASCII white space and
pre-split by the file's rules; the distinct new pieces of a slice of texts are driven through the tables in lock-step, and ids
are gathered for all their places. The automaton is deterministic over tokens; over the symbols of a piece the open spellings are followed together. Decoding emits the arc labels of the ids. Row-local: no shuffle; memory is bounded by a
slice of 8 MB of text (or one text) and the pieces that an encoder remembers.

Null text is the empty text: no ids, empty decoded text. Repeated rows each give a row. An empty table gives
an empty table. Columns of the input other than the text and the key are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, small_batches, table, tokenizer_spec
from .tokenizer import encoder, forget
from .words import slices


def encode(docs: DataFrame, text: str = "text", tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns of docs and ``ids``, an array of the text's token ids. ``tokenizer``: path of the file."""
    small_batches(docs.sparkSession)
    spec, ids, at = tokenizer_spec(tokenizer), fresh_name(docs, ids), docs.columns.index(text)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec, "automaton")
        for part in slices(batches, at):
            flat, offsets = model.encode(part[at])
            arrays = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, arrays], names=[*part.schema.names, ids])
        del model
        forget()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", tokenizer: str | None = None, text: str = "decoded") -> DataFrame:
    """All columns of df and the decoded text of the ids (null ids: empty text)."""
    small_batches(df.sparkSession)
    spec, text = tokenizer_spec(tokenizer), fresh_name(df, text)
    schema = df.select("*", F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec, "automaton")
        for batch in batches:
            lists = batch[batch.schema.get_field_index(ids)]
            counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            texts = model.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass, of which only counts and SHA-256 digests leave the worker."""
    small_batches(docs.sparkSession)
    spec = tokenizer_spec(tokenizer)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def sha256(data: memoryview, offsets: np.ndarray) -> list[str]:
        return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec, "automaton")
        for part in slices(batches, 1):
            ids, offsets = model.encode(part[1])
            texts = model.decode(ids, offsets)
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2] or b"")
            yield pa.RecordBatch.from_arrays(
                [part[0], pa.array(np.diff(offsets)), pa.array(sha256(memoryview(ids.astype("<u4").tobytes()), offsets * 4)), pa.array(sha256(data, ends))],
                names=schema.names,
            )
        del model
        forget()

    return docs.mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
