"""Operator 11: importance resampling of documents towards a target by hashed n-grams.

1. Tasks count each document's runs of 1 to 3 words by bucket and write the document-by-bucket matrix as CSR blocks (some 2 MB of text each, whole
   documents): offsets of the rows, then bucket and count of each entry. A bucket is the CRC-32 of the feature's bytes modulo the number
   of buckets; the checksum of a run comes from those of its words (``crc.Shift``), so a feature's string is never made.
2. Column sums of the blocks are the corpus's distribution, those of the target's features the wanted one; a bucket's gain is their
   log ratio, smoothed by one. Sums and gains are one number a bucket.
3. The blocks times the gains are the documents' weights. Gumbel noise from a hash of the id turns the best scores into a draw without replacement.
4. Ranks come from range partitions and their offsets, so no task sorts the corpus. Documents with fewer than ``min_words`` words aren't drawn.

A null text has no words; a document without features has weight 0. A row without an id is scored with an empty id and goes first among
equal scores. Repeated rows are documents of their own with equal scores, and take ranks one after another. Ties go to the smaller id. An
empty table gives no rows; an empty target has a count of 0 in every bucket. Only the key and the text are read, whatever other columns are called. A
row of the matrix has at most one entry a bucket, however long its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import numbered
from .common import Workspace, block_batches, small_batches, table
from .crc import Shift
from .words import Words, alphanumeric, slices

BUCKETS, LONGEST, SMOOTHING = 10_000, 3, 10_000
BLOCK_BYTES = 1 << 21
_CODEC = pa.Codec("zstd", compression_level=1)


@dataclass
class Block:
    """CSR: entries ``offsets[i]`` to ``offsets[i + 1]`` are row i's buckets and counts."""

    offsets: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray

    def packed(self) -> bytes:
        head = np.array([len(self.offsets), len(self.buckets)], "<i8")
        raw = b"".join(x.tobytes() for x in (head, self.offsets.astype("<i8"), self.buckets.astype("<u4"), self.counts.astype("<u4")))
        return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        raw = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16 + 8 * n
        return cls(np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<u4", m, at), np.frombuffer(raw, "<u4", m, at + 4 * m))

    def times(self, gains: np.ndarray) -> np.ndarray:
        """The matrix-vector product, exact in 64 bits."""
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts * gains[self.buckets])])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


_SHIFT = None


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, row of each feature, bucket of each feature), all runs of 1 to ``longest`` words."""
    global _SHIFT
    _SHIFT = _SHIFT or Shift()
    words = Words(alphanumeric(texts), lower=False)
    known = [w.encode() for w in words.dictionary.to_pylist()]
    alone = np.array([zlib.crc32(w) for w in known], np.uint32)[words.codes]
    after = np.array([zlib.crc32(b" " + w) for w in known], np.uint32)[words.codes]
    size = np.array([1 + len(w) for w in known], np.int64)[words.codes]
    row = np.repeat(np.arange(len(texts)), words.counts())
    rows, crcs, now = [row], [alone], alone
    for k in range(1, longest):
        now = _SHIFT(now[: max(len(alone) - k, 0)], size[k:]) ^ after[k:]
        inside = row[: len(now)] == row[k:]
        rows.append(row[: len(now)][inside])
        crcs.append(now[inside])
    return words, np.concatenate(rows), np.concatenate(crcs) % np.uint32(buckets)


def _block(rows: np.ndarray, at: np.ndarray, n: int, buckets: int) -> Block:
    keys, counts = np.unique(rows.astype(np.int64) * buckets + at, return_counts=True)
    return Block(np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) * buckets), keys % buckets, counts)


def matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(ids array, words array, block binary): the document-by-bucket matrix in CSR blocks."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, BLOCK_BYTES):
            words, rows, at = features(part[1], longest, buckets)
            block = _block(rows, at, part.num_rows, buckets)
            one = pa.array([0, part.num_rows], pa.int32())
            ids, counts = (pa.ListArray.from_arrays(one, x) for x in (part[0], pa.array(words.counts().astype(np.int64))))
            yield pa.RecordBatch.from_arrays([ids, counts, pa.array([block.packed()], pa.binary())], names=["ids", "words", "block"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "ids array<long>, words array<long>, block binary")


def _sums(frame: DataFrame, counts, buckets: int) -> DataFrame:
    """(bucket, n): a task adds its batches up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in counts(batch):
                total += np.bincount(at, n, buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return frame.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the matrix's columns that have entries."""

    def counts(batch: pa.RecordBatch):
        for data in batch[0].to_pylist():
            b = Block.unpacked(data)
            yield b.buckets, b.counts

    return _sums(blocks.select("block"), counts, buckets)


def text_sums(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table of texts."""
    small_batches(texts.sparkSession)

    def counts(batch: pa.RecordBatch):
        for part in slices([batch], 0, BLOCK_BYTES):
            yield features(part[0], longest, buckets)[2], None

    return _sums(texts.select(text), counts, buckets)


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: int = SMOOTHING) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the log ratio of the target's share of the bucket and the corpus's, rounded down."""
    spark = corpus.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    totals = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for df in (corpus, target)]
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (F.lit(totals[0]) + smoothing) / ((s + 1) * (F.lit(totals[1]) + smoothing)))).cast("long").alias("gain"))


def weights(blocks: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of the matrix's rows; gain has a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch["words"].slice(k, 1).flatten().to_numpy()
                n = sum(np.maximum(words - j, 0) for j in range(longest))
                weight = Block.unpacked(batch["block"][k].as_py()).times(gain)
                yield pa.RecordBatch.from_arrays([batch["ids"].slice(k, 1).flatten(), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text); target (text).

    ``percent`` of the documents with at least ``min_words`` words are drawn and have a rank, from 1; the others have none.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "resample")
    blocks = space.save(matrix(docs, buckets=buckets), "blocks")
    wanted = space.save(text_sums(target, buckets=buckets), "target")
    with block_batches(spark):
        corpus = space.save(column_sums(blocks, buckets), "corpus")
        rows = gains(corpus, wanted, buckets).collect()  # one number a bucket
        gain = np.zeros(buckets, np.int64)
        gain[[r.bucket for r in rows]] = [r.gain for r in rows]
        weighed = space.save(weights(blocks, gain), "weights")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)
    may = scored.where(F.col("n_words") >= min_words).withColumn("down", -F.col("score"))
    placed = numbered(may, ["down", "doc_id"], "place", "of")
    ranked = placed.withColumn("rank", F.when(F.col("place") <= F.floor(F.lit(percent) * F.col("of") / 100), F.col("place")).cast("long"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
