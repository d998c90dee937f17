"""Operator 5: token ids in files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the low chunk of every id; a continuation bitmap tells
which ids go on, and a rank directory (ones before each 512 bits) tells where they go on in the next level.
So any token is read by address, without decoding a block.

Documents are range-partitioned and sorted by key, then a hash of their text (so that rows of one key, null keys
too, go to several tasks), encoded in their partition and written as files of at most about ``FILE_IDS`` ids in the
shared folder: null keys first, then ascending; each row is written once. Null text is the empty text and
has the end id alone. A file is written under its attempt's own name, and only the files whose task finished are
in the file list, so lost executors leave no wrong files. The file list is a table with a row for a file.
Repeated rows are written one after another; an empty table writes no files and gives no rows. Only the key and the text are read, whatever
other columns are called. A very long text is encoded in a slice of its own and may fill a file alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, small_batches, table, tokenizer_spec
from .tokenizer import encoder
from .words import slices

END_ID = 1
FILE_IDS = 1 << 23
_MAGIC = b"DACFILE1"
_BLOCK = 64  # bytes of bitmap for each entry of the rank directory


def _levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level."""
    out = []
    while True:
        more = ids > 255
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bitmap).astype(np.uint64), np.arange(0, len(bitmap), _BLOCK)) if len(bitmap) else np.zeros(0, np.uint64)
        out.append(((ids & 255).astype(np.uint8), bitmap, (np.cumsum(ones) - ones).astype("<u8")))
        if not more.any():
            return out
        ids = ids[more] >> 8


def to_bytes(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The parts of a file: magic; number of documents, ids and levels; keys (two rows: value, is null); starts; level sizes; levels."""
    levels = _levels(ids)
    head = np.array([keys.shape[1], len(ids), len(levels)], "<i8")
    sizes = np.array([[len(c), len(b), len(r)] for c, b, r in levels], "<i8")
    return [_MAGIC, head.tobytes(), keys.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), sizes.tobytes(), *(x.tobytes() for level in levels for x in level)]


class TokenFile:
    """A token file in memory or memory-mapped: ``keys``, ``starts``, ``token(i)``, ``ids()``."""

    def __init__(self, data):
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a token file")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.n_docs, self.n_ids, n_levels = take("<i8", 3).tolist()
        self.keys = take("<i8", 2 * self.n_docs).reshape(2, self.n_docs)
        self.starts = take("<i8", self.n_docs + 1)
        sizes = take("<i8", 3 * n_levels).reshape(-1, 3).tolist()
        self.levels = [(take("u1", c), take("u1", b), take("<u8", r)) for c, b, r in sizes]

    def token(self, i: int) -> int:
        """The i-th id of the file, read by address."""
        out = shift = 0
        for chunks, bitmap, ranks in self.levels:
            out |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                return out
            block = byte // _BLOCK
            whole = int(np.bitwise_count(bitmap[block * _BLOCK : byte]).sum())
            i = int(ranks[block]) + whole + int(bitmap[byte] & ((1 << bit) - 1)).bit_count()
            shift += 8
        return out

    def ids(self) -> np.ndarray:
        out: np.ndarray | None = None
        for chunks, bitmap, _ in reversed(self.levels):
            level = chunks.astype("<u4")
            if out is not None:
                level[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= out << np.uint32(8)
            out = level
        return out


def write(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, engine: str = "library") -> DataFrame:
    """Write the files below ``root`` (a URI that pyarrow opens). Rows: file, first_key, part, piece, n_docs, n_ids."""
    small_batches(docs.sparkSession)
    spec = tokenizer_spec(tokenizer)
    pafs.FileSystem.from_uri(root)[0].create_dir(pafs.FileSystem.from_uri(root)[1], recursive=True)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(spec, engine)
        fs, folder = pafs.FileSystem.from_uri(root)
        part, piece = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            names = pa.chunked_array(keys)
            known = np.stack([names.fill_null(0).to_numpy(), names.is_null().to_numpy().astype(np.int64)])
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            name = f"{part:06d}-{piece:04d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{folder}/{name}") as f:
                for x in to_bytes(np.concatenate(held), known, starts):
                    f.write(x)
            row = {"file": f"{root}/{name}", "first_key": names[0].as_py(), "part": part, "piece": piece, "n_docs": len(names), "n_ids": int(starts[-1])}
            return pa.RecordBatch.from_pylist([row], pa.schema({"file": pa.string(), "first_key": pa.int64(), "part": pa.int32(), "piece": pa.int32(), "n_docs": pa.int64(), "n_ids": pa.int64()}))

        for rows in slices(batches, 1, 3 << 22):
            ids, offsets = model.encode(rows[1])
            held.append(np.insert(ids, offsets[1:], END_ID))
            keys.append(rows[0])
            counts.append(np.diff(offsets) + 1)
            n += len(held[-1])
            if n >= FILE_IDS:
                yield flush()
                held, keys, counts, n, piece = [], [], [], 0, piece + 1
        if keys:
            yield flush()

    sorted_docs = docs.repartitionByRange("key", "mix").sortWithinPartitions("key", "mix").select("key", "text")
    return sorted_docs.mapInArrow(run, "file string, first_key long, part int, piece int, n_docs long, n_ids long")


def read(files: DataFrame) -> DataFrame:
    """Documents of the files in a file list: key, start (ids before it), n_tokens, ids."""
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks, "file").mapInArrow(_documents(crc=False), "key long, start long, n_tokens long, ids array<int>")


def read_digests(files: DataFrame) -> DataFrame:
    """As ``read``, with the CRC-32 of the ids (little-endian unsigned 32-bit integers) in place of the ids."""
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks, "file").mapInArrow(_documents(crc=True), "key long, start long, n_tokens long, ids_crc32 long")


def _documents(crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path) as f:
                    file = TokenFile(f.readall())
                ids = file.ids()
                keys = pa.array(file.keys[0], pa.int64(), mask=file.keys[1].astype(bool))
                starts = file.starts
                if crc:
                    data = memoryview(ids.astype("<u4").tobytes())
                    at = (starts * 4).tolist()
                    last = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), last], names=["key", "start", "n_tokens", "ids_crc32" if crc else "ids"])

    return run


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op5")
    files = space.save(write(table(spark, sf_dir, "documents"), space.path("ids")), "files")
    return read_digests(files).withColumnRenamed("key", "doc_id")
