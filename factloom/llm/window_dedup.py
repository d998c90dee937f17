"""Operator 13: words of repeated passages, found by count-min sketches of word windows and an exact second pass.

1. Documents are put in the order of their ids and cut into blocks of some 4 MB of text, so "starts earlier" is an earlier block or an
   earlier place in the block. Blocks are numbered in that order and written once, compressed.
2. Sketch. A block counts its windows in a count-min sketch of two lines of counters. Counters are cut into shards; a block sends each
   shard the counters it uses, with 1 or "2 and more". The shard merges the blocks' sketches by adding them up and answers each
   block which of its counters reach 2. The number of shards grows with the text and a shard's size is fixed, so the sketch is never held,
   sent or broadcast as a whole, and is as selective at any size.
3. Exact. A window whose counters all reach 2 is estimated repeated; every window that does repeat is, as counters never fall short. Of these,
   and of no others, a block sends the 96-bit hash of each distinct one (its first place in the block) to the hash's shard, which answers
   which of them an earlier block has. Sorted counters and hashes are written as Elias-Fano lists.
4. A window that starts earlier somewhere marks its words; what isn't marked is kept.

A block sends a window once however often it holds it, so a passage of a third of all documents is one entry for each block of
4 MB. Windows are judged on the input, not on what is left. Two different windows among 10^13 share a 96-bit hash with probability 0.001.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null text, an empty one and one of fewer words than a window lose nothing. Rows that share a
doc_id are documents of their own in the order of their texts; rows without a doc_id come after all others. An empty table gives no rows.
Only the key and the text are read, whatever other columns are called. A very long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, block_batches, small_batches, table
from .words import Words, mix, slices

BLOCK_BYTES = 1 << 22
#: Bytes of text for a shard and counters that a shard has in each line: four for each window where words have five letters.
SHARD_BYTES, CELL_BITS = 12 << 20, 23
LINES = 2
_EXACT = LINES  # the answers of the exact pass stand after those of the sketch's lines
_LOW = np.uint64(0xFFFFFFFF)
_CODEC = pa.Codec("zstd", compression_level=1)


def packed(values: np.ndarray, top: int) -> bytes:
    """An Elias-Fano list of sorted 64-bit values below ``top``: low bits as they are, high bits in unary."""
    n = len(values)
    low = max((top // max(n, 1)).bit_length() - 1, 0)
    high = np.zeros((n + (top >> low) + 8) // 8, np.uint8)
    if n:
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
    raw = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : (low + 7) // 8]
    lows = np.packbits(np.unpackbits(np.ascontiguousarray(raw), axis=1, count=low, bitorder="little"), bitorder="little") if low and n else np.zeros(0, np.uint8)
    return np.array([n, low, len(lows)], "<i8").tobytes() + lows.tobytes() + (high.tobytes() if n else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, low, size = np.frombuffer(data, "<i8", 3).tolist()
    if not n:
        return np.zeros(0, np.uint64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=24 + size), bitorder="little"))[:n] - np.arange(n)
    out = np.zeros((n, 8), np.uint8)
    if low:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 24), count=n * low, bitorder="little").reshape(n, low)
        out[:, : (low + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u8").reshape(-1).astype(np.uint64) | (high.astype(np.uint64) << np.uint64(low))


def _write(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` codes, from hashes of runs of powers of two."""
    level, k, held, done = codes, 1, None, 0
    while True:
        if size & k:
            n = max(len(codes) - done - k + 1, 0)
            held = level if held is None else mix(held[:n], level[done : done + n])
            done += k
        if 2 * k > size:
            return held[: max(len(codes) - size + 1, 0)]
        n = max(len(level) - k, 0)
        level = mix(level[:n], level[k : k + n])
        k *= 2


class Windows:
    """Windows of a block in order: ``start`` (place of the first word among the block's words), ``one`` and ``two`` (hashes)."""

    def __init__(self, texts: pa.Array, size: int):
        self.words, self.size = Words(texts, lower=False), size
        known = b"".join(xxhash.xxh3_128_digest(w) for w in self.words.dictionary.to_pylist())
        lanes = np.frombuffer(known, "<u8").reshape(-1, 2)
        offsets = self.words.offsets
        n = np.maximum(np.diff(offsets) - size + 1, 0)
        ends = np.cumsum(n)
        self.start = np.repeat(offsets[:-1] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.one, self.two = (runs(lanes[:, k][self.words.codes], size)[self.start] for k in range(2))

    def cells(self, line: int, shards: int) -> np.ndarray:
        """The counter of each window in a line of the sketch; the shard's number stands in the bits from CELL_BITS on."""
        x = mix(self.one, line + 1)
        shard = (x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        return shard << np.uint64(CELL_BITS) | x & np.uint64((1 << CELL_BITS) - 1)

    def repeated(self, answers: dict[tuple[int, int], np.ndarray], shards: int) -> np.ndarray:
        """Places (in order) of the windows that the merged sketch counts twice and more."""
        likely = np.ones(len(self.one), bool)
        for line in range(LINES):
            cells, where = np.unique(self.cells(line, shards), return_inverse=True)
            heavy = _joined(answers, line, cells >> np.uint64(CELL_BITS))
            likely &= heavy[where]
        return np.flatnonzero(likely)


def _joined(answers: dict[tuple[int, int], np.ndarray], line: int, shard: np.ndarray) -> np.ndarray:
    """The shards' answers to a sorted list of entries, one after another."""
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    sizes = np.diff(np.r_[edges, len(shard)]) if len(shard) else []
    parts = [np.unpackbits(answers[line, int(shard[a])], count=int(n)).astype(bool) for a, n in zip(edges, sizes, strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _cut(values: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[a]), slice(int(a), int(b))


def _keys(windows: Windows, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the places by key and place, run of each, first of each run)."""
    one, two = windows.one[places], windows.two[places] & _LOW
    order = np.lexsort((two, one))  # stable: places of one key stay in order
    one, two = one[order], two[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _shard_of(one: np.ndarray, shards: int) -> np.ndarray:
    return (one >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def in_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, size, payload): documents in the order of their keys, in numbered blocks; size: bytes of text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.col("key").asc_nulls_last()
    dealt = rows.repartitionByRange(order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(slices(batches, 1, BLOCK_BYTES)):
            size = pc.sum(pc.binary_length(part[1])).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([size]), pa.array([_write(part)], pa.binary())], names=["block", "size", "payload"])

    return dealt.mapInArrow(run, "block long, size long, payload binary")


def sketches(blocks: DataFrame, size: int, shards: int) -> DataFrame:
    """(shard, line, block, cells): a block's sketch as the counters it uses in a shard; 2 * counter, and 1 more where it counts 2 and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch[0].to_pylist(), batch[1], strict=True):
                windows = Windows(_read(data.as_py())[1], size)
                for line in range(LINES):
                    cells, n = np.unique(windows.cells(line, shards), return_counts=True)
                    own = (cells & np.uint64((1 << CELL_BITS) - 1)) << np.uint64(1) | (n > 1).astype(np.uint64)
                    made = [(s, packed(own[part], 2 << CELL_BITS)) for s, part in _cut(own, cells >> np.uint64(CELL_BITS))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _ in made], pa.int64()), pa.array([line] * len(made), pa.int32()), pa.array([block] * len(made), pa.int64()), pa.array([c for _, c in made], pa.binary())],
                        names=["shard", "line", "block", "cells"],
                    )

    return blocks.select("block", "payload").mapInArrow(run, "shard long, line int, block long, cells binary")


def merged(sketch: DataFrame) -> DataFrame:
    """(block, line, shard, bits): for each block's counters, in order, whether the merged sketch counts 2 and more."""

    def merge(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << CELL_BITS, np.uint8)
        lists = [unpacked(c.as_py()) for c in rows["cells"]]
        for own in lists:  # counters end at 2, as nothing asks for more
            at = own >> np.uint64(1)
            total[at] = np.minimum(total[at] + 1 + (own & np.uint64(1)).astype(np.uint8), 2)
        bits = [np.packbits(total[own >> np.uint64(1)] >= 2).tobytes() for own in lists]
        return rows.select(["block", "line", "shard"]).append_column("bits", pa.array(bits, pa.binary()))

    return sketch.groupBy("shard", "line").applyInArrow(merge, "block long, line int, shard long, bits binary")


def _answers(rows: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    return {(line, shard): np.frombuffer(bits, np.uint8) for line, shard, bits in zip(*(rows[c].to_pylist() for c in ("line", "shard", "bits")), strict=True)}


def candidates(blocks: DataFrame, estimates: DataFrame, size: int, shards: int) -> DataFrame:
    """(shard, block, ones, twos): the hashes of a block's windows that are estimated repeated, each once, in order."""
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("ones", pa.binary()), ("twos", pa.binary())])

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for block, data in zip(left["block"].to_pylist(), left["payload"], strict=True):
            windows = Windows(_read(data.as_py())[1], size)
            places = windows.repeated(_answers(right), shards)
            order, _, first = _keys(windows, places)
            own = places[order[first]]
            one, two = windows.one[own], (windows.two[own] & _LOW).astype("<u4")
            out += [(s, block, packed(one[part], 1 << 64), two[part].tobytes()) for s, part in _cut(one, _shard_of(one, shards))]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return _with_answers(blocks, estimates).applyInArrow(made, "shard long, block long, ones binary, twos binary")


def _with_answers(blocks: DataFrame, answers: DataFrame):
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block"))


def earlier(entries: DataFrame) -> DataFrame:
    """(block, line, shard, bits): for each block's hashes, in order, whether an earlier block has them."""

    def told(rows: pa.Table) -> pa.Table:
        ones = [unpacked(x.as_py()) for x in rows["ones"]]
        sizes = [len(x) for x in ones]
        one, two = np.concatenate(ones), np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows["twos"]])
        block = np.repeat(rows["block"].to_numpy(), sizes)
        order = np.lexsort((block, two, one))
        a, b = one[order], two[order]
        late = np.zeros(len(one), bool)
        late[order] = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        bits = [np.packbits(x).tobytes() for x in np.split(late, np.cumsum(sizes)[:-1])]
        return pa.Table.from_arrays([rows["block"], pa.array([_EXACT] * len(rows), pa.int32()), rows["shard"], pa.array(bits, pa.binary())], names=["block", "line", "shard", "bits"])

    return entries.groupBy("shard").applyInArrow(told, "block long, line int, shard long, bits binary")


def without_repeats(blocks: DataFrame, answers: DataFrame, size: int, shards: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that no repeated window covers, joined by one space."""
    space = pa.scalar(" ")

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left["payload"]:
            batch, held = _read(data.as_py()), _answers(right)
            windows = Windows(batch[1], size)
            words = windows.words
            places = windows.repeated(held, shards)
            order, run, first = _keys(windows, places)
            late = _joined(held, _EXACT, _shard_of(windows.one[places[order[first]]], shards))[run]
            late |= np.arange(len(order)) != first[run] if len(order) else late
            start = windows.start[places[order[late]]]
            edge = np.bincount(start, minlength=len(words.codes) + 1) - np.bincount(start + size, minlength=len(words.codes) + 1)
            stays = np.cumsum(edge)[: len(words.codes)] == 0
            before = np.r_[0, np.cumsum(stays)][words.offsets]
            lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.dictionary.take(pa.array(words.codes[stays])))
            n = words.counts()
            out.append(pa.Table.from_arrays([batch[0], pa.array(n.astype(np.int64)), pa.array((n - np.diff(before)).astype(np.int64)), pc.binary_join(lists, space)], names=["doc_id", "n_words", "n_removed", "text"]))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]).empty_table()

    return _with_answers(blocks, answers).applyInArrow(kept, "doc_id long, n_words long, n_removed long, text string")


def dedup(docs: DataFrame, size: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text), a row for each row of docs: without each word that a window of ``size`` words covers which also starts earlier."""
    spark = docs.sparkSession
    space = Workspace(spark, "windows")
    blocks = space.save(in_blocks(docs, key, text), "blocks")
    space.settle()
    shards = (blocks.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES + 1
    with block_batches(spark):
        sketch = space.save(sketches(blocks, size, shards), "sketches")
    estimates = space.save(merged(sketch), "estimates")
    space.drop("sketches")
    entries = space.save(candidates(blocks, estimates, size, shards), "entries")
    space.settle()
    found = space.save(earlier(entries), "found")
    space.drop("entries")
    space.settle()
    return without_repeats(blocks, estimates.unionByName(found), size, shards)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
