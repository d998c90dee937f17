"""Arrow batches of texts as word codes: every step is one pass of a compiled kernel over many texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import xxh3

#: Text bytes handled at once by a task: enough that most of a slice's words repeat in it. A longer text is handled alone.
SLICE_BYTES = 1 << 23


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, dealt anew in runs of whole rows whose texts hold about ``most`` bytes (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most - size, side="right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Words:
    """``dictionary`` (distinct words), ``codes`` (a word's place in it), ``offsets`` (each text's first code, and the end)."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        encoded = lists.flatten().dictionary_encode()
        self.dictionary: pa.StringArray = encoded.dictionary
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        empty = pc.index(self.dictionary, "").as_py()
        if empty >= 0:  # beside leading and trailing white space
            real = codes != empty
            offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
            codes = codes[real]
        self.codes, self.offsets = codes, offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the vocabulary."""
        return xxh3.hashes(self.dictionary)


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of a pair of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64, copy=False)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def alphanumeric(texts: pa.Array) -> pa.StringArray:
    """The texts with A-Z lower-cased and every ASCII character but digits and letters as a space; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    kept = np.arange(256, dtype=np.uint8)
    kept[ord("A") : ord("Z") + 1] += 32
    word = np.zeros(256, bool)
    word[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
    kept[~word] = ord(" ")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = kept[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None and len(texts) else kept[:0]
    own = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(own.tobytes()), pa.py_buffer(flat.tobytes()))
