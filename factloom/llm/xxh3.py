"""XXH3's 64-bit hash of many short strings at once; as ``xxhash.xxh3_64_intdigest`` gives it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SECRET = np.array([0x1CAD21F72C81017C, 0xDB979083E96DD4DE, 0x1F67B3B7A4A44072, 0x78E5C0CC4EE679CB, 0x2172FFCC7DD05A82, 0x8E2443F7744608B8], np.uint64)  # of the algorithm, its bytes 8 to 56
_FLIPS = [_SECRET[k] ^ _SECRET[k + 1] for k in (0, 2, 4)]
_LOW = np.uint64(0xFFFFFFFF)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two halves of a product of 128 bits, xored."""
    half = np.uint64(32)
    low, cross, other, high = (a & _LOW) * (b & _LOW), (a & _LOW) * (b >> half), (a >> half) * (b & _LOW), (a >> half) * (b >> half)
    middle = (low >> half) + (cross & _LOW) + (other & _LOW)
    return ((low & _LOW) | (middle << half)) ^ (high + (cross >> half) + (other >> half) + (middle >> half))


def _to_8(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of strings of 4 to 8 bytes, by their first and last four."""
    x = (last + (first << np.uint64(32))) ^ _FLIPS[0]
    x = (x ^ _turned(x, 49) ^ _turned(x, 24)) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ ((x >> np.uint64(35)) + n)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _to_16(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of strings of 9 to 16 bytes, by their first and last eight."""
    a, b = first ^ _FLIPS[1], last ^ _FLIPS[2]
    x = n + a.byteswap() + b + _folded(a, b)
    x = (x ^ (x >> np.uint64(37))) * np.uint64(0x165667919E3779F9)
    return x ^ (x >> np.uint64(32))


def hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of the words' bytes. Strings of 4 to 16 bytes, which most words are, are read and hashed as columns of numbers; the others one by one."""
    out = np.empty(len(words), np.uint64)
    if not len(words):
        return out
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    starts, ends, n = offsets[:-1], offsets[1:], np.diff(offsets)
    short, middle = np.flatnonzero((n >= 4) & (n <= 8)), np.flatnonzero((n > 8) & (n <= 16))
    data = words.buffers()[2]
    for own, kind, of in ((short, "<u4", _to_8), (middle, "<u8", _to_16)):
        if len(own):
            wide = np.dtype(kind).itemsize
            at = np.ndarray((data.size - wide + 1,), kind, data, strides=(1,))  # the number that begins at each byte
            out[own] = of(at[starts[own]].astype(np.uint64), at[ends[own] - wide].astype(np.uint64), n[own].astype(np.uint64))
    rest = np.flatnonzero((n < 4) | (n > 16))
    out[rest] = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.take(pa.array(rest)).to_pylist()), np.uint64, len(rest))
    return out
