"""Sorted hash arrays of n-grams: a file for a shard, memory-mapped by tasks, and the packed blocks in which n-grams are shuffled.

A file holds the 64-bit hashes of its keys in order, cut in two: the top bits say in which bucket a key stands, through a directory of
bucket starts, and 32 of the bits after them are stored. With some 8 keys a bucket, 27 bits and more are implied in an array of
a thousand million keys, so a key is told by 59 bits or more. Values take a byte; 255 refers to a table of (place, value) with 64-bit
values, so no count is cut.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa

from .words import mix

BEGIN = 7  # what the hash of an n-gram starts from
_CODEC = pa.Codec("zstd", compression_level=1)


def hashed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the first column, of the first two, and so on."""
    out: list[np.ndarray] = []
    for c in columns:
        out.append(mix(out[-1] if out else np.full(len(c), BEGIN, np.uint64), c))
    return out


def directory_bits(n: int) -> int:
    return max((n >> 3).bit_length() - 1, 0)


def _top(keys: np.ndarray, skip: int, bits: int) -> np.ndarray:
    """The ``bits`` bits after the first ``skip``."""
    return (keys << np.uint64(skip)) >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def write(path: str, keys: np.ndarray, values: list[np.ndarray], skip: int) -> None:
    """Write distinct keys, all with the same ``skip`` top bits or none to skip, and their values."""
    turned = keys << np.uint64(skip)
    if (turned[1:] < turned[:-1]).any():  # sums mostly leave them in order
        order = np.argsort(turned)
        keys, values = keys[order], [v[order] for v in values]
    bits = directory_bits(len(keys))
    starts = np.searchsorted(_top(keys, skip, bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u8" if len(keys) >> 32 else "<u4")
    prints = ((keys << np.uint64(skip + bits)) >> np.uint64(32)).astype("<u4")
    table = np.stack(values, 1).astype(np.uint64).reshape(-1)
    large = np.flatnonzero(table >= 255)
    with open(path, "wb") as f:
        f.write(np.array([len(keys), len(values), len(large), starts.itemsize], "<u8").tobytes())
        for part in (large.astype("<u8"), table[large].astype("<u8"), starts, prints, np.minimum(table, 255).astype(np.uint8)):
            f.write(part.tobytes())


class GramFile:
    """A reader of one file."""

    def __init__(self, path: str, skip: int):
        data = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain array over the map is cheaper to index
        n, self.width, n_large, wide = data[:32].view("<u8").tolist()
        self.bits, self.skip, at = directory_bits(n), skip, 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * count
            out = data[at : at + size].view(kind)
            at += size
            return out

        self.large, self.large_values = take("<u8", n_large), take("<u8", n_large)
        self.starts, self.prints, self.table = take(f"<u{wide}", (1 << self.bits) + 1), take("<u4", n), take("u1", n * self.width)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key, zeros where it isn't held."""
        bucket = _top(keys, self.skip, self.bits).astype(np.int64)
        prints = (keys << np.uint64(self.skip + self.bits)) >> np.uint64(32)
        at, end = self.starts[bucket].astype(np.int64), self.starts[1:][bucket].astype(np.int64)
        own = np.flatnonzero(at < end)
        if len(own) < len(keys):
            at, end, prints = at[own], end[own], prints[own]
        guess = at + ((prints * (end - at).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)  # a bucket's prints are spread evenly: where one should stand
        wanted, stored = prints.astype(np.uint32), self.prints[guess]
        here = np.flatnonzero(stored == wanted)
        rows, places = [own[here]], [guess[here]]
        for step, open_ in ((1, np.flatnonzero(stored < wanted)), (-1, np.flatnonzero(stored > wanted))):  # a bucket's prints go up
            place, print_, row, bound = guess[open_] + step, wanted[open_], own[open_], (end if step > 0 else at)[open_]
            while len(place):
                inside = np.flatnonzero(place < bound if step > 0 else place >= bound)
                if len(inside) < len(place):
                    place, print_, row, bound = place[inside], print_[inside], row[inside], bound[inside]
                stored = self.prints[place]
                here = np.flatnonzero(stored == print_)
                rows.append(row[here])
                places.append(place[here])
                on = np.flatnonzero(stored < print_ if step > 0 else stored > print_)
                place, print_, row, bound = place[on] + step, print_[on], row[on], bound[on]
        hit, place = np.concatenate(rows), np.concatenate(places)
        out = np.zeros((len(keys), self.width), np.uint64)
        found = self.table.reshape(-1, self.width)[place].reshape(-1).astype(np.uint64)
        big = np.flatnonzero(found == 255)
        if len(big):
            cells = place[big // self.width] * self.width + big % self.width
            found[big] = self.large_values[np.searchsorted(self.large, cells.astype(np.uint64))]
        out[hit] = found.reshape(-1, self.width)
        return out


def file_of(folder: str, level: int, shard: int) -> str:
    """Where the array of a level's shard stands; a shard without n-grams has none. Levels of contexts are negative."""
    return f"{folder}/{level}/{shard >> 12:x}/{shard:x}"


def put(path: str, keys: np.ndarray, values: list[np.ndarray], skip: int) -> None:
    """``write`` under another name and then in one step at its place, so that an attempt of a task that was lost or repeated leaves a whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    write(own, keys, values, skip)
    os.replace(own, path)


def _planes(column: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a value, the lowest bytes of all values, then the next ones and so on)."""
    wide = max(1, (int(column.max(initial=0)).bit_length() + 7) // 8)
    return wide, np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned numbers, rows in any order: sorted by the first two, the first as differences, by bytes of one rank, compressed."""
    rank = columns[0].astype(np.uint64) << np.uint64(32) | (columns[1] if len(columns) > 1 else columns[0]).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    order = np.argsort(rank)
    columns = [c[order].astype(np.uint64) for c in columns]
    signed = np.diff(columns[0].view(np.int64), prepend=0)
    columns[0] = (signed << 1 ^ signed >> 63).view(np.uint64)  # differences may be negative beyond 32 bits
    planes = [_planes(c) for c in columns]
    data = b"".join(p for _, p in planes)
    head = np.array([len(order), len(data), len(columns), *(w for w, _ in planes)], "<u8")
    return head.tobytes() + _CODEC.compress(data, asbytes=True)


def unpacked(block: bytes) -> list[np.ndarray]:
    n, size, k = np.frombuffer(block, "<u8", 3).tolist()
    widths = np.frombuffer(block, "<u8", k, 24).tolist()
    data = np.frombuffer(_CODEC.decompress(memoryview(block)[24 + 8 * k :], size, asbytes=True), np.uint8)
    out, at = [], 0
    for wide in widths:
        own = np.zeros((n, 8), np.uint8)
        own[:, :wide] = data[at : at + n * wide].reshape(wide, n).T
        at += n * wide
        out.append(own.reshape(-1).view("<u8"))
    turned = out[0].view(np.int64)
    out[0] = np.cumsum((turned.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(turned & 1)).view(np.uint64)
    return out
