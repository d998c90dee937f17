"""Sorted hash arrays: 64-bit keys with fixed-width values in files of the shared folder, memory-mapped by tasks.

Rows are dealt by the top bits of their key, sorted and written by the task that has them, so each file holds one
range of keys. A file is written under its attempt's own name and only finished tasks' files are listed, so a lost
executor leaves no wrong file. The list has one row for a file (about as many as shuffle partitions) and is all that
the driver sees. The shared folder must be a mounted path (``file:``), as memory maps need one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder; spark.checkpoint.dir gives {uri}")
    return parts.path


def bits_for(n: int) -> int:
    return max(1, (n - 1).bit_length())


def xxhash64(columns: list[np.ndarray]) -> np.ndarray:
    """Spark's ``xxhash64`` of columns of longs."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    out: np.ndarray | np.uint64 = np.uint64(42)
    with np.errstate(over="ignore"):
        for c in columns:
            h = out + p5 + np.uint64(8)
            h = turned(h ^ (turned(c.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            out = h ^ (h >> np.uint64(32))
    return out.view(np.int64)


def dealt(df: DataFrame, key: Column) -> DataFrame:
    """df with a column ``shard`` (top bits of the key), partitioned by it."""
    bits = bits_for(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = (F.shiftright(key, 64 - bits) + (1 << (bits - 1))).cast("int")
    return df.withColumn("shard", shard).repartitionById(1 << bits, F.col("shard"))


def write(df: DataFrame, root: str, key: str, values: list[str], kind: str = "<u8", keep: list[str] = []) -> DataFrame:
    """Write arrays of a frame that ``dealt`` made, keys distinct, values not negative.

    Rows: the file list; also, with ``file`` null, the ``keep`` columns (longs) of every row of df.
    """
    folder = local(root)
    os.makedirs(folder, exist_ok=True)
    schema = "file string, low long, high long, n long" + "".join(f", {c} long" for c in keep)
    names = ["file", "low", "high", "n", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        low = high = None
        n, most = 0, np.uint64(np.iinfo(kind).max)
        with open(f"{name}.keys", "wb") as keys, open(f"{name}.values", "wb") as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                k = batch[key].to_numpy()
                low, high, n = k[0] if low is None else low, k[-1], n + len(k)
                keys.write(np.ascontiguousarray(k, "<i8").tobytes())
                out.write(np.stack([np.minimum(batch[c].to_numpy().view(np.uint64), most).astype(kind) for c in values], 1).tobytes())
                if keep:
                    empty = [pa.nulls(batch.num_rows, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*empty, *(batch[c] for c in keep)], names=names)
        if n:
            row = [pa.array([name]), *(pa.array([int(x)], pa.int64()) for x in (low, high, n))]
            yield pa.RecordBatch.from_arrays([*row, *(pa.nulls(1, pa.int64()) for _ in keep)], names=names)
        else:
            os.remove(f"{name}.keys")
            os.remove(f"{name}.values")

    return df.sortWithinPartitions(key).mapInArrow(run, schema)


class HashArrays:
    """Reader of the files in a file list, with ``width`` values of a kind for each key."""

    def __init__(self, files: list[tuple[str, int, int, int]], width: int, kind: str = "<u8"):
        files = sorted(files, key=lambda f: f[1])
        self.lows = np.array([f[1] for f in files], np.int64)
        self.keys = [np.memmap(f"{f[0]}.keys", "<i8", "r") for f in files]
        self.values = [np.memmap(f"{f[0]}.values", kind, "r").reshape(-1, width) for f in files]
        self.bases = np.cumsum([0, *(f[3] for f in files)])
        self.width, self.kind = width, kind

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For signed keys in any order: (rank of each among all keys or -1, its values or zeros)."""
        order = np.argsort(keys)
        ranks, values = np.empty(len(keys), np.int64), np.empty((len(keys), self.width), self.kind)
        ranks[order], values[order] = self._find(keys[order])
        return ranks, values

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks = np.full(len(keys), -1, np.int64)
        values = np.zeros((len(keys), self.width), self.kind)
        if not len(self.lows):
            return ranks, values
        owner = np.searchsorted(self.lows, keys, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(self.lows) + 1))
        for f in range(len(self.lows)):
            a, b = cuts[f], cuts[f + 1]
            if a < b:
                own = self.keys[f]
                at = np.searchsorted(own, keys[a:b])
                at[at == len(own)] = 0
                hit = own[at] == keys[a:b]
                ranks[a:b] = np.where(hit, self.bases[f] + at, -1)
                values[a:b][hit] = self.values[f][at[hit]]
        return ranks, values
