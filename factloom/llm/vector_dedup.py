"""Operator 6: near-duplicate embeddings by spherical-cap filters.

A filter direction is a tuple of codewords, one of each block of a randomly rotated space (a structured random product
code). A vector is list-decoded to all directions whose inner product with it exceeds the cap's threshold, by adding block
inner products and cutting those that no further block can lift over it. Vectors that share a direction are compared in
double precision. Equal vectors are one class before that, so copies are never compared.

Rotations of more than 64 dimensions are structured (three rounds of sign flips and Hadamard steps), so a code takes memory in
proportion to the dimension. Directions with many vectors are split into chunks and joined chunk by chunk, so a task holds two chunks at most. A pair that shares
several directions counts at the first of them. Tasks give the number of links of each vector and a spanning forest of what they
saw, never a row for a pair; components come from star contraction.

The 100 codes have 576 directions each. The threshold lets a random vector have 28 of them; two vectors at cosine 0.95 share
none with a probability of about 1e-4 in 64 dimensions (less above it); many small codes keep the number even among vectors. The
test measures recall. A vector of another number of components is compared with its like only, under a code of its own.

A null vector, a zero vector and one with null or non-finite components links with nothing; so does a row with a null id (its component
is null, kept is true). Rows that share an id are one node of the components. Repeated rows are copies: each links with the others.
An empty table gives no rows. Only the key and the vector are read, whatever other columns are called. A pair at exactly the wanted cosine is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import chunk_pairs, compare, forest
from .common import Workspace, table
from .components import components
from .words import mix

CODES, WORDS, EXPECTED, SEED = 100, 576, 28, 7
LEAST = 0.95
CHUNK = 1024  # vectors of a direction that are held together


#: Dimensions up to this are rotated by a dense matrix; above it by sign flips and Hadamard steps, whose memory grows with the dimension only.
DENSE = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; their length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class ProductCode:
    """The directions of all codes for vectors of a dimension: products of two blocks' words from 32 dimensions on, words of one block below."""

    def __init__(self, dimension: int):
        rng = np.random.default_rng([SEED, dimension])
        self.parts = 2 if dimension >= 32 else 1
        self.words = round(WORDS ** (1 / self.parts)) if dimension > 1 else 2
        self.dimension = dimension
        self.wide = dimension if dimension <= DENSE else 1 << (dimension - 1).bit_length()
        self.codes = [self._dense(rng) if dimension <= DENSE else c for c in range(CODES if dimension > 1 else 1)]
        self.threshold = 0.0
        if dimension > 1:  # so that a random vector has EXPECTED directions
            unit = rng.standard_normal((256 if dimension <= DENSE else 64, dimension))
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            scores = np.concatenate([self._scores(unit, code).reshape(-1) for code in self.codes])
            wide = LEAST * np.sqrt(self.wide)  # in few dimensions a narrower cap would be smaller than the distance of a linked pair
            self.threshold = min(wide, float(np.quantile(scores, 1 - EXPECTED / (len(self.codes) * self.words**self.parts))))
            self.codes = self.codes[: math.ceil(EXPECTED / max(1e-9, (scores > self.threshold).mean() * self.words**self.parts))]

    def _blocks(self, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        blocks = []
        for block in np.array_split(np.arange(self.wide), self.parts):
            w = rng.standard_normal((self.words, len(block))) if self.dimension > 1 else np.array([[-1.0], [1.0]])
            blocks.append((block, w * np.sqrt(len(block)) / np.linalg.norm(w, axis=1, keepdims=True)))
        return blocks

    def _dense(self, rng: np.random.Generator):
        return np.linalg.qr(rng.standard_normal((self.dimension, self.dimension)))[0], self._blocks(rng)

    def _turned(self, unit: np.ndarray, code) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(rotated vectors, blocks of words) of a code; a structured code is made from its number each time and never kept."""
        if not isinstance(code, int):
            return unit @ code[0], code[1]
        rng = np.random.default_rng([SEED, self.dimension, code])
        turned = np.pad(unit, ((0, 0), (0, self.wide - self.dimension)))
        for _ in range(3):
            turned = hadamard(turned * rng.choice([-1.0, 1.0], self.wide))
        return turned, self._blocks(rng)

    def _scores(self, unit: np.ndarray, code) -> np.ndarray:
        turned, blocks = self._turned(unit, code)
        total = np.zeros((len(unit), 1))
        for block, w in blocks:
            total = (total[:, :, None] + (turned[:, block] @ w.T)[:, None, :]).reshape(len(unit), -1)
        return total

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of every direction that exceeds the threshold, for unit vectors; a direction's number holds its dimension."""
        rows, ids = [], []
        for c, held in enumerate(self.codes):
            turned, words = self._turned(unit, held)
            scores = [turned[:, block] @ w.T for block, w in words]
            best = [s.max(1) for s in scores]
            row, total, code = np.arange(len(unit)), np.zeros(len(unit)), np.full(len(unit), c, np.int64)
            for p, s in enumerate(scores):
                rest = sum(best[p + 1 :]) if p + 1 < len(scores) else np.zeros(len(unit))
                sums = total[:, None] + s[row]
                a, b = np.nonzero(sums + rest[row][:, None] > self.threshold)  # what no further block can lift over it goes
                total, code, row = sums[a, b], code[a] * self.words + b, row[a]
            rows.append(row)
            ids.append(code)
        return np.concatenate(rows), np.concatenate(ids) << 32 | self.dimension


_CODES: dict[int, ProductCode] = {}


def _code(dimension: int) -> ProductCode:
    if dimension not in _CODES:
        _CODES[dimension] = ProductCode(dimension)
    return _CODES[dimension]


def _vectors(lists: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for one that can't be compared."""
    out: list[np.ndarray | None] = []
    flat = lists.values
    null = flat.is_null().to_numpy(zero_copy_only=False)
    data = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    offsets, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    for known, a, b in zip(there, offsets[:-1], offsets[1:], strict=True):
        values = data[a:b] if known and b > a and not null[a:b].any() else None
        # a norm that overflows or vanishes in double precision leaves no cosine either
        with np.errstate(over="ignore"):
            out.append(values if values is not None and np.isfinite(values).all() and 0 < values @ values < np.inf else None)
    return out


def marks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, data, h1, h2): the vector's doubles and a 128-bit hash of them, null for one that can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if v is None else (v + 0.0).astype("<f8") for v in _vectors(batch[1])]  # -0 as 0
            hashes: list[list[int | None]] = [[], []]
            for v in data:
                for salt, out in enumerate(hashes):
                    out.append(None if v is None else int(mix(v.view(np.uint64), np.arange(1, len(v) + 1) * 2 + salt).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([None if v is None else v.tobytes() for v in data], pa.binary()), *(pa.array(h, pa.int64()) for h in hashes)], names=["vec_id", "data", "h1", "h2"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, data binary, h1 long, h2 long")


def directions(classes: DataFrame) -> DataFrame:
    """(direction, node, copies, data, all): a row for each direction of a class; ``all`` holds them all, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch["data"].to_pylist()
            lengths = np.array([len(d) for d in data])
            for n in np.unique(lengths):
                places = np.flatnonzero(lengths == n)
                own = np.stack([np.frombuffer(data[i], "<f8") for i in places])
                row, direction = _code(int(n) // 8).decode(own / np.linalg.norm(own, axis=1, keepdims=True))
                order = np.lexsort((direction, row))
                row, direction = row[order], direction[order]
                cuts = np.searchsorted(row, np.arange(len(places) + 1))
                lists = [direction[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                at = pa.array(places[row])
                yield pa.RecordBatch.from_arrays([pa.array(direction), batch["node"].take(at), batch["copies"].take(at), batch["data"].take(at), pa.array([lists[i] for i in row], pa.binary())], names=["direction", "node", "copies", "data", "all"])

    return classes.select("node", "copies", "data").mapInArrow(run, "direction long, node long, copies long, data binary, all binary")


def _compared(least: float):
    """(node, links, root) of a block: links that count at its direction, and the node of the spanning forest that the node hangs on."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        direction, first, second = (rows[c][0].as_py() for c in ("direction", "first", "second"))
        chunk, node, copies = (rows[c].to_numpy() for c in ("chunk", "node", "copies"))
        v = np.stack([np.frombuffer(d, "<f8") for d in rows["data"].to_pylist()])
        norms = np.sqrt((v * v).sum(1))
        linked = (v @ v.T) / (norms[:, None] * norms[None, :]) >= least
        np.fill_diagonal(linked, False)
        if first != second:
            linked &= chunk[:, None] != chunk[None, :]
        counted = linked
        if linked.any():
            lists = [np.frombuffer(x, "<i8") for x in rows["all"].to_pylist()]
            flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            earlier = flat < direction
            ids, place = np.unique(flat[earlier], return_inverse=True)
            has = np.zeros((len(lists), len(ids)), np.float32)
            has[owner[earlier], place] = 1
            has = has[:, has.sum(0) > 1]
            counted = linked & (has @ has.T == 0)
        root, count = node[forest(linked)], counted @ copies
        some = (count > 0) | (root != node)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, count, root)], names=["node", "links", "root"])

    return block


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    spark = vectors.sparkSession
    space = Workspace(spark, "vectors")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    marked = space.save(marks(vectors, key, vector), "marks")
    real = marked.where("h1 is not null and vec_id is not null")
    grouped = real.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("data").alias("data"))
    classes = space.save(grouped, "classes")
    hits = directions(classes)
    sizes = space.save(hits.groupBy("direction").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    placed = chunk_pairs(hits, sizes, "direction", "node", CHUNK)
    found = space.save(compare(placed, "direction", _compared(least), "node long, links long, root long"), "links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = space.save(classes.join(counts, "node", "left").select("h1", "h2", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "counts")
    copies = real.select("h1", "h2", "vec_id").join(classes.where("copies > 1").select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    edges = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(copies)
    grouped = space.save(components(edges, space, "all"), "components").withColumnRenamed("node", "vec_id")
    rows = marked.select("vec_id", "h1", "h2").withColumn("ok", F.expr("h1 is not null and vec_id is not null"))
    out = rows.join(of_class.select("h1", "h2", "links", F.lit(True).alias("ok")), ["h1", "h2", "ok"], "left").join(grouped, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
