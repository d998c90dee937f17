"""Operator 9: near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

1. A task hashes a text's distinct word shingles to 64 bits and makes its SuperMinHash signature (Ertl, 2017): an element
   draws a value and a place of one random permutation in each step, so places are filled more evenly than by independent
   hashes, and a document stops when no later step can lower a register. All texts of a slice take a step together.
2. Documents with equal sets are one class (128-bit set hash); only classes go on.
3. Bands of the signature are bucket keys. In each bucket every class is paired with three of its classes (smallest, largest
   id, largest set); pairs are verified on the full sets and verified links are grouped. Classes in buckets that still hold
   several components are then compared all with all, those that such buckets connect with each other: their sets go to tasks in
   chunks, and a task verifies a pair of chunks and gives a spanning forest of its links. So no candidate pair is left
   out unless its link is already implied, and no step has a row for each pair of a large group.
4. Components come from star contraction over links and copies.

With 40 bands of 6 registers a pair at similarity 0.8 shares no bucket with probability 5e-6, and less above it.
Text is lower-cased (A-Z); words are white-space words. Fewer words than the shingle has: the whole sequence is one
shingle. Null text and text without words: empty set, linked with nothing. Rows that share a doc_id are one
document. A null doc_id is linked with nothing: its component is null and it is kept. Repeated rows each give a row.
A very long text is shingled as a whole, in a slice of its own. An empty table gives an empty table; only doc_id and text are read, whatever the names of the other columns. A pair at exactly the
wanted share is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import chunk_pairs, compare, forest
from .common import Workspace, fresh_name, small_batches, table
from .components import components
from .words import Words, mix, slices

BANDS, ROWS = 40, 6
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHUNK = 1 << 17  # shingles whose signatures are made together
CHUNK = 512  # classes whose full sets a task holds twice


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one text after another; offsets of the texts)."""
    words = Words(texts, lower=True)
    codes = words.hashes()[words.codes]
    h = mix(codes, 1)
    for k in range(1, size):
        h = mix(h[: max(len(codes) - k, 0)], codes[k:])
    sets = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            whole = mix(codes[a : a + 1], size + b - a)
            for c in codes[a + 1 : b]:
                whole = mix(whole, c)
            sets.append(whole)
        else:
            sets.append(codes[:0])
    return np.concatenate(sets) if sets else codes[:0], np.cumsum([0, *map(len, sets)])


def _places(draws: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """What stands at a place of each element's permutation after the swaps (j, draws[j])."""
    for j in range(len(draws) - 1, -1, -1):
        at = np.where(at == j, draws[j], np.where(at == draws[j], j, at))
    return at


def signatures(elements: np.ndarray, offsets: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set: registers hold step << 32 | value."""
    docs = len(offsets) - 1
    out = np.full((docs, registers), _UNSET)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    draws: list[np.ndarray] = []
    table: np.ndarray | None = None
    for j in range(registers):
        x = mix(elements, j + 1)
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(registers - j) >> np.uint64(32)).astype(np.int64)
        if table is None and j == 6:  # few elements are left: keep their permutations
            table = np.tile(np.arange(registers, dtype=np.int16), (len(elements), 1))
            rows = np.arange(len(elements))
            for i, d in enumerate(draws):
                table[rows, i], table[rows, d] = table[rows, d], table[rows, i]
        if table is None:
            place = _places(draws, k)
            draws.append(k)
        else:
            rows = np.arange(len(elements))
            place = table[rows, k].astype(np.int64)
            table[rows, k] = table[rows, j]
        np.minimum.at(flat, owner * registers + place, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        more = out.max(1) >= np.uint64((j + 1) << 32)  # a register that the next step can lower
        keep = more[owner]
        if not keep.all():
            elements, owner, draws = elements[keep], owner[keep], [d[keep] for d in draws]
            table = None if table is None else table[keep]
        if not len(elements):
            break
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = mix(parts[:, :, 0], np.arange(1, BANDS + 1))
    for r in range(1, ROWS):
        key = mix(key, parts[:, :, r])
    return key.view(np.int64)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        yield at, to
        at = to


def _set_hashes(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, wrapping at 64 bits."""
    out = []
    for salt in (11, 12):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements, salt))])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands) of (doc_id, text) rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            elements, offsets = shingles(part[1], size)
            h1, h2 = _set_hashes(elements, offsets)
            bands = np.concatenate([_bands(signatures(elements[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in _chunks(offsets)])
            n = np.diff(offsets)
            ends = np.cumsum([0, *np.where(n > 0, BANDS, 0)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bands[n > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part[0], pa.array(n), pa.array(h1), pa.array(h2), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted (node, h1, h2)."""
    rows = docs.join(wanted, docs.doc_id == wanted.node).select("node", "text", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            elements, offsets = shingles(part[1], size)
            h1, h2 = _set_hashes(elements, offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(elements.view(np.int64)))
            same = (h1 == part[2].to_numpy()) & (h2 == part[3].to_numpy())
            yield pa.RecordBatch.from_arrays([part[0], lists], names=["node", "shingles"]).filter(pa.array(same))

    return rows.mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap by the given percentage of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _linked(percent: int):
    """(a, b) of a block: a spanning forest of the links between sets of different components."""

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
        chunk, node, component = (rows[c].to_numpy() for c in ("chunk", "node", "c"))
        if len(np.unique(component)) == 1:
            return None
        lists = rows["shingles"].combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.cumsum(lengths) - lengths
        mark = np.zeros(len(flat) + 1, np.uint8)
        linked = np.zeros((len(node), len(node)), bool)
        for i in np.flatnonzero(chunk == first):
            own = flat[starts[i] : starts[i] + lengths[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = 0
            linked[i] = (100 * common >= percent * (lengths + lengths[i] - common)) & (component != component[i]) & (chunk == second)
        root = forest(linked | linked.T)
        hangs = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[hangs]), pa.array(node[root[hangs]])], names=["a", "b"])

    return block


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = space.save(fingerprints(docs, size), "marks")
    real = marks.where("n_shingles > 0 and doc_id is not null")
    grouped = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"), F.any_value("bands").alias("bands"))
    classes = space.save(grouped, "classes")
    copies = real.select("h1", "h2", "doc_id").join(classes.where("rows > 1").select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    member = classes.select(F.explode("bands").alias("key"), F.struct("node", "n").alias("m"))
    ends = member.groupBy("key").agg(F.count("*").alias("rows"), F.min("m").alias("low"), F.max("m").alias("high"), F.max_by("m", F.struct("m.n", "m.node")).alias("wide")).where("rows > 1")
    ends = space.keep(ends.select("key", "low", "high", "wide"))
    member = space.save(member.join(ends, "key"), "members")
    space.release()

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        a, b = F.col(f"{x}.node"), F.col(f"{y}.node")
        near = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
        return df.where((a != b) & near).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    hubs = member.select("m", F.explode(F.array("low", "high", "wide")).alias("hub"))
    first = pairs(hubs, "m", "hub").distinct()
    wanted = member.select("m.node").distinct().join(classes.select("node", "h1", "h2"), "node")
    sets = space.save(_sets(docs, wanted, size), "sets")
    links = space.keep(_verified(first, sets, percent))

    known = components(links, space, "first")
    placed = member.select("key", "m").join(known, F.col("m.node") == F.col("node"), "left").select("key", "m", F.coalesce("component", F.col("m.node")).alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    placed = space.keep(placed.join(mixed, "key").select("key", F.col("m.node").alias("node"), "c"))
    near = placed.join(placed.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b")
    around = components(near, space, "near").withColumnRenamed("component", "near")
    open_ = placed.select("node", "c").distinct().join(around, "node").join(sets, "node").select("near", "node", "c", "shingles")
    blocks = chunk_pairs(open_, around.groupBy("near").agg(F.count("*").alias("n")), "near", "node", CHUNK)
    more = compare(blocks, "near", _linked(percent), "a long, b long")
    found = components(links.unionAll(more).unionAll(copies), space, "all")
    space.release()
    out = marks.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), size=2)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the smallest key. Rows with a null key stay.

    Of rows with one key and one text one stays (the first in the order of all columns). Where a key has several texts each of them
    is a document of its own: the text with the smallest hash goes by the key, the others by negative ids made of their hash.
    """
    mark, own = fresh_name(docs, "mark"), fresh_name(docs, "own")
    space = Workspace(docs.sparkSession, "keep")
    named = docs.where(F.col(key).isNotNull()).withColumn(mark, F.xxhash64(text))
    texts = named.groupBy(F.col(key).alias("k")).agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("n")).where("n > 1")
    several = space.save(texts.select(F.col("k").alias(own), F.col("low").alias(f"{own}_low"), F.col("high").alias(f"{own}_high")), "several")
    joined = named.join(several, F.col(key) == F.col(own), "left")
    other = F.col(mark) != F.coalesce(f"{own}_low", mark)
    joined = joined.withColumn(mark, F.when(other, -1 - F.abs(F.xxhash64(F.col(key).cast("string"), mark))).otherwise(F.col(key).cast("long")))
    once = joined.where(F.col(own).isNull()).select(*docs.columns, mark)
    again = joined.where(F.col(own).isNotNull()).groupBy(mark).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*", mark)
    rows = once.unionByName(again)
    found = link(rows.select(F.col(mark).alias("doc_id"), F.col(text).alias("text")), size, percent)
    dropped = found.where("not kept").select(F.col("doc_id").alias(own)).distinct()
    kept = rows.join(dropped, F.col(mark) == F.col(own), "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where(F.col(key).isNull()))
