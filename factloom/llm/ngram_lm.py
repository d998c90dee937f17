"""Operator 1: an interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped arrays.

Counting: tasks count n-grams of token ids of their texts and hand them on in packed blocks, dealt by the hash of an n-gram's context. The
task that has a shard adds it up and writes two sorted hash arrays (see ``gram_arrays``): counts of n-grams; and of contexts, with their total
and the numbers of continuations seen once, twice and oftener. What it hands on is the next lower order: the distinct n-grams that end
in a shorter one. A token's id is its rank in the vocabulary array. Discounts come from the counts of counts. One job makes all orders.
N-grams of a context whose words are all so frequent that it could fill a shard are dealt by their own hash, and the sums of these contexts
are added up once more, over all shards.

Scoring: tasks map the arrays and look up the n-grams of a slice of texts. A file's name is made of its level and shard, so nobody keeps or
sends a list of them, and a worker lets go of the maps it used longest ago. The driver sees the vocabulary's ranges, a row of sums for a level and
the ids of the words that could fill a shard (fewer than shards). Counts are exact, of 64 bits.

Tokens are white-space words, A-Z lower-cased, and one end for each text; null text is the empty text (an end alone).
A null key counts as not held out. Repeated rows count each time. An empty table has no scores. A very long text is scored as a whole, in a slice of its own. Without training rows every token has probability
1/(V+1) = 1. Only the text column is read, whatever the names of the others; columns that are added get free names.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gram_arrays, hash_arrays
from .common import Workspace, fresh_name, small_batches, table
from .gram_arrays import GramFile, hashed, packed, unpacked
from .hash_arrays import HashArrays
from .words import Words, mix, slices

ORDER = 3
END = np.uint64(xxhash.xxh3_64_intdigest("\n"))  # no word holds white space
BUFFER = 1 << 21  # n-grams that a task counts before it hands them on
SHARD = 1 << 22  # tokens of the training texts for each shard
PARTITIONS = 1 << 14  # more shards than this share partitions, and a task takes its shards one by one
_TEXT_ROWS, _NUMBER_ROWS, _BLOCK_ROWS = 2000, 200_000, 64
_BLOCK, _SUMS, _HOT = range(3)  # kinds of rows between the levels
MAPS = 8192  # files that a worker has mapped at once; Linux allows 65,530 maps
_ROWS = "shard long, kind int, level int, data binary"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, code of each token with ends, offsets of the texts)."""
    w = Words(texts, lower=True)
    codes = np.insert(w.codes.astype(np.int64), w.offsets[1:], len(w.dictionary))
    return np.append(w.hashes(), END), codes, w.offsets + np.arange(len(w.offsets))


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def merged() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([c for _, c in held]))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "c"])

    for part in slices(batches, 0):
        hashes, codes, _ = _words(part[0])
        counts = np.bincount(codes, minlength=len(hashes))
        held.append((hashes[counts > 0], counts[counts > 0]))
        n += len(held[-1][0])
        if n >= BUFFER:
            yield merged()
            held, n = [], 0
    if held:
        yield merged()


def _histories(codes: np.ndarray, offsets: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """Columns t1..tn: each token (last) after the tokens before it in its text, ``begin`` before the first."""
    columns, places = [codes], np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, order):
        before = np.empty_like(codes)
        before[back:], before[:back] = codes[:-back], begin
        before[places < back] = begin
        columns.insert(0, before)
    return columns


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows, their counts). Rows are told by their 64-bit hash."""
    key = hashed(columns)[-1]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


class Shards:
    """Which shard has an n-gram, for the number of bits of a shard's name and the ids of words that could fill one."""

    def __init__(self, bits: int, frequent: np.ndarray):
        self.bits, self.frequent = bits, frequent

    def of(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, context's key, whether the context is hot) of n-grams."""
        keys = hashed(columns)
        hot = np.ones(len(columns[0]), bool)
        for c in columns[:-1]:
            hot &= np.isin(c, self.frequent)
        return keys[-1], keys[-2], hot

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)

    def order(self, shard: np.ndarray) -> np.ndarray:
        """Rows in the order of their shards; few bits are sorted by counting."""
        return np.argsort(shard.astype(np.uint16) if self.bits <= 16 else shard, kind="stable")

    def blocks(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The rows in a packed block for each shard that has some."""
        if len(columns) == 1:
            shard = self.place(mix(columns[0], 1))
        else:
            key, context, hot = self.of(columns)
            shard = self.place(np.where(hot, key, context))
        order = self.order(shard)
        shard = shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            yield int(shard[a]), packed([*(c[own] for c in columns), counts[own]])


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, level, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(kind, pa.int32()), pa.array(level, pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "level", "data"])


def _reduced(shards: Shards, level: int, folder: str):
    """A task that adds up its shards of n-grams, writes their arrays and hands on the next lower order and all rows that are no blocks."""

    def finish(shard: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(b) for b in blocks]
        columns, counts = _summed([np.concatenate([p[k] for p in parts]) for k in range(level)], np.concatenate([p[level] for p in parts]))
        n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows = [(shard, _SUMS, level, np.array([*n, int(counts.sum()), int((counts > 2).sum())], "<u8").tobytes())]
        if level == 1:
            gram_arrays.put(gram_arrays.file_of(folder, level, shard), mix(columns[0], 1), [counts], shards.bits)
        else:
            key, context, hot = shards.of(columns)
            gram_arrays.put(gram_arrays.file_of(folder, level, shard), key, [counts], 0)
            order = np.argsort(context)
            new = np.flatnonzero(np.diff(context[order], prepend=context[order[0]] ^ np.uint64(1)))
            sums = [np.add.reduceat(x[order].astype(np.uint64), new) for x in (counts, counts == 1, counts == 2, counts > 2)]
            keys, hot = context[order][new], hot[order][new]
            gram_arrays.put(gram_arrays.file_of(folder, -level, shard), keys[~hot], [s[~hot] for s in sums], shards.bits)
            if hot.any():
                rows.append((shard, _HOT, level, packed([keys[hot], *(s[hot] for s in sums)])))
            lower, seen = _summed(columns[1:], np.ones(len(counts), np.uint64))
            yield _rows(rows)
            rows = []
            for own, block in shards.blocks(lower, seen):
                yield _rows([(own, _BLOCK, level - 1, block)])
        if rows:
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for shard, kind, at, data in zip(*(batch[c].to_pylist() for c in ("shard", "kind", "level", "data")), strict=True):
                if kind != _BLOCK:
                    yield _rows([(shard, kind, at, data)])
                    continue
                if shard != now and held:
                    yield from finish(now, held)
                    held = []
                now = shard
                held.append(data)
        if held:
            yield from finish(now, held)

    return run


_CONTEXT = ["total", "n1", "n2", "n3"]


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for level, data in zip(batch["level"].to_pylist(), batch["data"].to_pylist(), strict=True):
            columns = [pa.array(c.view(np.int64)) for c in unpacked(data)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), level, np.int32)), *columns], names=["level", "key", *_CONTEXT])


def _level_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for level, data in zip(batch["level"].to_pylist(), batch["data"].to_pylist(), strict=True):
            total[level] = total.get(level, 0) + np.frombuffer(data, "<u8").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([int(v[k]) for v in total.values()], pa.int64()) for k in range(6))], names=["level", *_SUM_NAMES])


_SUM_NAMES = ["once", "twice", "thrice", "four", "tokens", "more"]


class Model:
    """Where the arrays of a trained model are, and its few numbers. Picklable."""

    def __init__(self, order: int):
        self.order, self.bits = order, 0
        self.vocabulary: list[tuple] = []
        self.folder = ""  # of the arrays; a file's name tells its level and shard, so no list of files is kept
        self.discounts: dict[int, tuple[float, float, float]] = {}
        self.train_tokens = self.words = self.continuations = 0
        self.rest = 1.0  # weight of the uniform distribution under the unigrams
        self.frequent = np.zeros(0, np.uint64)
        self.hot: dict[int, list[tuple]] = {}  # level -> arrays of hot contexts
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of words by their hashes."""
        if "vocabulary" not in self._open:
            self._open["vocabulary"] = HashArrays(self.vocabulary, 1)
        ids, counts = self._open["vocabulary"].find(hashes.view(np.int64))
        return ids, counts[:, 0]

    def find(self, level: int, keys: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
        """Values of keys in the arrays of a level, each in the file of its shard."""
        out = np.zeros((len(keys), width), np.uint64)
        order = Shards(self.bits, self.frequent).order(shard)
        placed = shard[order]
        edges = np.flatnonzero(np.diff(placed, prepend=-1, append=-1)) if len(placed) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            file = self._file(level, int(placed[a]))
            if file is not None:
                out[order[a:b]] = file.find(keys[order[a:b]])
        return out

    def _file(self, level: int, shard: int) -> GramFile | None:
        """The mapped array of a shard; those that were used longest ago are let go of beyond ``MAPS``."""
        files: OrderedDict = self._open.setdefault("files", OrderedDict())
        if (level, shard) not in files:
            path = gram_arrays.file_of(self.folder, level, shard)
            files[level, shard] = GramFile(path, self.bits if level < 2 else 0) if os.path.exists(path) else None
            if len(files) > MAPS:
                files.popitem(last=False)
        files.move_to_end((level, shard))
        return files[level, shard]

    def _discount(self, level: int, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts[level]])[np.minimum(counts, 3).astype(np.int64)]

    def _sums(self, level: int, context: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total count of the n-grams of each context, weight of the next lower order after it)."""
        sums = self.find(-level, context, Shards(self.bits, self.frequent).place(context), 4)
        own = np.flatnonzero(hot)
        if len(own):
            if ("hot", level) not in self._open:
                self._open["hot", level] = HashArrays(self.hot[level], 4)
            sums[own] = self._open["hot", level].find(context[own].view(np.int64))[1]
        total = sums[:, 0].astype(np.float64)
        return total, sum(d * n.astype(np.float64) for d, n in zip(self.discounts[level], sums.T[1:], strict=True)) / np.maximum(total, 1)

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """P(last | others) of n-grams of ids; id -1 stands for an unknown token."""
        ids, at = np.unique(np.concatenate(columns), return_inverse=True)
        return self.probabilities_of(ids, np.split(at, len(columns)))

    def probabilities_of(self, ids: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """P(last | others) of n-grams, given as places in ids; id -1 stands for an unknown token. What one word tells is looked up once for each of ids."""
        ids = ids.astype(np.uint64)
        shards, frequent = Shards(self.bits, self.frequent), np.isin(ids, self.frequent)
        key = mix(ids, 1)
        counts = self.find(1, key, shards.place(key), 1)[:, 0]
        p = np.full(len(ids), self.rest / (self.words + 1))
        if self.continuations:
            p += np.maximum(counts - self._discount(1, counts), 0) / self.continuations
        p, words = p[columns[-1]], [ids[c] for c in columns]
        for level in range(2, self.order + 1):
            if level == 2:
                context, hot = hashed([ids])[0], frequent
                total, rest = (x[columns[-2]] for x in self._sums(level, context, hot))
                context, hot = context[columns[-2]], hot[columns[-2]]
                key = mix(context, words[-1])
            else:
                *_, context, key = hashed(words[-level:])
                hot = np.logical_and.reduce([frequent[c] for c in columns[-level:-1]])
                total, rest = self._sums(level, context, hot)
            counts = self.find(level, key, shards.place(np.where(hot, key, context)), 1)[:, 0]
            p = np.where(total > 0, np.maximum(counts - self._discount(level, counts), 0) / np.maximum(total, 1) + rest * p, p)
        return p


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts of the numbers of n-grams seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where one of them is 0 or gives none in range."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count docs and write the model's arrays to the shared folder."""
    spark = docs.sparkSession
    space, model = Workspace(spark, "lm"), Model(order)
    rows_at_once = lambda n: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    texts = docs.select(F.col(text).alias("text"))

    small_batches(spark)
    counted = hash_arrays.dealt(texts.mapInArrow(_unigrams, "key long, c long"), F.col("key")).groupBy("shard", "key").agg(F.sum("c").alias("c"))
    unigrams = space.save(counted.select("shard", "key", "c"), "unigrams")
    rows_at_once(_NUMBER_ROWS)
    files = space.save(hash_arrays.write(hash_arrays.dealt(unigrams, F.col("key")), space.path("vocabulary"), "key", ["c"]), "vocabulary_files")
    model.vocabulary = [tuple(r) for r in files.select("file", "low", "high", "n").collect()]
    total = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model.train_tokens, model.words = total.n, total.v
    model.bits = bits = max(hash_arrays.bits_for(int(spark.conf.get("spark.sql.shuffle.partitions"))), max(total.n // SHARD, 1).bit_length())
    many = unigrams.where(F.col("c") > max(total.n >> bits, 1)).select("key").collect()  # fewer words than shards
    ids = model.ids(np.array([r.key for r in many], np.int64).view(np.uint64))[0]
    model.frequent = np.append(ids[ids >= 0], model.words).astype(np.uint64)  # the last stands before the first word of a text
    space.drop("unigrams")
    del counted, unigrams
    space.settle()  # the words' shuffles are done with

    vocabulary, begin, shards = model.vocabulary, model.words, Shards(bits, model.frequent)

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashArrays(vocabulary, 1)
        held: list[list[np.ndarray]] = []
        n = 0

        def merged() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c).astype(np.uint64) for c in zip(*held, strict=True)]
            for shard, block in shards.blocks(*_summed(columns, np.ones(len(columns[0]), np.uint64))):
                yield _rows([(shard, _BLOCK, order, block)])

        for part in slices(batches, 0):
            hashes, codes, offsets = _words(part[0])
            held.append(_histories(known.find(hashes.view(np.int64))[0][codes], offsets, order, begin))
            n += len(codes)
            if n >= BUFFER:
                yield from merged()
                held, n = [], 0
        if held:
            yield from merged()

    model.folder = folder = hash_arrays.local(space.path("grams"))
    partitions = min(1 << bits, PARTITIONS)
    part = F.shiftright("shard", bits - (partitions.bit_length() - 1)).cast("int")
    rows_at_once(_TEXT_ROWS if partitions == 1 << bits else _BLOCK_ROWS)
    rows = texts.mapInArrow(ngrams, _ROWS)
    for level in range(order, 0, -1):
        rows = rows.repartitionById(partitions, part).sortWithinPartitions("shard").mapInArrow(_reduced(shards, level, folder), _ROWS)
    lists = space.save(rows, "lists")
    rows_at_once(_NUMBER_ROWS)
    hot = lists.where(F.col("kind") == _HOT).mapInArrow(_hot_sums, "level int, key long, total long, n1 long, n2 long, n3 long").groupBy("level", "key").agg(*(F.sum(c).alias(c) for c in _CONTEXT))
    hot = space.save(hot, "hot")
    for level in range(2, order + 1):
        own = hash_arrays.dealt(hot.where(F.col("level") == level), F.col("key"))
        written = space.save(hash_arrays.write(own, space.path(f"hot{level}"), "key", _CONTEXT), f"hot{level}_files")
        model.hot[level] = [tuple(r) for r in written.select("file", "low", "high", "n").collect()]
    added = lists.where(F.col("kind") == _SUMS).mapInArrow(_level_sums, f"level int, {', '.join(f'{c} long' for c in _SUM_NAMES)}").groupBy("level").agg(*(F.sum(c).alias(c) for c in _SUM_NAMES))
    sums = {r.level: [r[c] for c in _SUM_NAMES] for r in added.collect()}  # a row for a level
    for level in range(1, order + 1):
        of = sums.get(level, [0] * 6)
        model.discounts[level] = d = _discounts(of[:4])
        if level == 1:
            model.continuations = of[4]
            model.rest = (d[0] * of[0] + d[1] * of[1] + d[2] * of[5]) / of[4] if of[4] else 1.0
    small_batches(spark)
    return model


_MODELS: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and n_tokens, n_known, train_tokens, base_score, score, perplexity of the text."""
    small_batches(docs.sparkSession)
    kinds = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    names = {k: fresh_name(docs, k) for k in kinds}
    schema, at = docs.select("*", *(F.lit(0).cast(t).alias(names[k]) for k, t in kinds.items())).schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = f"{model.folder} {model.vocabulary}"
        if tag not in _MODELS:  # a worker maps one model at a time
            _MODELS.clear()
            _MODELS[tag] = model
        own = _MODELS[tag]
        floor = model.train_tokens + model.words + 1
        for part in slices(batches, at):
            hashes, codes, offsets = _words(part[at])
            ids, counts = own.ids(hashes)
            columns = _histories(codes, offsets, model.order, len(ids))
            logs = np.log10(own.probabilities_of(np.append(ids, model.words), columns))
            known, base = (counts > 0)[codes], np.log10((counts + 1.0) / floor)[codes]
            sums = [np.add.reduceat(x, offsets[:-1]) for x in (known.astype(np.int64), base, logs)]
            n = np.diff(offsets)
            arrays = [n, sums[0].astype(np.int64), np.full(len(n), model.train_tokens), sums[1], sums[2], 10.0 ** np.minimum(-sums[2] / n, 300)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in arrays)], names=[*part.schema.names, *names.values()])

    return docs.mapInArrow(run, schema)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = score(docs.withColumn("held_out", held), train(docs.where(~held)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
