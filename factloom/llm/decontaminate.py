"""Operator 3: benchmark passages in documents, by SimHash of item-sized windows and multi-index Hamming search.

1. Words are runs of letters, marks and digits, lower-cased. Items and windows are multisets of 5-word shingles (an item of fewer words is
   one shingle of all its words).
2. Windows of an item's size are laid wherever they can reach the similarity: where enough of a document's places hold shingles
   of one item. Such a window loses nothing if it is moved on to its first shared shingle, so windows begin at those (or are the
   document's last one), wherever in the item the shingle stands. A document shorter than an item is one window. Equal windows
   of all documents are one class, so a passage that many documents share is compared once.
3. SimHash gives a class 64 bits. Each item's fingerprint is cut into 4 blocks of 16 bits, and every value within 3 bits of
   a block is indexed: by the pigeonhole principle the join on (block, value) finds all items within 15 bits.
4. Candidates are verified by the exact similarity of the shingle multisets (sum of minima over sum of maxima of the counts).

The benchmark's shingles are broadcast only up to ``BROADCAST_SHINGLES`` rows; beyond that the join is shuffled. DataFrame
operations only. Null texts have no words and no matches. Rows with equal key and text share one result; null keys are kept.
Items without words match nothing; repeated items each match. Texts and items may be of any length: steps take time in
proportion to it. Of windows of one similarity the first is given. Of the documents only key and text are read, whatever the names of the
other columns; an empty table on either side has no matches.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh_name, table
from .spans import row_key

SIZE, LEAST = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
BROADCAST_SHINGLES = 1 << 18
_MASKS = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def word_hashes(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _shingles(words: str, size: int) -> Column:
    """All shingles of ``size`` words of an array column, in order."""
    if size < SIZE:
        one = lambda i: F.xxhash64(F.slice(F.col(words), i + 1, size))
    else:
        one = lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(size)))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), one)).otherwise(F.array().cast("array<bigint>"))


def _multiset(words: str) -> Column:
    """The shingles of an item or a window: of 5 words, or one of all."""
    return F.when(F.size(words) < SIZE, F.array(F.xxhash64(F.col(words)))).otherwise(_shingles(words, SIZE))


def _simhash(shingles: str) -> Column:
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(cast(2 * aggregate({shingles}, 0, (n, x) -> n + cast(shiftright(x, b) & 1L as int)) > size({shingles}) as bigint), b))"
    )


def _numbered(shingles: str) -> Column:
    """The sorted multiset as a set: each occurrence with its number among equal ones."""
    ordered, n = F.col(shingles), F.size(shingles)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    runs = F.zip_with(begins, F.concat(F.slice(begins, 2, n), F.array(n)), lambda a, b: F.transform(F.sequence(a, b - 1), lambda j: F.xxhash64(F.get(ordered, j), j - a)))
    return F.flatten(runs)


def _blocks(fingerprint: str) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftright(fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for b in range(BLOCKS)))


def _fingerprinted(df: DataFrame, words: str) -> DataFrame:
    """df with ``fp`` and ``bag`` (the numbered multiset) of a word array."""
    sorted_bag = df.withColumn("bag", F.array_sort(_multiset(words)))
    return sorted_bag.withColumn("fp", _simhash("bag")).withColumn("bag", _numbered("bag"))


def windows(docs: DataFrame, items: DataFrame, space: Workspace, least: float = LEAST) -> DataFrame:
    """(row, key, start, words): the windows of (row, key, text) rows that hold enough shingles of an item of (item_id, words) to reach the similarity."""
    sizes = [r.s for r in items.select(F.least(F.size("words"), F.lit(SIZE)).alias("s")).distinct().collect()]  # at most SIZE of them
    located = None
    for s in sizes:
        own = items.where(F.least(F.size("words"), F.lit(SIZE)) == s)
        grams = space.keep(own.select(F.xxhash64("words").alias("item"), F.size("words").alias("length"), F.explode(_shingles("words", s)).alias("shingle")).distinct())
        if grams.count() <= BROADCAST_SHINGLES:
            grams = F.broadcast(grams)
        hashed = docs.select("row", "key", word_hashes("text").alias("words"))
        places = hashed.select("row", "key", F.size("words").alias("n"), F.posexplode(_shingles("words", s)).alias("at", "shingle"))
        shared = places.join(grams, "shingle").groupBy("row", "key", "n", "item", "length").agg(F.array_sort(F.collect_set("at")).alias("at"))
        n, length, at = F.col("n"), F.col("length"), F.col("at")
        held, wanted = F.least(n, length) - s + 1, length - s + 1  # shingles of a window, of the item
        enough = F.ceil((held + wanted) * least / (1 + least) - 1e-9).cast("int")
        end = F.greatest(F.lit(0), n - length)
        begins = F.filter(at, lambda p, i: (p <= end) & (F.get(at, i + enough - 1) < p + held))
        tail = F.when(F.size(F.filter(at, lambda p: p >= end)) >= enough, F.array(end)).otherwise(F.array().cast("array<int>"))
        found = shared.where(F.size("at") >= enough).select("row", "key", F.array_union(begins, tail).alias("starts"), F.least(n, length).alias("length"))
        found = found.select("row", "key", F.explode("starts").alias("start"), "length")
        located = found if located is None else located.unionAll(found)
    if located is None:
        return docs.select("row", "key", F.lit(0).alias("start"), word_hashes("text").alias("words")).where(F.lit(False))
    per_row = space.keep(located.groupBy("row", "key").agg(F.collect_set(F.struct("start", "length")).alias("windows")))
    texts = docs.select("row", "text").join(per_row, "row").dropDuplicates(["row"]).select("row", "key", "windows", word_hashes("text").alias("words"))
    each = texts.select("row", "key", "words", F.explode("windows").alias("w"))
    return each.select("row", "key", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.length")).alias("words"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(row, doc_id, item_id, start_word, n_words, similarity, distance): the best window of each document for each item found in it."""
    space = Workspace(docs.sparkSession, "decontaminate")
    keyed = docs.select(row_key(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    items = space.keep(benchmark.select("item_id", word_hashes("text").alias("words")).where("size(words) > 0"))
    found = windows(keyed, items, space, least)
    found = space.save(found.withColumn("c1", F.xxhash64("words")).withColumn("c2", F.hash("words")), "members")
    classes = found.groupBy("c1", "c2", F.size("words").alias("n")).agg(F.any_value("words").alias("words"))
    classes = space.keep(_fingerprinted(classes, "words").select("c1", "c2", "n", "fp", "bag"))
    marked = space.keep(_fingerprinted(items, "words").select("item_id", F.size("words").alias("item_words"), F.col("fp").alias("item_fp"), F.col("bag").alias("item_bag")))

    index = marked.select("item_id", "item_fp", F.explode(_blocks("item_fp")).alias("b")).select("item_id", "item_fp", "b.block", "b.value", F.explode(F.lit(_MASKS)).alias("mask"))
    index = index.select("item_id", "item_fp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    probes = classes.select("c1", "c2", "n", "fp", F.explode(_blocks("fp")).alias("b")).select("c1", "c2", "n", "fp", "b.block", "b.value")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = probes.join(index, ["block", "value"]).where(distance <= RADIUS).select("c1", "c2", "n", "item_id", distance.alias("distance")).distinct()
    both = near.join(classes.select("c1", "c2", "n", "bag"), ["c1", "c2", "n"]).join(marked.select("item_id", "item_bag", "item_words"), "item_id")
    common = F.size(F.array_intersect("bag", "item_bag"))
    similar = both.withColumn("similarity", common / (F.size("bag") + F.size("item_bag") - common)).where(F.col("similarity") >= least)
    similar = space.save(similar.select("c1", "c2", "n", "item_id", "similarity", "distance"), "similar")
    space.release()
    where = found.select("row", "key", "start", "c1", "c2", F.size("words").alias("n")).join(similar, ["c1", "c2", "n"])
    best = where.groupBy("row", "key", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "n", "distance")).alias("m"))
    return best.select("row", F.col("key").alias("doc_id"), "item_id", (-F.col("m.col2")).alias("start_word"), F.col("m.n").alias("n_words"), "m.similarity", "m.distance")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    row = fresh_name(docs, "row")
    bad = matches(docs, benchmark, key, text).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key(key, text)).join(bad, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
