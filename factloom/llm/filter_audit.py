"""Operator 12: how filters of a corpus interact, over every order in which they can be applied.

What a filter removes depends only on the set of filters applied before it, so the k! orders are paths in the lattice of subsets: each
step is an edge (already-applied subset, next filter), and there are k * 2^(k-1) edges (80 for five filters) for k * k! steps (600).

1. Each document gives the bits of the filters it fails. Documents of one part with the same bits are added up before anything else, so
   an edge gets a row for each such class and not one for each document.
2. The classes contribute to the edges; an edge's counts are sums over its classes.
3. The edges are joined to the steps of all orders. A filter's Shapley value is the sum of what its edges remove, weighed by the
   number of orders that pass through the edge: |S|! (k - 1 - |S|)!.

The five filters of ``document_failures``: short (A), repetitive (B), capitals (C), markup (D), copy (E). A copy has the text of a
document with a smaller doc_id anywhere in the table. Copies are told by a SHA-256 of the text: rows of one text are added up by
part and label first, so a text that a third of all documents hold is a few rows where its smallest doc_id is sought.

A null text is empty; empty texts are copies of each other. Rows that share a doc_id are documents of their own, no copies of each
other. A row without a doc_id is never a copy, makes no other row one, and has no labels. A null part is ''. Of several label rows of a
document one with the value 1 is enough. An empty table has no parts and gives no rows. Only doc_id, text and source are read, whatever
other columns are called; a very long text takes time in proportion to its length.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LETTERS = "ABCDE"
#: Thresholds of filters A to D: words, percent of words that differ, percent of characters that are capitals, characters of markup.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKUP = 50, 65, 5, "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text (no nulls) with these words fails the filters A to D."""
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals.cast("long") > MAX_CAPITALS * F.char_length(text).cast("long"),
        F.rlike(text, F.lit(MARKUP)),
    ]


def _bits(failures: list[Column]) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures)), F.lit(0))


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of a part by the filters they fail; good and toxic count those labelled so."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, _SPACE), "").alias("words"))
    rows = split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(text_failures(F.col("text"), F.col("words"))).alias("bits"))
    marked = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(marked("quality").alias("good"), marked("toxic").alias("toxic"))
    joined = rows.join(known, "id", "left").groupBy("id", "digest", "part", "bits").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    sums = ("n", "good", "toxic")
    same = joined.groupBy("digest", "part", "bits").agg(
        F.min("id").alias("least"), *(F.sum(c).alias(c) for c in sums), *(F.min_by(c, "id").alias(f"{c}_least") for c in sums), *(F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_free") for c in sums),
    )
    original = F.coalesce(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.lit(False))
    told = same.withColumn("original", original)
    first = {c: F.when(F.col("original"), F.col(f"{c}_least")).otherwise(0) + F.col(f"{c}_free") for c in sums}
    both = F.array(
        F.struct("bits", *(v.alias(c) for c, v in first.items())),
        F.struct(F.col("bits").bitwiseOR(1 << LETTERS.index("E")).alias("bits"), *((F.col(c) - v).alias(c) for c, v in first.items())),
    )
    each = told.select("part", F.explode(both).alias("x")).select("part", "x.*").where("n > 0")
    return each.groupBy("part", "bits").agg(*(F.sum(c).alias(c) for c in sums))


def lattice_edges(classes: DataFrame, filters: int, losses: dict[str, str]) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, the losses, shapley): a row for each part and edge of the lattice.

    classes (part, bits, n, further counts): bit i of ``bits`` says that filter i fails; ``losses`` names further counts and what of them an edge removes.
    """
    orders = lambda s: factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count())
    edges = [(s, 1 << k) for k in range(filters) for s in range(1 << filters) if not s >> k & 1]
    edge = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(bit).alias("next"), F.lit(orders(s)).alias("orders")) for s, bit in edges))
    rows = classes.select("*", F.explode(edge).alias("e")).select(*classes.columns, "e.*")
    fails, gone = F.col("bits").bitwiseAND(F.col("next")) != 0, F.col("bits").bitwiseAND(F.col("applied")) != 0
    total = lambda test, c, name: F.sum(F.when(test, F.col(c)).otherwise(0)).alias(name)
    counts = rows.groupBy("part", "applied", "next", "orders").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"), total(F.col("bits") == F.col("next"), "n", "unique_fails"),
        *(total(fails & ~gone, c, name) for c, name in losses.items()),
    )
    return counts.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "next"))).drop("orders")


def steps(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, applied, next): the steps of all orders as edges; k * k! rows."""
    bit = {c: 1 << k for k, c in enumerate(letters)}
    rows = [("".join(p), k + 1, sum(bit[c] for c in p[:k]), bit[p[k]]) for p in permutations(letters) for k in range(len(letters))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(classes: DataFrame, letters: str, losses: dict[str, str]) -> DataFrame:
    """The edges' counts at every step of every order, a row for each part, order and step, zeros included.

    ``letters`` name the filters (six at most, as there are k * k! steps); classes and losses are those of ``lattice_edges``.
    """
    if not 1 <= len(set(letters)) == len(letters) <= 6:
        raise ValueError("from one to six different letters")
    edges = lattice_edges(classes, len(letters), losses)
    paths = edges.join(F.broadcast(steps(classes.sparkSession, letters)), ["applied", "next"])  # 4,320 steps at most
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *losses.values(), "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(classes, LETTERS, {"good": "good_lost", "toxic": "toxic_lost"})
