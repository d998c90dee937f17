"""Operator 2: licence detections by ordered signature rules with a keyword prefilter and interval-containment suppression.

A text is tried with the rules whose keywords it holds: most rules need "licen" and a word of their name, so most texts are told
by a few looks. Detections are character
intervals with a priority; one that lies inside another of the same or a better priority is suppressed (of equal
intervals the first by priority and rule order stays). Suppression is a running maximum over a text's intervals in order.

Null text is the empty text: no words, no detections. Rows with equal key and text (repeated rows, null keys) share their
result, and each gives a row. Words are counted over whole texts, of any length. Of equal intervals of one priority the first rule's
stands. An empty table gives an empty table; only key and text are read, whatever the names of the other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, table
from .license_rules import GATES, OTHER, WORD, Rule, rules
from .spans import row_key, spans

#: Weight of the best detection that stands, by priority.
SCORES = (1.0, 0.95, 0.9, 0.8)


def count_words(text: Column) -> Column:
    """Words of a text: each becomes one character, together with what surrounds it."""
    marks = F.regexp_replace(text, f"{OTHER}*+{WORD}++{OTHER}*+", "x")
    return F.when(text.rlike(WORD), F.char_length(marks)).otherwise(F.lit(0))


def detections(docs: DataFrame, key: str = "doc_id", text: str = "text", listed: list[Rule] | None = None) -> DataFrame:
    """A row for each match: row (``row_key``), label, priority, base, found, char_start, char_end, word_start, word_end, suppressed."""
    listed = rules() if listed is None else listed
    keyed = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text")).withColumn("low", F.lower("text"))
    gates = sorted({(r.also, r.keyword) for r in listed})
    holds = lambda k: F.contains("low", F.lit(k)) if k else F.lit(True)

    def both(also: str, keyword: str) -> Column:
        first, regex = GATES.get(keyword, ("", ""))
        return holds(first) & F.rlike("low", F.lit(regex)) if regex else holds(also) & holds(keyword)

    any_gate = F.lit(False)
    for stem in sorted({also or keyword for also, keyword in gates if keyword not in GATES}):
        any_gate |= holds(stem)
    for keyword in sorted({k for _, k in gates if k in GATES}):
        any_gate |= both("", keyword)
    held = F.array_compact(F.array(*(F.when(both(also, k), F.lit(f"{also}&{k}")) for also, k in gates)))
    spark = docs.sparkSession
    rows = [(i, f"{r.also}&{r.keyword}", r.label, r.priority, r.base, r.regex, 0) for i, r in enumerate(listed)]
    frame = spark.createDataFrame(rows, "id int, keyword string, label string, priority int, base boolean, regex string, `group` int")
    by_word = frame.groupBy("keyword").agg(F.collect_list(F.struct("id", "label", "priority", "base", "regex", "group")).alias("rules"))
    gated = keyed.where(any_gate).select("row", "text", F.explode(held).alias("keyword")).join(F.broadcast(by_word), "keyword")  # as many rows as keywords
    found = spans(gated.dropDuplicates(["row", "keyword"]), "row", "text", "rules", {"char": F.char_length, "word": count_words}, ["label", "priority", "base"])
    order = Window.partitionBy("row").orderBy("char_start", F.desc("char_end"), "priority", "id").rowsBetween(Window.unboundedPreceding, -1)
    best = sorted({r.priority for r in listed})
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("char_end"))).over(order) for p in best}
    covered = F.lit(False)
    for p in best:
        covered |= (F.col("priority") == p) & (F.coalesce(reach[p], F.lit(-1)) >= F.col("char_end"))
    return found.withColumn("suppressed", covered)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base, stands = F.col("base"), ~F.col("suppressed")
    names = lambda where: F.array_join(F.array_sort(F.collect_set(F.when(where, F.col("label")))), ",")
    sums = detections(docs, key, text).groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("word_start"))).alias("first_word"), F.max(F.when(base, F.col("word_start"))).alias("last_word"),
        names(base).alias("base_labels"), names(base | stands).alias("labels"), F.min(F.when(base | stands, F.col("priority"))).alias("best"),
    )
    row = fresh_name(docs, "row")
    words = F.coalesce(count_words(F.col(text)), F.lit(0)).cast("long").alias("n_words")
    out = docs.select(key, row_key(key, text).alias(row), words).join(sums.withColumnRenamed("row", row), row, "left")
    score = F.coalesce(F.get(F.array(*map(F.lit, SCORES)), F.col("best")), F.lit(0.0)).alias("score")
    return out.select(key, "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), score)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
