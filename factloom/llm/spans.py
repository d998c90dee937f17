"""Places of regular-expression matches, by Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_key(key: str, text: str) -> Column:
    """A value that only rows with the same key and text share, null keys and texts included."""
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.xxhash64(text), F.coalesce(F.length(text), F.lit(-1)))


def spans(df: DataFrame, row: str, text: str, rules: str, measures: dict[str, Callable[[Column], Column]], carry: list[str]) -> DataFrame:
    """A row for each match of each rule: ``row``, the rule's ``carry`` fields, ``found``, ``captured`` and, for each measure m, ``m_start`` and ``m_end``.

    ``rules``: an array column of the structs to apply to the row, with ``regex``, ``group`` and an ``id`` that is unique in the array.
    A measure gives the size of a piece of text (its characters, its words); a place is the sum of the sizes before it. The text
    is cut at the matches once for each rule, and sums run over the pieces, so a long text with many matches takes time in proportion.
    """
    each = df.select(row, text, F.explode(rules).alias("rule"))
    regex = F.col("rule.regex")
    each = each.where(F.rlike(text, regex))
    cut = F.arrays_zip(
        F.split(text, regex, -1).alias("skipped"), F.regexp_extract_all(text, regex, F.lit(0)).alias("found"), F.regexp_extract_all(text, regex, F.col("rule.group")).alias("captured")
    )
    pieces = each.select(row, "rule", F.posexplode(cut).alias("place", "piece")).where("piece.found is not null")
    sized = pieces.select(
        row, *(F.col(f"rule.{c}").alias(c) for c in ["id", *carry]), "place", F.col("piece.found").alias("found"), F.col("piece.captured").alias("captured"),
        *(f(F.col("piece.skipped")).cast("long").alias(f"{m}_skip") for m, f in measures.items()), *(f(F.col("piece.found")).cast("long").alias(f"{m}_size") for m, f in measures.items()),
    )
    before = Window.partitionBy(row, "id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.sum(F.col(f"{m}_skip") + F.col(f"{m}_size")).over(before).alias(f"{m}_end") for m in measures]
    placed = sized.repartition(row).select(row, "id", *carry, "found", "captured", *(f"{m}_size" for m in measures), *ends)
    return placed.select(row, "id", *carry, "found", "captured", *(x for m in measures for x in ((F.col(f"{m}_end") - F.col(f"{m}_size")).alias(f"{m}_start"), f"{m}_end")))
