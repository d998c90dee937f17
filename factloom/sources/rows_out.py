"""Training rows as JSON lines, and their adapters to consumers' schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, folder: str, split: str | None = None) -> bool:
    """Write rows as JSON lines, a folder for each split, in place of what the folder held. False, and the folder stays, if there are none; an error if a number isn't finite.

    Rows are read once: they go to a folder beside it, are counted on the way, and that folder takes the name when all are there.
    """
    bad = F.lit(False)
    for c in (c for c, t in rows.dtypes if t in ("double", "float")):
        bad |= F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    seen, staging = Observation(), f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).write
    (writer.partitionBy(split) if split else writer).json(staging)
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    counts = seen.get
    if counts["bad"] or not counts["n"]:
        fs.delete(path(staging), True)
        if counts["bad"]:
            raise ValueError(f"{counts['bad']} rows hold numbers that are not finite")
        return False
    fs.delete(path(folder), True)
    if not fs.rename(path(staging), path(folder)):
        raise OSError(f"{staging} can't take the name {folder}")
    return True


def digest(*columns: Column | str) -> Column:
    """SHA-256 of the canonical JSON of columns, absent fields left out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}), 256)


def preference_consumer(pairs: DataFrame, keep: list[str] = []) -> DataFrame:
    """(keep, prompt, chosen, rejected) with messages of the chat schema, from prompt, chosen_text and rejected_text."""
    said = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content")))
    return pairs.select(*keep, F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"), said("chosen_text").alias("chosen"), said("rejected_text").alias("rejected"))


def task_consumer(tasks: DataFrame) -> DataFrame:
    """(instance_id, repo, base_commit, patch, problem_statement) of tasks with a passing verdict."""
    kept = tasks.where("verdict = 'passed'")
    return kept.select(F.concat_ws("__", F.regexp_replace("repo", "/", "__"), F.substring("commit_sha", 1, 12)).alias("instance_id"), "repo", F.col("base_sha").alias("base_commit"), F.col("diff").alias("patch"), F.col("prompt").alias("problem_statement"))


def relation_faults(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that one of two derivations of the same table has and the other hasn't, with a ``side``."""
    return rows.exceptAll(again).withColumn("side", F.lit("written")).unionByName(again.exceptAll(rows).withColumn("side", F.lit("derived")))
