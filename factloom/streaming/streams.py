"""Structured Streaming forms of the stateful operators: deduplication, windows, sessions, running verdicts, captured edges.

Each function takes a streaming or a batch DataFrame, so a stream's result can be compared with a batch's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ci import RUN
from ..sources.shared import Workspace


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; the table is one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")  # a pattern may be one file as well as a folder; a plain path has to be a folder


def deduplicated(facts: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """The first delivery of each natural key; a redelivery within ``delay`` of event time is dropped and its state forgotten after that."""
    if facts.isStreaming:
        return facts.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
    return facts.dropDuplicates(key)


def tumbling(facts: DataFrame, at: str, width: str, group: list[str], aggregates: list[Column], delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling (or sliding) event-time windows: start, group, aggregates."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return facts.withWatermark(at, delay).groupBy(window.alias("w"), *group).agg(*aggregates).select(F.col("w.start").alias("start"), *group, *(F.col(a) for a in _names(facts, aggregates)))


def sessions(facts: DataFrame, at: str, gap: str, group: list[str], aggregates: list[Column], delay: str = "1 hour") -> DataFrame:
    """Aggregates of sessions: runs of a group's facts with no gap of ``gap`` or more between them."""
    grouped = facts.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *group).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group, *(F.col(a) for a in _names(facts, aggregates)))


def _names(facts: DataFrame, aggregates: list[Column]) -> list[str]:
    return facts.sparkSession.createDataFrame([], facts.schema).agg(*aggregates).columns


def running_verdicts(outcomes: DataFrame) -> DataFrame:
    """(run, verdict, flake): the last passed or failed attempt of each run so far; state is one row for a run, in any order of arrival."""
    order = F.struct(F.coalesce("run_attempt", F.lit(0)), "outcome_id")
    verdicts = outcomes.where(F.col("result").isin("passed", "failed"))
    return verdicts.groupBy(*RUN).agg(F.max_by("result", order).alias("verdict"), (F.count_if(F.col("result") == "passed") * F.count_if(F.col("result") == "failed") > 0).alias("flake"))


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what its source has, and read the result: the last table in complete mode, all rows of all batches else.

    Batches are written by their number, so a batch that is run again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    space = Workspace(spark, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(space.path("rows" if mode == "complete" else f"rows/batch={number}"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(space.path("rows")) if mode == "complete" else _batches(space, stream)


def _batches(space: Workspace, stream: DataFrame) -> DataFrame:
    """Rows of all batches; none if the source had nothing, so that no batch was made."""
    spark, path = space.spark, space.spark._jvm.org.apache.hadoop.fs.Path(space.path("rows"))
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(space.path("rows")).select(*stream.columns)


def append_edges(table: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends the rows whose key a Parquet table hasn't yet: first seen wins, redelivery adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
            fresh = fresh.join(spark.read.parquet(table).select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(table)

    return write


def captured(stream: DataFrame, key: list[str]) -> DataFrame:
    """Run a stream into a table that holds each key once, and read the table."""
    spark = stream.sparkSession
    space = Workspace(spark, "captured")
    run = stream.writeStream.option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True).foreachBatch(append_edges(space.path("rows"), key)).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(space.path("rows"))
