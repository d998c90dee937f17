"""Comparing all members of a group without a row for a pair: groups are cut into chunks, and a task holds two chunks at most."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_pairs(members: DataFrame, sizes: DataFrame, group: str, node: str, chunk: int) -> DataFrame:
    """members (group, node, ...) of the groups in ``sizes`` (group, n), a row for each pair of chunks (first <= second) that they take part in.

    Dealt by (group, first, second) and sorted by these and the node.
    """
    counted = sizes.select(group, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = members.join(counted, group).withColumn("chunk", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "chunk").alias("first"), F.greatest(o, "chunk").alias("second")))
    rows = own.select(*members.columns, "chunk", F.explode(pairs).alias("pair")).select(*members.columns, "chunk", "pair.first", "pair.second")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, group, "first", "second").sortWithinPartitions(group, "first", "second", node)


def compare(rows: DataFrame, group: str, function: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What a function makes of each (group, first, second) block of ``chunk_pairs``' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table[c].to_numpy() for c in (group, "first", "second")]
            edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *edges.tolist(), *([len(table)] if last else [])]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                made = function(table.slice(a, b - a)) if b - a > 1 else None
                if made is not None and made.num_rows:
                    yield made
            held = table.slice(cuts[-1]).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from blocks(False)
        if held:
            yield from blocks(True)

    return rows.mapInArrow(run, schema)


def forest(linked: np.ndarray) -> np.ndarray:
    """The first row that each row reaches, for a symmetric matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = linked[front].any(0) & (root < 0)
    return root
