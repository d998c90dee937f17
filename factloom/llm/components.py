"""Connected components of an edge table by alternating star contraction (Kiveris et al., 2014).

Every step is a shuffle by node with map-side minimum; each round's edges are written to the shared folder, which cuts lineage.
Components never reach the driver: it sees a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) of every node that an edge (a, b) of longs names; component: the smallest node reachable. Loops and nulls are left out."""
    a, b = F.col("a"), F.col("b")
    now = space.save(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        both = now.unionAll(now.select(b.alias("a"), a.alias("b")))
        held = Workspace(space.spark, name)
        least = held.keep(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = held.keep(large)
        least = held.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b"))).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        after = space.save(small.where(a != b).distinct(), f"{name}-{step + 1}")
        held.release()
        space.drop(f"{name}-{step}")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now, step = after, step + 1
        if seen == mark:
            break
        mark = seen
    return now.select(a.alias("node"), b.alias("component")).unionAll(now.select(b.alias("node"), b.alias("component")).distinct())
