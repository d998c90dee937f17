"""Training bundles: the rows of all recipes and the completions they come from, written in one pass, with a manifest of digests that comes last."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 1000  # rows that a leaf of a digest's tree has on average at most
MANIFEST = "table string, rows long, depth int, digest string"
ROWS = "table string, split string, id string, refs array<long>, body string"


def bundle_row(table: str, split: Column, id_: Column, refs: list[Column], *fields: Column) -> list[Column]:
    """The columns of a bundle's row: its table and split, its id there, the completions it refers to, and its fields as JSON."""
    each = [F.array(*(r.cast("long") for r in refs)) if refs else F.array().cast("array<long>")]
    return [F.lit(table).alias("table"), split.alias("split"), id_.cast("string").alias("id"), each[0].alias("refs"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body")]


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), ","), 256)


def depth_of(rows: int) -> int:
    """Hex digits by which a table's rows are dealt to leaves."""
    return max(0, math.ceil(math.log(max(rows, 1) / LEAF, 16) - 1e-9))


def digests(rows: DataFrame) -> DataFrame:
    """(table, rows, depth, digest) of rows (table, split, id, refs, body): the same in any order and any partitioning.

    A row's SHA-256 says by its first digits which leaf has it; a leaf is the SHA-256 of its rows' in order, with how often each comes, and a node that of its
    children, digit by digit up to the root. So no task has more than a leaf, however many rows a table has, and equal rows are counted before they meet.
    """
    own = F.sha2(F.to_json(F.struct("split", "id", "refs", "body"), {"ignoreNullFields": "false"}), 256)
    hashed = rows.select("table", own.alias("h")).groupBy("table", "h").agg(F.count("*").alias("n"))
    sizes = {r.table: r.n for r in hashed.groupBy("table").agg(F.sum("n").alias("n")).collect()}  # tables are few
    depth = F.lit(0)
    for table, n in sizes.items():
        depth = F.when(F.col("table") == table, depth_of(n)).otherwise(depth)
    placed = hashed.withColumn("depth", depth)
    nodes = placed.groupBy("table", "depth", F.substring("h", F.lit(1), F.col("depth")).alias("at")).agg(_joined(F.concat_ws("*", "h", F.col("n").cast("string"))).alias("digest"), F.sum("n").alias("rows"))
    for level in range(max(map(depth_of, sizes.values()), default=0), 0, -1):
        deep = nodes.where(F.length("at") == level)
        up = deep.groupBy("table", "depth", F.substring("at", 1, level - 1).alias("at")).agg(_joined(F.concat("at", F.lit(":"), "digest")).alias("digest"), F.sum("rows").alias("rows"))
        nodes = nodes.where(F.length("at") < level).select("table", "depth", "at", "digest", "rows").unionByName(up)
    return nodes.select("table", "rows", "depth", "digest")


def write(rows: DataFrame, folder: str) -> None:
    """Write the rows of all tables in one pass, a folder for each table and split, then the manifest: a bundle without one is not finished."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("table", "split").parquet(f"{folder}/rows")
    digests(read(spark, folder)).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{folder}/rows")


def faults(spark: SparkSession, folder: str, completions: str = "completions") -> DataFrame:
    """(table, rows, found_rows, intact, repeated_ids, dangling, split_faults): each table of a bundle against its manifest and against the others.

    intact: count and digest are those of the manifest. dangling: references to a completion that isn't in the bundle. split_faults: rows that aren't eval
    though a completion they refer to is, or are though none is. A table that only one of both knows has null on the other side.
    """
    rows = read(spark, folder)
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    found = digests(rows).select("table", F.col("rows").alias("found_rows"), F.col("digest").alias("found"))
    repeated = rows.groupBy("table", "id").agg(F.count("*").alias("n")).groupBy("table").agg(F.sum(F.col("n") - 1).alias("repeated_ids"))
    known = rows.where(F.col("table") == completions).groupBy(F.col("id").cast("long").alias("ref")).agg(F.max(F.col("split") == "eval").alias("known_eval"))
    each = rows.select("table", "split", "id", F.explode("refs").alias("ref")).join(known, "ref", "left")
    of_row = each.groupBy("table", "id", "split").agg(F.count_if(F.col("known_eval").isNull()).alias("dangling"), F.max(F.coalesce("known_eval", F.lit(False))).alias("any_eval"))
    relations = of_row.groupBy("table").agg(F.sum("dangling").alias("dangling"), F.count_if((F.col("split") == "eval") != F.col("any_eval")).alias("split_faults"))
    out = manifest.join(found, "table", "full_outer").join(repeated, "table", "left").join(relations, "table", "left")
    intact = F.coalesce((F.col("rows") == F.col("found_rows")) & (F.col("digest") == F.col("found")), F.lit(False))
    return out.select("table", "rows", "found_rows", intact.alias("intact"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("repeated_ids", "dangling", "split_faults")))
