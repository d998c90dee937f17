"""SQL of queries on rows that only larger tables have."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from factloom import catalog
from factloom.plans import bundle_queries
from factloom.sources import bundles

from .oracle import compared


def test_digests_of_three_levels_equal_their_sql(spark):
    rows = spark.range(16_500).select(F.lit("deep").alias("table"), F.lit("train").alias("split"), F.col("id").cast("string").alias("id"), F.array("id").alias("refs"), F.lit("{}").alias("body"))
    few = rows.where("cast(id AS int) < 5").withColumn("table", F.lit("flat"))
    con = duckdb.connect()
    made = "SELECT '{}' AS \"table\", 'train' AS split, i::varchar AS id, [i] AS refs, '{{}}' AS body FROM range({}) t(i)"
    sql = f"WITH r AS ({made.format('deep', 16_500)} UNION ALL {made.format('flat', 5)}), {bundle_queries._DIGEST} SELECT \"table\", rows::bigint AS rows, depth, digest FROM sized JOIN tree USING (\"table\", depth)"
    own, other = compared(bundles.digests(rows.unionByName(few)), con, sql)
    assert own == other and {(r[0], r[2]) for r in own} == {("deep", 2), ("flat", 0)}


def test_relation_faults_where_shifted_keys_are_keys_of_other_rows(spark, tmp_path):
    keys = [70, 1_000_070, 50, 1_000_050, 3, 140]
    pd.DataFrame({"o_orderkey": keys}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    own, other = compared(catalog.queries()["d24_relation_faults"](spark, str(tmp_path)), con, catalog.oracle_sql()["d24_relation_faults"])
    assert own == other and {1_000_140, 50} <= {v for r in own for v in r}
