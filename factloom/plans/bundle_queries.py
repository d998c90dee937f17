"""Queries of training bundles: what the manifest says, and what validation finds in a spoilt bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bundles
from ..sources.shared import Workspace
from . import projections
from .registry import query
from .training_queries import _HUMAN, _OUTCOME, _ROWS, _SOURCE, _WHY, _completions, _recipe_sql

_SPLIT = "CASE WHEN is_eval THEN 'eval' ELSE 'train' END"


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of a training bundle as one frame: completions, samples and pairs of each recipe. Completions are derived once and read again for each table and side of a pair."""
    rows = Workspace(spark, "completions").save(_completions(spark, sf_dir), "rows")
    split = F.when(F.col("is_eval"), "eval").otherwise("train")
    part = lambda c: F.round(F.col(c) * 1_000_000).cast("long").alias(c)
    out = rows.select(*bundles.bundle_row("completions", split, F.col("id"), [], F.col("org_id"), F.col("model"), F.col("kind"), part("confidence")))
    kept = rows.select("id", "is_eval")
    for recipe in ("sft_curated", "sft_verified"):
        samples = projections.sample_rows(rows, recipe).where("reason is null").join(kept, "id")
        out = out.unionByName(samples.select(*bundles.bundle_row(recipe, split, F.col("id"), [F.col("id")], F.col("model"), F.col("source"), part("confidence"))))
    for recipe in ("dpo_human", "dpo_outcome"):
        pairs = projections.recipe_pairs(rows, recipe)
        key = F.concat_ws("-", F.col("chosen_id").cast("string"), F.col("rejected_id").cast("string"))
        out = out.unionByName(pairs.select(*bundles.bundle_row(recipe, F.col("split"), key, [F.col("chosen_id"), F.col("rejected_id")], F.col("model"), part("label_confidence"))))
    return out


def _pairs_sql(recipe: str, good: str) -> str:
    return f"SELECT '{recipe}' AS \"table\", split, chosen_id || '-' || rejected_id AS id, [chosen_id, rejected_id] AS refs, to_json({{'model': model, 'label_confidence': round(label_confidence * 1000000)::bigint}})::varchar AS body FROM ({_recipe_sql(recipe, good)})"


_BUNDLE = _ROWS + f""", w AS (SELECT *, {_SOURCE} AS source, {_WHY['sft_curated']} AS curated, {_WHY['sft_verified']} AS verified FROM k),
r AS (SELECT 'completions' AS "table", {_SPLIT} AS split, id::varchar AS id, []::bigint[] AS refs, to_json({{'org_id': org_id, 'model': model, 'kind': kind, 'confidence': round(confidence * 1000000)::bigint}})::varchar AS body FROM k
UNION ALL SELECT 'sft_curated', {_SPLIT}, id::varchar, [id], to_json({{'model': model, 'source': source, 'confidence': round(confidence * 1000000)::bigint}})::varchar FROM w WHERE curated IS NULL
UNION ALL SELECT 'sft_verified', {_SPLIT}, id::varchar, [id], to_json({{'model': model, 'source': 'resolved_ci_pass', 'confidence': round(confidence * 1000000)::bigint}})::varchar FROM w WHERE verified IS NULL
UNION ALL {_pairs_sql('dpo_human', _HUMAN)} UNION ALL {_pairs_sql('dpo_outcome', _OUTCOME)})"""

#: Levels of the tree, one more than the deepest table can have: 1,000 rows a leaf, 16 children a node.
_LEVELS = 8


def _digest_sql() -> str:
    """Leaves, then the nodes of each level from the deepest on; nodes of a smaller depth wait until it is their level's turn."""
    joined = "sha256(string_agg({0}, ',' ORDER BY {0}))"
    out = f"""hashed AS (SELECT "table", sha256(to_json({{'split': split, 'id': id, 'refs': refs, 'body': body}})::varchar) AS h, count(*) AS n FROM r GROUP BY ALL), sized AS (SELECT "table", sum(n) AS rows, greatest(0, ceil(log(sum(n) / 1000) / log(16) - 1e-9))::integer AS depth FROM hashed GROUP BY "table"),
t{_LEVELS} AS (SELECT "table", depth, substr(h, 1, depth) AS at0, {joined.format("h || '*' || n")} AS g FROM hashed JOIN sized USING ("table") GROUP BY ALL)"""
    for k in range(_LEVELS, 0, -1):
        up = joined.format("at0 || ':' || g")
        out += f""",
t{k - 1} AS (SELECT "table", depth, at0, g FROM t{k} WHERE length(at0) < {k} UNION ALL SELECT "table", depth, substr(at0, 1, {k - 1}) AS at1, {up} FROM t{k} WHERE length(at0) = {k} GROUP BY "table", depth, at1)"""
    return out + """,
tree AS (SELECT "table", depth, g AS digest FROM t0)"""


_DIGEST = _digest_sql()


@query("d23_training_bundle", f"""{_BUNDLE}, {_DIGEST} SELECT "table", rows::bigint AS rows, depth, digest FROM sized JOIN tree USING ("table", depth)""")
def training_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe's rows in one pass, and the manifest that is written last."""
    folder = Workspace(spark, "bundle").path("b")
    bundles.write(training_rows(spark, sf_dir), folder)
    return spark.read.schema(bundles.MANIFEST).json(f"{folder}/manifest")


@query("k05_bundle", f"""{_BUNDLE}, k0 AS (SELECT id::bigint AS ref FROM r WHERE "table" = 'completions' AND try_cast(id AS bigint) % 50 <> 0), e AS (SELECT id::bigint AS ref, split = 'eval' AS e FROM r WHERE "table" = 'completions'),
x AS (SELECT "table", split, id, unnest(refs) AS ref FROM (SELECT * FROM r UNION ALL SELECT * FROM r WHERE "table" = 'sft_curated' AND try_cast(id AS bigint) % 40 = 0)), y AS (SELECT "table", id, split, count(*) FILTER (WHERE k0.ref IS NULL) AS dangling, bool_or(coalesce(e.e AND k0.ref IS NOT NULL, false)) AS any_eval FROM x LEFT JOIN k0 USING (ref) LEFT JOIN e USING (ref) GROUP BY ALL),
z AS (SELECT "table", sum(dangling)::bigint AS dangling, count(*) FILTER (WHERE (split = 'eval') <> any_eval) AS split_faults FROM y GROUP BY "table"), n AS (SELECT "table", count(*) AS rows, count(*) FILTER (WHERE "table" = 'completions' AND try_cast(id AS bigint) % 50 = 0) AS gone, count(*) FILTER (WHERE "table" = 'sft_curated' AND try_cast(id AS bigint) % 40 = 0) AS again FROM r GROUP BY "table")
SELECT "table", rows, rows - gone + again AS found_rows, gone + again = 0 AS intact, again AS repeated_ids, coalesce(dangling, 0) AS dangling, coalesce(split_faults, 0) AS split_faults FROM n LEFT JOIN z USING ("table")""")  # fmt: skip
def spoilt_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle that lost some completions and holds some samples twice after its manifest was written."""
    space = Workspace(spark, "bundle")
    bundles.write(training_rows(spark, sf_dir), space.path("b"))
    whole = bundles.read(spark, space.path("b"))
    key = F.col("id").try_cast("long")
    left = whole.where(~F.coalesce((F.col("table") == "completions") & (key % 50 == 0), F.lit(False)))
    twice = whole.where((F.col("table") == "sft_curated") & (key % 40 == 0))
    left.unionByName(twice).write.partitionBy("table", "split").parquet(f"{space.path('spoilt')}/rows")
    spark.read.schema(bundles.MANIFEST).json(f"{space.path('b')}/manifest").write.json(f"{space.path('spoilt')}/manifest")
    return bundles.faults(spark, space.path("spoilt"))
