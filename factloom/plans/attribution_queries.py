"""Queries of attribution: claims, windows, notes before similarity, skips, shares, similar prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution
from ..sources.bindings import ctes, facts
from . import reports
from .registry import query

TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: lower(x)))"
_CODE = " OR ".join(f"ends_with(file_path, '{s}')" for s in T.CODE_SUFFIXES)
_SKIP = " OR ".join(f"contains(file_path, '{s}')" for s in T.SKIPPED_PATHS)
_WINDOW = "c.observed_at BETWEEN f.captured_at - INTERVAL {} MINUTE AND f.captured_at + INTERVAL 10 MINUTE"
_ATTRIBUTED = ctes("written", "code_pushes", "sections", "noted") + f""",
k AS (SELECT org_id, repository, commit_sha, arg_min(push_id, (captured_at, push_id)) AS push_id, min(captured_at) AS captured_at FROM code_pushes WHERE position < 20 GROUP BY ALL),
u AS (SELECT *, ({_CODE}) AND NOT ({_SKIP}) AND trim(added) <> '' AS use FROM sections),
f AS (SELECT k.*, file_path, {TOKENS.format('added')} AS t FROM k JOIN u USING (repository, commit_sha) WHERE use),
e AS (SELECT k.*, CASE WHEN count(file_path) > 0 THEN 'no_code_diff' ELSE 'commit_diff_unavailable' END AS reason FROM k LEFT JOIN u USING (repository, commit_sha) GROUP BY ALL HAVING NOT coalesce(bool_or(use), false)),
c AS (SELECT *, {TOKENS.format('text')} AS t FROM written),
p AS (SELECT f.org_id, f.repository, f.commit_sha, f.file_path, c.inference_call_id, c.session_id, c.observed_at, len(list_intersect(f.t, c.t)) / len(list_distinct(list_concat(f.t, c.t))) AS score,
    EXISTS (SELECT 1 FROM noted n WHERE n.repository = f.repository AND n.commit_sha = f.commit_sha AND n.session_id = c.session_id) AS noted, {_WINDOW.format(60)} AS near
  FROM f JOIN c ON f.org_id = c.org_id AND {_WINDOW.format(10080)} WHERE len(f.t) + len(c.t) > 0),
w AS (SELECT *, CASE WHEN noted AND score >= 0.3::double THEN 'git_notes' WHEN near AND score >= 0.7::double THEN 'jaccard' END AS source FROM p
  QUALIFY source IS NOT NULL AND row_number() OVER (PARTITION BY org_id, repository, commit_sha, file_path ORDER BY CASE source WHEN 'git_notes' THEN 0 WHEN 'jaccard' THEN 1 ELSE 2 END, score DESC, observed_at, inference_call_id) = 1),
a AS (SELECT f.push_id, f.org_id, f.repository, f.commit_sha, f.file_path, inference_call_id, session_id, score, source, CASE WHEN inference_call_id IS NULL THEN 'no_match' END AS reason FROM f LEFT JOIN w USING (org_id, repository, commit_sha, file_path)
  UNION ALL SELECT push_id, org_id, repository, commit_sha, NULL, NULL, NULL, NULL, NULL, reason FROM e)
"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushes = facts(spark, sf_dir, "code_pushes")
    sections = facts(spark, sf_dir, "sections")
    commits = pushes.select("push_id", "commit_sha", "position")
    files = attribution.claimed_files(pushes.select("push_id", "org_id", "repository", "captured_at"), commits, sections)
    calls = facts(spark, sf_dir, "written").select("inference_call_id", "org_id", "session_id", "observed_at", T.tokens(F.col("text")).alias("tokens"))
    return attribution.attribute(files, calls, facts(spark, sf_dir, "noted"))


@query("d01_attribution", _ATTRIBUTED + "SELECT push_id, org_id, repository, commit_sha, file_path, inference_call_id, session_id, score, source FROM a WHERE reason IS NULL")
def derived_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).where("reason is null").drop("reason")


@query("d01_attribution_skips", _ATTRIBUTED + "SELECT reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY reason")
def attribution_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("d02_commit_attribution", _ATTRIBUTED + "SELECT push_id, org_id, repository, commit_sha, file_path, inference_call_id, session_id, score, source, reason FROM a WHERE commit_sha = 4")
def commit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit: the filter stands before anything is compared."""
    pushes = facts(spark, sf_dir, "code_pushes").where("commit_sha = 4")
    files = attribution.claimed_files(pushes.select("push_id", "org_id", "repository", "captured_at"), pushes.select("push_id", "commit_sha", "position"), facts(spark, sf_dir, "sections").where("commit_sha = 4"))
    calls = facts(spark, sf_dir, "written").select("inference_call_id", "org_id", "session_id", "observed_at", T.tokens(F.col("text")).alias("tokens"))
    return attribution.attribute(files, calls, facts(spark, sf_dir, "noted").where("commit_sha = 4"))


_PLAUSIBLE = """t AS (SELECT org_id, repository, commit_sha, bool_or(source = 'git_notes') AS noted, bool_or(source = 'jaccard') AS guessed, bool_or(reason IS DISTINCT FROM 'no_code_diff' AND reason IS DISTINCT FROM 'commit_diff_unavailable') AS plausible FROM a GROUP BY ALL),
s AS (SELECT org_id, repository, count(*) AS commits, count(*) FILTER (WHERE plausible) AS n, count(*) FILTER (WHERE coalesce(noted, false)) AS git_notes, count(*) FILTER (WHERE NOT coalesce(noted, false) AND coalesce(guessed, false)) AS jaccard FROM t GROUP BY ALL)"""


@query("d11_attribution_share", _ATTRIBUTED + f""", {_PLAUSIBLE}, r AS (SELECT *, git_notes + jaccard AS successes FROM s)
SELECT org_id, repository, commits, n, git_notes, jaccard, n - successes AS unattributed, {reports.wilson_sql('successes', 'n', 'low')} AS low, {reports.wilson_sql('successes', 'n', 'high')} AS high FROM r""")  # fmt: skip
def attribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attribution_share(_attributed(spark, sf_dir))


@query("f06_code_files", ctes("sections") + f"SELECT file_path, ({_CODE}) AND NOT ({_SKIP}) AS code FROM sections")
def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "sections").select("file_path", T.is_code_file(F.col("file_path")).alias("code"))


@query("j06_attribution_match", f"""
WITH d AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents), b AS (SELECT item_id AS id, {TOKENS.format('text')} AS t FROM benchmark),
x AS (SELECT id, unnest(t) AS w FROM d), y AS (SELECT id, unnest(t) AS w FROM b), c AS (SELECT x.id AS left_id, y.id AS right_id, count(*) AS n FROM x JOIN y USING (w) GROUP BY x.id, y.id),
s AS (SELECT left_id, right_id, n / (len(d.t) + len(b.t) - n) AS score FROM c JOIN d ON d.id = left_id JOIN b ON b.id = right_id)
SELECT left_id, right_id, score FROM s WHERE score >= {attribution.NOTES_FLOOR}::double QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1""")  # fmt: skip
def attribution_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    calls = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    found = attribution.scored(files, calls, attribution.NOTES_FLOOR).withColumn("observed_at", F.lit(0))
    return attribution.best_match(found).select("left_id", "right_id", "score")


_SIMILAR = ctes("retold") + f""", d AS (SELECT id, role, {TOKENS.format('text')} AS t FROM retold), x AS (SELECT id, role, unnest(t) AS w FROM d),
c AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS n FROM x a JOIN x b ON a.w = b.w AND a.role = b.role AND a.id < b.id GROUP BY a.id, b.id),
s AS (SELECT a.role, left_id, right_id, n / (len(a.t) + len(b.t) - n) AS score FROM c JOIN d a ON a.id = left_id JOIN d b ON b.id = right_id WHERE n / (len(a.t) + len(b.t) - n) >= 0.8::double)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, with a third of them told again with two words more, and a seventh word for word."""
    return facts(spark, sf_dir, "retold").select("id", "role", T.tokens(F.col("text")).alias("tokens"))


@query("j12_similar_prompts", _SIMILAR + " SELECT left_id, right_id, score FROM s")
def similar_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.similar_within(_turns(spark, sf_dir), ["role"], 0.8)


@query("j12_similar_prompt_counts", _SIMILAR + " SELECT role, count(*) AS texts, (SELECT count(*) FROM s WHERE s.role = d.role) AS pairs FROM d GROUP BY role")
def similar_prompt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.similar_counts(_turns(spark, sf_dir), ["role"], 0.8).drop("examples")
