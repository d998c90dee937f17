"""Facts read from the star-schema tables: one SQL text for each fact shape, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: fact -> (tables, SQL with the tables in braces)
BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "ci_outcomes": (
        ("orders",),
        """SELECT o_orderkey AS outcome_id, concat('org', cast(o_custkey % 2 AS string)) AS org_id, 'github' AS provider, 'forge' AS repository_provider,
          concat('host', cast(o_custkey % 5 AS string)) AS repository_host, concat('repo', cast(o_custkey % 5 AS string)) AS repository,
          concat(cast(cast(floor(o_custkey / 10) AS bigint) AS string), '-', o_orderpriority) AS run_id,
          row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS run_attempt,
          cast(floor(o_custkey / 10) AS bigint) AS commit_sha, o_custkey AS commit_key, o_orderpriority AS workflow_name, substr(o_orderpriority, 1, 1) AS workflow_id, '' AS workflow_path,
          CASE WHEN o_orderkey % 97 = 0 THEN 'side' ELSE 'main' END AS branch,
          CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'cancelled' END AS result, o_orderdate AS captured_at
        FROM {orders}""",
    ),
    "decisions": (
        ("lineitem",),
        """SELECT l_orderkey * 10 + l_linenumber AS decision_id, l_suppkey AS session_id, l_orderkey AS call_id,
          CASE l_linenumber WHEN 1 THEN 'codex' WHEN 2 THEN 'copilot' ELSE 'claude-code' END AS agent_harness,
          CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN '' ELSE concat('src/', cast(l_partkey AS string), '.py') END AS file_path,
          l_partkey AS part, l_returnflag <> 'R' AS accepted, l_linestatus = 'F' AS explicit, l_shipdate AS occurred_at,
          CASE WHEN l_linenumber = 3 THEN NULL ELSE least(1e0, abs(l_discount) * 10) END AS edit_retention_score
        FROM {lineitem}""",
    ),
    "calls": (
        ("events",),
        """SELECT event_id AS inference_call_id, user_id AS session_id, event_type AS model, ts AS observed_at,
          cast(round(abs(value) * 100) AS bigint) AS duration_ms, value, concat('org', cast(user_id % 2 AS string)) AS org_id,
          concat('user', cast(user_id % 9 AS string)) AS user_id, 'gateway' AS gateway_provider, event_id % 5000 AS model_call_id, props AS raw
        FROM {events}""",
    ),
    "quarantine": (
        ("events",),
        """SELECT event_id AS quarantine_revision, user_id AS fact_id, CASE WHEN value > 50 THEN 'quarantine' ELSE 'release' END AS action
        FROM {events} WHERE event_type = 'error'""",
    ),
    "edits": (
        ("lineitem",),
        """SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS session_id, l_partkey AS file_id, l_shipdate AS occurred_at,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_quantity AS bigint) END AS lines_added, cast(round(abs(l_tax) * 100) AS bigint) AS lines_removed
        FROM {lineitem}""",
    ),
    "aliases": (("events",), "SELECT event_id % 5000 AS alias, event_id AS inference_call_id, concat('org', cast(user_id % 2 AS string)) AS org_id, user_id AS session_id, ts AS observed_at FROM {events}"),
    "pushes": (
        ("orders",),
        """SELECT o_orderkey AS push_id, concat('org', cast(o_custkey % 2 AS string)) AS org_id, concat('repo', cast(o_custkey % 20 AS string)) AS repo, 'main' AS ref,
          o_custkey AS after_sha, o_orderpriority = '1-URGENT' AS forced, CASE WHEN o_custkey % 20 < 15 THEN 'forge' END AS repository_provider,
          CASE WHEN o_custkey % 20 < 15 THEN 'host' END AS repository_host, CASE WHEN o_custkey % 20 < 15 THEN cast(o_custkey % 15 AS string) END AS repository_id, o_orderdate AS captured_at
        FROM {orders}""",
    ),
    "merges": (
        ("lineitem",),
        """SELECT l_orderkey AS merge_id, concat('repo', cast(l_suppkey % 20 AS string)) AS repo, l_partkey % 50 AS pr_number, l_partkey AS head_sha, l_suppkey AS base_sha,
          l_orderkey AS merge_commit_sha, l_shipdate AS merged_at, l_shipdate AS captured_at, 'forge' AS repository_provider, 'host' AS repository_host, cast(l_suppkey % 15 AS string) AS repository_id
        FROM {lineitem} WHERE l_linenumber = 1""",
    ),
    "edges": (
        ("lineitem",),
        "SELECT l_orderkey * 10 + l_linenumber AS observation_id, concat('repo', cast(l_suppkey % 20 AS string)) AS repo, l_partkey AS commit_sha, l_suppkey AS session_id, l_orderkey AS source_push_id, l_shipdate AS captured_at FROM {lineitem}",
    ),
    "rejections": (("lineitem",), "SELECT l_orderkey * 10 + l_linenumber AS rejection_id, l_suppkey AS session_id, l_orderkey AS call_id, l_shipdate AS occurred_at FROM {lineitem} WHERE l_returnflag = 'R'"),
    "commit_parents": (  # repositories of 1,000 commits; of each ten, two stand on a branch that is merged
        ("customer",),
        """SELECT c_custkey AS commit_sha, 0 AS place, CASE WHEN (c_custkey - 1) % 1000 = 0 THEN NULL WHEN c_custkey % 10 = 6 THEN c_custkey - 2 WHEN c_custkey % 10 = 8 THEN c_custkey - 3 ELSE c_custkey - 1 END AS parent FROM {customer}
        UNION ALL SELECT c_custkey, 1, c_custkey - 2 FROM {customer} WHERE c_custkey % 10 = 9""",
    ),
    "branch_merges": (
        ("customer",),
        """SELECT c_custkey AS merge_id, CASE WHEN c_custkey % 200 = 199 THEN c_custkey ELSE c_custkey - 2 END AS head, CASE WHEN c_custkey % 200 = 199 THEN c_custkey - 100 ELSE c_custkey - 1 END AS base
        FROM {customer} WHERE c_custkey % 200 = 199 OR c_custkey % 200 < 100 AND c_custkey % 10 = 9""",
    ),
    "retold": (
        ("conversations",),
        """SELECT conv_id * 100 + turn AS id, role, text FROM {conversations} UNION ALL SELECT conv_id * 100 + turn + 50, role, concat(text, ' once more') FROM {conversations} WHERE conv_id % 3 = 0
        UNION ALL SELECT conv_id * 100 + turn + 75, role, text FROM {conversations} WHERE conv_id % 7 = 0""",
    ),
    "turns": (("conversations",), "SELECT conv_id AS session_id, turn, role, text FROM {conversations}"),
    "written": (
        ("documents",),
        """SELECT doc_id AS inference_call_id, CASE WHEN doc_id % 10 < 8 THEN 'org0' ELSE 'org1' END AS org_id, concat(source, '-', cast(cast(floor(doc_id / 40) AS bigint) AS string)) AS session_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id * 37 % 600) AS observed_at, text
        FROM {documents} WHERE doc_id % 2 = 0""",
    ),
    "code_pushes": (
        ("documents",),
        """SELECT doc_id AS push_id, CASE WHEN doc_id % 10 < 8 THEN 'org0' ELSE 'org1' END AS org_id, concat('repo', cast(doc_id % 3 AS string)) AS repository,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id * 41 % 600 + 30) AS captured_at, cast(floor(doc_id / 6) AS bigint) AS commit_sha, doc_id % 25 AS position
        FROM {documents}""",
    ),
    "sections": (
        ("documents",),
        """SELECT concat('repo', cast(doc_id % 3 AS string)) AS repository, cast(floor(doc_id / 6) AS bigint) AS commit_sha,
          concat('src/f', cast(doc_id AS string), CASE WHEN doc_id % 7 = 0 THEN '.md' ELSE '.py' END) AS file_path, CASE WHEN doc_id % 50 = 1 THEN '  ' ELSE text END AS added
        FROM {documents} WHERE doc_id % 2 = 1 AND doc_id % 12 <> 1
        UNION ALL SELECT concat('repo', cast(doc_id % 3 AS string)), cast(floor(doc_id / 6) AS bigint), concat('src/g', cast(doc_id AS string), '.py'), concat(text, ' changed by hand')
        FROM {documents} WHERE doc_id % 4 = 2""",
    ),
    "noted": (("documents",), "SELECT concat('repo', cast(doc_id % 3 AS string)) AS repository, cast(floor(doc_id / 6) AS bigint) AS commit_sha, concat(source, '-', cast(cast(floor(doc_id / 40) AS bigint) AS string)) AS session_id FROM {documents} WHERE doc_id % 4 = 2 OR doc_id % 12 = 1"),
    "parts": (("documents",), "SELECT doc_id, source AS session_id, lang AS role, text FROM {documents}"),
}


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a binding."""
    tables, sql = BINDINGS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def ctes(*names: str) -> str:
    """``WITH`` and the bindings as common table expressions, for DuckDB."""
    parts = (f"{n} AS ({BINDINGS[n][1].format(**{t: t for t in BINDINGS[n][0]})})" for n in names)
    return "WITH " + ",\n".join(parts).replace("AS string", "AS varchar")
