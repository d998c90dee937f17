"""Queries of training rows, tasks, bundles, memberships by ancestry and bounded reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import split_score
from ..operators import attachment, ci, context, evidence, repositories, sequences, visibility
from ..sources import reads, rows_out
from ..sources.bindings import ctes, facts
from ..sources.shared import Workspace
from . import projections, reports
from .capture_queries import _GATEWAY, _gateway
from .fact_queries import _VERDICTS, _kept_verdicts
from .registry import query
from .report_queries import _SAID, _SOURCE, _WHY, _scored_calls

_ROWS = _SAID + """, k AS (SELECT 'org' || (c.call_id % 2) AS org_id, 'm' || (c.call_id % 4) AS model, c.call_id % 97 AS prompt_key, c.call_id AS id, confidence, kind, er, ea, kept, failed, verdict, flake,
  (('0x' || substr(sha256((c.call_id % 40)::varchar), 1, 16))::ubigint)::double / 18446744073709551616::double < 0.2::double AS is_eval FROM c)"""


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("call_id")
    named = lambda c, n: F.concat(F.lit(c), (i % n).cast("string"))
    return _scored_calls(spark, sf_dir).select(
        named("org", 2).alias("org_id"), named("m", 4).alias("model"), (i % 97).alias("prompt_key"), i.alias("id"), i.cast("string").alias("text"), "confidence", "kind", "vetoed", "accepted", "kept", "failed", "verdict", "flake",
        (split_score((i % 40).cast("string")) < 0.2).alias("is_eval"),
    )


def _recipe_sql(recipe: str, good: str) -> str:
    bucket = "org_id, model, prompt_key"
    return f"""SELECT '{recipe}' AS recipe, g.org_id, g.model, g.prompt_key, g.id AS chosen_id, r.id AS rejected_id, g.confidence AS chosen_confidence, r.confidence AS rejected_confidence, g.confidence - r.confidence AS margin, least(g.confidence, r.confidence) AS label_confidence, CASE WHEN g.is_eval OR r.is_eval THEN 'eval' ELSE 'train' END AS split
FROM (SELECT *, {good} AS good, row_number() OVER (PARTITION BY {bucket}, {good} ORDER BY id) AS i FROM k) g JOIN (SELECT *, {good} AS good, row_number() OVER (PARTITION BY {bucket}, {good} ORDER BY id) AS i FROM k) r USING ({bucket})
WHERE g.good AND NOT r.good AND g.i <= 3 AND r.i <= 3 QUALIFY row_number() OVER (PARTITION BY {bucket} ORDER BY g.id, r.id) <= 3"""


_HUMAN = "CASE kind WHEN 'explicit_accept' THEN true WHEN 'explicit_reject' THEN false END"
_OUTCOME = "CASE WHEN flake THEN NULL WHEN verdict = 'passed' THEN true WHEN verdict = 'failed' THEN false END"


@query("d14_recipe_pairs", _ROWS + f", p AS ({_recipe_sql('dpo_human', _HUMAN)}), o AS ({_recipe_sql('dpo_outcome', _OUTCOME)}) SELECT * FROM p UNION ALL SELECT * FROM o")
def recipe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir)
    return projections.recipe_pairs(rows, "dpo_human").unionByName(projections.recipe_pairs(rows, "dpo_outcome"))


@query("d15_sample_rows", _ROWS + f""", s AS (SELECT 'sft_curated' AS recipe, id, model, confidence, {_SOURCE} AS source, {_WHY['sft_curated']} AS reason FROM k UNION ALL SELECT 'sft_verified', id, model, confidence, 'resolved_ci_pass', {_WHY['sft_verified']} FROM k)
SELECT recipe, id, model, confidence, CASE WHEN reason IS NULL THEN source END AS source, reason FROM s""")  # fmt: skip
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completions(spark, sf_dir)
    return projections.sample_rows(rows, "sft_curated").unionByName(projections.sample_rows(rows, "sft_verified"))


_TASKS = _VERDICTS + """,
q AS (SELECT c_nationkey AS session_id, c_custkey AS commit_sha, 'repo' || (c_custkey % 5) AS repo, verdict FROM v JOIN customer ON commit_key = c_custkey WHERE verdict IS NOT NULL),
m AS (SELECT session_id, max((commit_sha, repo, commit_sha, verdict)) AS m FROM q GROUP BY session_id),
s AS (SELECT l_partkey AS commit_sha, string_agg('p' || l_suppkey, chr(10) ORDER BY l_orderkey * 10 + l_linenumber, 'p' || l_suppkey) AS patch, count(*)::integer AS sections FROM lineitem GROUP BY l_partkey),
t AS (SELECT session_id, m[2] AS repo, m[3] AS commit_sha, CASE m[4] WHEN 'passed' THEN 1 ELSE 0 END AS reward, patch, sections FROM m JOIN s ON m[3] = s.commit_sha)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    named = lambda c, n: F.concat(F.lit(c), (key % n).cast("string"))
    sessions = spark.read.parquet(f"{sf_dir}/customer.parquet").select(named("org", 2).alias("org_id"), named("repo", 5).alias("repository"), F.floor(key / 10).alias("commit_sha"), F.col("c_nationkey").alias("session_id"), key.alias("position"))
    placed = _kept_verdicts(spark, sf_dir).join(sessions, ci.COMMIT).select("session_id", F.col("repository").alias("repo"), F.col("position").alias("commit_sha"), "position", "verdict")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    patches = lines.select(F.col("l_partkey").alias("commit_sha"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("patch"))
    return projections.tasks(placed, patches)


@query("d18_reward_tasks", _TASKS + " SELECT session_id, repo, commit_sha, reward, md5(patch) AS patch, sections FROM t")
def reward_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).withColumn("patch", F.md5("patch"))


@query("k06_task_consumer", _TASKS + " SELECT concat(repo, '__', commit_sha) AS instance_id, repo, 'base' AS base_commit, md5(patch) AS patch, session_id::varchar AS problem_statement FROM t WHERE reward = 1")
def task_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).select(
        "repo", F.col("commit_sha").cast("string").alias("commit_sha"), F.lit("base").alias("base_sha"), F.md5("patch").alias("diff"), F.col("session_id").cast("string").alias("prompt"), F.when(F.col("reward") == 1, "passed").otherwise("failed").alias("verdict")
    )
    return rows_out.task_consumer(rows)


@query("k04_json_rows", "SELECT o_orderstatus AS split, count(*) AS rows, sum(o_orderkey)::bigint AS keys FROM orders GROUP BY 1")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines by split, and read back."""
    folder = Workspace(spark, "json").path("rows")
    rows_out.write_jsonl(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("split")), folder, "split")
    return reads.json_lines(spark, folder, "o_orderkey long, o_totalprice double, split string").groupBy("split").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


#: Every ancestor of some heads, from head to head.
REACH = """a AS (SELECT DISTINCT head, head AS c FROM heads UNION SELECT a.head, p.parent FROM a JOIN commit_parents p ON p.commit_sha = a.c WHERE p.parent IS NOT NULL)"""


@query("j08_ancestry_membership", ctes("commit_parents", "branch_merges").replace("WITH", "WITH RECURSIVE") + f""", heads AS (SELECT head FROM branch_merges UNION SELECT base FROM branch_merges), {REACH},
j AS (SELECT o_orderkey AS outcome_id, merge_id FROM orders JOIN a ON a.c = o_custkey JOIN branch_merges m ON m.head = a.head WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.head = m.base AND b.c = o_custkey)),
g AS (SELECT o_orderkey AS outcome_id, count(merge_id) AS n, min(merge_id) AS merge_id FROM orders LEFT JOIN j ON outcome_id = o_orderkey GROUP BY o_orderkey)
SELECT outcome_id, CASE WHEN n = 1 THEN 'joined' WHEN n = 0 THEN 'without_merge' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN merge_id END AS merge_id FROM g""")  # fmt: skip
def ancestry_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit belongs to the merge whose head descends from it and whose base doesn't, in graphs some 900 generations deep."""
    index = repositories.chains(facts(spark, sf_dir, "commit_parents"))
    outcomes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("outcome_id"), F.col("o_custkey").alias("commit_sha"))
    found = repositories.membership(index, outcomes, facts(spark, sf_dir, "branch_merges"))
    every = outcomes.select("outcome_id").join(found, "outcome_id", "left").withColumn("resolved", F.lit(True))
    return attachment.pull_request_membership(every)


@query("j04_qualified_outcomes", ctes("pushes") + """,
i AS (SELECT repo, count(DISTINCT repository_id) AS claims FROM pushes WHERE repository_id IS NOT NULL GROUP BY repo), p AS (SELECT push_id, repo, repository_id FROM pushes WHERE push_id % 3 = 0),
q AS (SELECT o_orderkey, 'repo' || (o_custkey % 20) AS repo, o_custkey AS sha, p.repository_id AS own FROM orders LEFT JOIN p ON push_id = o_orderkey),
r AS (SELECT q.*, CASE WHEN own IS NULL AND claims IS NOT NULL THEN 'repository_identity_unresolved' END AS reason FROM q LEFT JOIN i USING (repo))
SELECT CASE WHEN reason IS NULL THEN coalesce('id:forge/host/' || own, 'name:' || repo) END AS repository, sha, reason, count(*) AS outcomes, min(o_orderkey) AS first_outcome FROM r GROUP BY ALL""")  # fmt: skip
def qualified_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CI outcomes by qualified (repository, sha): a name that an identity claims is no key by itself."""
    pushes = facts(spark, sf_dir, "pushes")
    _, names = repositories.identities(pushes.withColumnRenamed("push_id", "source_id"), "2100-01-01")
    sources, _ = repositories.identities(pushes.where("push_id % 3 = 0").withColumnRenamed("push_id", "source_id"), "2100-01-01")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("source_id"), F.concat(F.lit("repo"), (F.col("o_custkey") % 20).cast("string")).alias("repo"), F.col("o_custkey").alias("sha"))
    return attachment.outcomes_by_commit(repositories.qualified(rows, sources, names), "source_id")


@query("j05_bound_sessions", ctes("edges") + """
SELECT repo, commit_sha, session_id, count(*) AS observations, min(observation_id) AS first_observation FROM edges WHERE captured_at <= TIMESTAMP '1997-06-01' GROUP BY ALL""")  # fmt: skip
def bound_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = reads.scope(facts(spark, sf_dir, "edges"), "captured_at", through="1997-06-01")
    return seen.groupBy("repo", "commit_sha", "session_id").agg(F.count("*").alias("observations"), F.min("observation_id").alias("first_observation"))


@query("j18_precision_with_negatives", """
WITH u AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey AS commit_sha FROM lineitem), m AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey AS commit_sha, 1 AS m FROM lineitem WHERE l_returnflag <> 'N'), f AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey AS commit_sha, 1 AS f FROM lineitem WHERE l_linenumber <= 3)
SELECT count(*) FILTER (WHERE f = 1 AND m = 1) AS tp, count(*) FILTER (WHERE f = 1 AND m IS NULL) AS fp, count(*) FILTER (WHERE f IS NULL AND m = 1) AS fn, count(*) FILTER (WHERE f IS NULL AND m IS NULL) AS tn FROM u LEFT JOIN m USING (call_id, commit_sha) LEFT JOIN f USING (call_id, commit_sha)""")  # fmt: skip
def precision_with_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("commit_sha"), "l_returnflag", "l_linenumber")
    return reports.confusion(lines, lines.where("l_returnflag <> 'N'"), lines.where("l_linenumber <= 3"), ["call_id", "commit_sha"])


@query("d07_abandonment_summary", ctes("decisions") + """,
s AS (SELECT session_id, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE accepted AND explicit) AS x, max(occurred_at) FILTER (WHERE accepted) AS l, session_id IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 50) AS c FROM decisions GROUP BY session_id HAVING bool_or(accepted))
SELECT CASE WHEN c THEN 'committed' ELSE 'abandoned' END AS status, count(*) AS sessions, sum(a)::bigint AS accepted, sum(x)::bigint AS explicit, max(l) AS last_accepted FROM s GROUP BY 1""")  # fmt: skip
def abandonment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = facts(spark, sf_dir, "decisions").where("accepted")
    sessions = accepted.groupBy("session_id").agg(F.count("*").alias("a"), F.count_if("explicit").alias("x"), F.max("occurred_at").alias("l"))
    committed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'A' and l_quantity = 50").select(F.col("l_suppkey").alias("session_id")).distinct().withColumn("c", F.lit(True))
    marked = sessions.join(committed, "session_id", "left").withColumn("status", F.when(F.col("c"), "committed").otherwise("abandoned"))
    return marked.groupBy("status").agg(F.count("*").alias("sessions"), F.sum("a").alias("accepted"), F.sum("x").alias("explicit"), F.max("l").alias("last_accepted"))


@query("d20_confidence_inspection", _SAID + """ SELECT call_id, kind, verdict, ret, sim, confidence FROM c QUALIFY true ORDER BY row_number() OVER (PARTITION BY kind, verdict ORDER BY call_id), kind, verdict NULLS FIRST LIMIT 40""")
def confidence_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_calls(spark, sf_dir).withColumnRenamed("similarity", "sim")
    return sequences.round_robin(rows, ["kind", "verdict"], "call_id", 40).select("call_id", "kind", "verdict", "ret", "sim", "confidence")


@query("d26_session_coverage", ctes("calls", "decisions") + """
SELECT 'inference_calls' AS fact_table, count(*) AS facts, min(observed_at) AS first_at, max(observed_at) AS last_at FROM calls WHERE session_id = 7 UNION ALL SELECT 'developer_decisions', count(*), min(occurred_at), max(occurred_at) FROM decisions WHERE session_id = 7""")  # fmt: skip
def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"inference_calls": (reads.matching(facts(spark, sf_dir, "calls"), session_id=7), "observed_at", "inference_call_id"), "developer_decisions": (reads.matching(facts(spark, sf_dir, "decisions"), session_id=7), "occurred_at", "decision_id")}
    timeline = visibility.dossier(tables, "session_id")
    return timeline.groupBy("fact_table").agg(F.count("*").alias("facts"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("d27_operational_report", ctes("calls") + """
SELECT model, count(*) AS n, count(*) FILTER (WHERE value > 50) AS successes FROM calls WHERE observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-25' GROUP BY model""")  # fmt: skip
def operational_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = reads.cohort(facts(spark, sf_dir, "calls"), "observed_at", "2024-01-05", "2024-01-25", "2024-02-01")
    return reports.outcome_rates(cohort.withColumn("ok", F.col("value") > 50), ["model"], "ok").select("model", "n", "successes")


_STOPS = "['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'did', 'do', 'does', 'for', 'from', 'how', 'i', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'what', 'when', 'where', 'which', 'who', 'why', 'with']"


@query("x26_query_tokens", f"""WITH q AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: lower(x))) AS t, strlen(text) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 2048 THEN 'too_long' WHEN len(list_filter(t, lambda x: NOT list_contains({_STOPS}, x))) = 0 THEN 'no_token' END AS reason, len(list_filter(t, lambda x: NOT list_contains({_STOPS}, x)))::integer AS tokens FROM q""")  # fmt: skip
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a question: many are too long."""
    found = T.query_tokens(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", found["reason"].alias("reason"), F.size(found["tokens"]).alias("tokens"))


@query("x27_content_keys", """SELECT doc_id, sha256(to_json({'finish_reason': CASE WHEN doc_id % 3 = 0 THEN 'stop' END, 'part': {'type': CASE WHEN doc_id % 11 = 0 THEN 'reasoning' ELSE 'text' END, 'content': text}, 'role': lang})) AS content_key FROM documents""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _context_parts(spark, sf_dir)
    return parts.select(F.col("inference_call_id").alias("doc_id"), context.content_key(parts).alias("content_key"))


@query("x25_trainer_messages", _GATEWAY + """, p AS (SELECT model_call_id, event_type, event_id % 7 AS k, event_id % 4 AS j FROM g WHERE session_id IS NOT NULL),
r AS (SELECT *, CASE k WHEN 0 THEN 'unsupported_completion_role' WHEN 1 THEN 'completionless' WHEN 2 THEN CASE WHEN j IN (0, 2) THEN 'unrepresentable_part_order' END WHEN 3 THEN CASE WHEN j IN (0, 2) THEN 'duplicate_tool_call_id' END WHEN 4 THEN 'unsupported_message_role' WHEN 5 THEN 'unresolved_tool_call' END AS reason FROM p)
SELECT model_call_id, reason, CASE WHEN reason IS NULL THEN CASE j WHEN 0 THEN 'said ' || event_type WHEN 1 THEN 'plain' WHEN 2 THEN 'item ' || event_type ELSE 'whole' END END AS content, CASE WHEN reason IS NULL AND j = 2 THEN 'thinking' END AS thinking,
  CASE WHEN reason IS NULL THEN CASE j WHEN 0 THEN 'Edit' WHEN 2 THEN 'Write' END END AS tool FROM r""")  # fmt: skip
def trainer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of which six of seven are spoilt in some way."""
    from ..functions.trainer import conversation

    # the id's remainder by seven is told by the alias, which holds the id
    calls = _gateway(spark, sf_dir).withColumn("k", F.regexp_extract("model_call_id", "[0-9]+", 0).cast("long") % 7)
    k, out, given = F.col("k"), F.col("output_messages"), F.col("input_messages")
    kind = dict(calls.dtypes)["output_messages"]
    role = lambda m, r: F.struct(F.lit(r).alias("role"), m["finish_reason"].alias("finish_reason"), m["parts"].alias("parts"))
    answer = F.struct(F.lit("tool_call_response").alias("type"), F.lit(None).cast("string").alias("content"), F.lit("nowhere").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit("x").alias("result"))
    turned = F.transform(out, lambda m: F.struct(m["role"].alias("role"), m["finish_reason"].alias("finish_reason"), F.reverse(m["parts"]).alias("parts")))
    spoilt_out = F.when(k == 0, F.transform(out, lambda m: role(m, "user"))).when(k == 1, F.array().cast(kind)).when(k == 2, turned).when(k == 3, F.concat(out, out)).otherwise(out)
    spoilt_in = F.when(k == 4, F.transform(given, lambda m: role(m, "alien"))).when(k == 5, F.transform(given, lambda m: F.struct(m["role"].alias("role"), m["finish_reason"].alias("finish_reason"), F.concat(m["parts"], F.array(answer)).alias("parts")))).otherwise(given)
    told = calls.select("model_call_id", conversation(spoilt_in, spoilt_out).alias("c"))
    first = F.get(F.col("c.completion"), 0)
    return told.select("model_call_id", F.col("c.reason").alias("reason"), first["content"].alias("content"), first["thinking"].alias("thinking"), F.get(first["tool_calls"], 0)["name"].alias("tool"))


_WORDS = ["license", "token", "password", "released", "the", "with"]
_CONTEXT = f"""WITH RECURSIVE p AS (SELECT source AS session_id, doc_id AS inference_call_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id % 50) AS observed_at, CASE WHEN doc_id % 3 = 0 THEN 'output' ELSE 'input' END AS side, doc_id % 4 AS message, lang AS role,
  CASE WHEN doc_id % 11 = 0 THEN 'reasoning' ELSE 'text' END AS type, text, CASE WHEN doc_id % 3 = 0 THEN 'stop' END AS finish_reason, len(list_intersect(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: lower(x))), ['license', 'token', 'password', 'released']))::integer AS score,
  CASE WHEN doc_id % 11 = 0 THEN 'reasoning_part' WHEN doc_id % 13 = 0 THEN 'non_finite_number' END AS out FROM documents),
f AS (SELECT *, row_number() OVER (ORDER BY score DESC, observed_at DESC, inference_call_id) AS i FROM p WHERE out IS NULL AND score > 0)"""
_PACKED = r""", u AS (SELECT *, to_json({'score': score, 'evidence': {'reference': {'inference_call_id': inference_call_id, 'side': side, 'message_index': message, 'part_index': 0}, 'observed_at': strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'role': role, 'finish_reason': finish_reason, 'part': {'type': type, 'content': text}}})::varchar AS j,
  count(*) OVER (PARTITION BY session_id, role, finish_reason, type, text) AS copies FROM f QUALIFY row_number() OVER (PARTITION BY session_id, role, finish_reason, type, text ORDER BY i) = 1),
c AS (SELECT *, length(j) + 5 * length(regexp_replace(j, '[\x00-\x7F]', '', 'g')) + 6 * length(regexp_replace(j, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS bytes, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM u),
g AS (SELECT session_id, 0::bigint AS k, 14336::bigint AS room, 0 AS n, false AS taken FROM (SELECT DISTINCT session_id FROM c)
  UNION ALL SELECT g.session_id, c.k, CASE WHEN g.n < 8 AND c.bytes + (g.n > 0)::int <= g.room THEN g.room - c.bytes - (g.n > 0)::int ELSE g.room END, CASE WHEN g.n < 8 AND c.bytes + (g.n > 0)::int <= g.room THEN g.n + 1 ELSE g.n END, g.n < 8 AND c.bytes + (g.n > 0)::int <= g.room FROM g JOIN c ON c.session_id = g.session_id AND c.k = g.k + 1)"""


def _context_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("session_id"), i.alias("inference_call_id"), F.expr("timestamp'2024-01-01 00:00:00' + interval '1' minute * (doc_id % 50)").alias("observed_at"), F.when(i % 3 == 0, "output").otherwise("input").alias("side"), (i % 4).alias("message"),
        F.lit(0).alias("part"), F.col("lang").alias("role"), F.when(i % 11 == 0, "reasoning").otherwise("text").alias("type"), "text", F.when(i % 3 == 0, "stop").alias("finish_reason"), (i % 13 != 0).alias("finite"),
    )


@query("d13_retrieved_parts", _CONTEXT + _PACKED + " SELECT session_id, n AS rank, score, inference_call_id, side, bytes FROM g JOIN c USING (session_id, k) WHERE taken")
def retrieved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question to every session: the parts that fit into its response."""
    return context.retrieve(_context_parts(spark, sf_dir), _WORDS)[0].select("session_id", "rank", "score", "inference_call_id", "side", "bytes")


@query("d13_retrieval_summary", _CONTEXT + _PACKED + """, q AS (SELECT session_id, max(n) AS selected, min(k) FILTER (WHERE n = 8) AS last, max(k) AS groups FROM g GROUP BY session_id), z AS (SELECT session_id, sum(copies - 1)::bigint AS repeated FROM c GROUP BY session_id),
s AS (SELECT session_id, count(*) AS scanned_parts, count(*) FILTER (WHERE out = 'reasoning_part') AS reasoning_part, count(*) FILTER (WHERE out = 'non_finite_number') AS non_finite_number, count(*) FILTER (WHERE out IS NULL AND score = 0) AS no_match FROM p GROUP BY session_id)
SELECT session_id, scanned_parts, CASE WHEN selected > 0 THEN 'matched' WHEN groups > 0 THEN 'budget_exhausted' ELSE 'no_match' END AS status, coalesce(selected, 0) AS selected, reasoning_part, non_finite_number, no_match, coalesce(repeated, 0) AS repeated_content,
  coalesce(groups - last, 0) AS item_limit, coalesce(groups - selected - coalesce(groups - last, 0), 0) AS response_budget FROM s LEFT JOIN q USING (session_id) LEFT JOIN z USING (session_id)""")  # fmt: skip
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.retrieve(_context_parts(spark, sf_dir), _WORDS)[1]


@query("d13_discovered_sessions", _CONTEXT + """, s AS (SELECT DISTINCT source AS session_id, CASE WHEN source IN ('src3', 'src5') THEN 'abc' END AS commit_match FROM documents),
b AS (SELECT session_id, count(*) AS matched, arg_min(score, i) AS score, arg_min(inference_call_id, i) AS best_call FROM f GROUP BY session_id)
SELECT session_id, commit_match, coalesce(score, 0) AS score, coalesce(matched, 0) AS matched, best_call FROM s LEFT JOIN b USING (session_id) WHERE commit_match IS NOT NULL OR best_call IS NOT NULL ORDER BY commit_match IS NULL, coalesce(score, 0) DESC, session_id LIMIT 8""")  # fmt: skip
def discovered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _context_parts(spark, sf_dir)
    sessions = parts.select("session_id").distinct().withColumn("commit_match", F.when(F.col("session_id").isin("src3", "src5"), "abc"))
    return context.discover(parts, sessions, _WORDS)


@query("l03_next_page", ctes("ci_outcomes") + "SELECT outcome_id, captured_at FROM ci_outcomes WHERE result = 'failed' ORDER BY captured_at DESC, outcome_id DESC LIMIT 50 OFFSET 50")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, by the cursor of the first."""
    failed = facts(spark, sf_dir, "ci_outcomes").where("result = 'failed'").select("outcome_id", "captured_at")
    asked = {"result": "failed"}
    _, cursor = visibility.page(failed, "captured_at", "outcome_id", 50, asked, 7)
    return visibility.page(failed, "captured_at", "outcome_id", 50, asked, 7, cursor)[0]


@query("f13_evidence_json", """SELECT o_orderkey, CASE WHEN strlen(concat('{"o_custkey":', o_custkey, ',"o_orderpriority":"', o_orderpriority, '"}')) <= 46 THEN concat('{"o_custkey":', o_custkey, ',"o_orderpriority":"', o_orderpriority, '"}') END AS json FROM orders""")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.evidence_json(F.struct("o_custkey", "o_orderpriority"), 46).alias("json"))
