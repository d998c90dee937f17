"""Queries over the fact reads: windows, key sets, identities, receipts, evidence, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution
from ..sources import reads
from ..sources.bindings import ctes, facts
from .registry import query

_HIDDEN = "q AS (SELECT fact_id FROM quarantine GROUP BY fact_id HAVING arg_max(action, quarantine_revision) = 'quarantine')"


@query("s01_calls_since", ctes("calls", "quarantine") + f", {_HIDDEN} SELECT inference_call_id, raw FROM calls WHERE observed_at >= TIMESTAMP '2024-01-20' AND session_id NOT IN (SELECT fact_id FROM q)")
def calls_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = reads.scope(facts(spark, sf_dir, "calls"), "observed_at", since="2024-01-20")
    return reads.visible(calls, facts(spark, sf_dir, "quarantine"), "session_id").select("inference_call_id", "raw")


@query("s02_call_summaries", ctes("calls") + """
SELECT inference_call_id, org_id, session_id, user_id, gateway_provider, model, duration_ms, model_call_id, observed_at FROM calls
WHERE observed_at >= TIMESTAMP '2024-01-10' AND observed_at < TIMESTAMP '2024-01-12' AND session_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")  # fmt: skip
def call_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("session_id"))
    return reads.summaries(facts(spark, sf_dir, "calls"), "2024-01-10", "2024-01-12", sessions=sessions)


@query("s04_report_calls", ctes("calls") + "SELECT inference_call_id, model FROM calls WHERE inference_call_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND observed_at <= TIMESTAMP '2024-01-15'")
def report_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("inference_call_id"))
    return reads.member(reads.scope(facts(spark, sf_dir, "calls"), "observed_at", through="2024-01-15"), ids, ["inference_call_id"]).select("inference_call_id", "model")


@query("s05_session_calls", ctes("calls") + "SELECT inference_call_id, observed_at FROM calls WHERE session_id = 7 AND observed_at <= TIMESTAMP '2024-01-25'")
def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = reads.matching(facts(spark, sf_dir, "calls"), session_id=7)
    return reads.scope(calls, "observed_at", through="2024-01-25").select("inference_call_id", "observed_at").orderBy("observed_at", "inference_call_id")


@query("s06_call_identities", ctes("aliases") + """
SELECT inference_call_id, org_id, session_id, list_sort(list(DISTINCT alias))::varchar AS call_ids FROM aliases WHERE observed_at <= TIMESTAMP '2024-01-20' GROUP BY ALL""")  # fmt: skip
def call_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.identities(facts(spark, sf_dir, "aliases"), "2024-01-20")
    return found.withColumn("call_ids", F.concat(F.lit("["), F.array_join(F.col("call_ids").cast("array<string>"), ", "), F.lit("]")))


@query("s07_identity_witnesses", ctes("aliases") + """
SELECT alias, count(DISTINCT inference_call_id) AS calls, min(inference_call_id) AS first_call, max(inference_call_id) AS last_call FROM aliases
WHERE observed_at <= TIMESTAMP '2024-01-20' AND alias IN (SELECT l_orderkey FROM lineitem) GROUP BY alias""")  # fmt: skip
def identity_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("alias"))
    return reads.witnesses(facts(spark, sf_dir, "aliases"), wanted, "2024-01-20")


@query("s08_decisions_by_id", ctes("decisions") + "SELECT decision_id, file_path, accepted FROM decisions WHERE decision_id IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderpriority = '1-URGENT')")
def decisions_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") * 10 + 1).alias("decision_id"))
    return reads.member(facts(spark, sf_dir, "decisions"), ids, ["decision_id"]).select("decision_id", "file_path", "accepted")


@query("s09_rollout_calls", "SELECT conv_id AS session_id, turn, text FROM conversations WHERE role IN ('user', 'assistant')")
def rollout_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.matching(facts(spark, sf_dir, "turns"), role=["user", "assistant"]).select("session_id", "turn", "text")


@query("s10_decisions", ctes("decisions") + """
SELECT decision_id, session_id FROM decisions WHERE occurred_at <= TIMESTAMP '1996-06-30' AND session_id IN (3, 5, 8) AND call_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")  # fmt: skip
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("call_id"))
    found = reads.matching(reads.scope(facts(spark, sf_dir, "decisions"), "occurred_at", through="1996-06-30"), session_id=[3, 5, 8])
    return reads.member(found, ids, ["call_id"]).select("decision_id", "session_id")


@query("s11_projections", ctes("calls") + "SELECT inference_call_id, org_id, session_id, user_id, gateway_provider, model, duration_ms, value, model_call_id, observed_at FROM calls WHERE model = 'error'")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.without_raw(reads.matching(facts(spark, sf_dir, "calls"), model="error"))


@query("s12_rejected_edits", ctes("rejections") + "SELECT * FROM rejections WHERE session_id IN (1, 2) AND occurred_at <= TIMESTAMP '1997-01-01'")
def rejected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scope(reads.matching(facts(spark, sf_dir, "rejections"), session_id=[1, 2]), "occurred_at", through="1997-01-01")


@query("s13_outcomes_of_commits", ctes("ci_outcomes") + """
SELECT outcome_id, result FROM ci_outcomes WHERE captured_at <= TIMESTAMP '1997-01-01' AND (repository, commit_sha) IN (SELECT ('repo' || (l_suppkey % 5), l_partkey) FROM lineitem WHERE l_linenumber = 2)""")  # fmt: skip
def outcomes_of_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 2")
    keys = lines.select(F.concat(F.lit("repo"), (F.col("l_suppkey") % 5).cast("string")).alias("repository"), F.col("l_partkey").alias("commit_sha"))
    found = reads.scope(facts(spark, sf_dir, "ci_outcomes"), "captured_at", through="1997-01-01")
    return reads.member(found, keys, ["repository", "commit_sha"]).select("outcome_id", "result")


@query("s14_run_receipt", ctes("ci_outcomes") + "SELECT outcome_id, run_attempt, result FROM ci_outcomes WHERE provider = 'github' AND run_id = '3-1-URGENT' AND repository = 'repo1' AND org_id = 'org1'")
def run_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = {"provider": "github", "run_id": "3-1-URGENT", "repository": "repo1", "org_id": "org1"}
    return reads.run_receipt(facts(spark, sf_dir, "ci_outcomes"), run).select("outcome_id", "run_attempt", "result")


@query("s16_push_ages", ctes("pushes") + "SELECT org_id, repo, count(*) AS pushes, max(captured_at) AS last_push FROM pushes WHERE captured_at <= TIMESTAMP '1998-01-01' GROUP BY org_id, repo")
def push_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.push_ages(reads.scope(facts(spark, sf_dir, "pushes"), "captured_at", through="1998-01-01"), ["org_id", "repo"])


@query("s17_session_commits", ctes("edges") + "SELECT commit_sha, session_id, count(*) AS n, min(captured_at) AS first_seen_at FROM edges WHERE captured_at <= TIMESTAMP '1996-01-01' GROUP BY commit_sha, session_id")
def session_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.attachment import session_commits as edges

    return edges(facts(spark, sf_dir, "edges"), "1996-01-01")


@query("s18_merges", ctes("merges") + """
SELECT merge_id, repo, pr_number FROM merges WHERE captured_at <= TIMESTAMP '1998-01-01' AND merged_at <= TIMESTAMP '1997-01-01' AND (repo, pr_number) IN (SELECT ('repo' || (o_custkey % 20), o_orderkey % 50) FROM orders WHERE o_orderstatus = 'P')""")  # fmt: skip
def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'")
    requests = orders.select(F.concat(F.lit("repo"), (F.col("o_custkey") % 20).cast("string")).alias("repo"), (F.col("o_orderkey") % 50).alias("pr_number"))
    return reads.merges(facts(spark, sf_dir, "merges"), requests, "1998-01-01", "1997-01-01").select("merge_id", "repo", "pr_number")


@query("s19_identity_evidence", ctes("pushes", "merges") + """
SELECT 'push' AS role, push_id::varchar AS source_id, repo, repository_provider, repository_host, repository_id, captured_at FROM pushes
UNION ALL SELECT 'merge', merge_id::varchar, repo, repository_provider, repository_host, repository_id, captured_at FROM merges""")  # fmt: skip
def identity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.identity_evidence({"push": (facts(spark, sf_dir, "pushes"), "push_id", "repo"), "merge": (facts(spark, sf_dir, "merges"), "merge_id", "repo")})


@query("s21_delivery_summaries", ctes("pushes", "ci_outcomes") + """,
k AS (SELECT DISTINCT 'repo' || (c_custkey % 20) AS repo, c_custkey AS commit_sha FROM customer),
p AS (SELECT repo, after_sha AS commit_sha, count(*) AS pushes, count(*) FILTER (WHERE forced) AS forced FROM pushes WHERE captured_at <= TIMESTAMP '1997-01-01' GROUP BY ALL),
r AS (SELECT 'repo' || (commit_key % 20) AS repo, commit_key AS commit_sha, count(DISTINCT run_id) AS runs, count(*) FILTER (WHERE result = 'passed') AS passed, count(*) FILTER (WHERE result = 'failed') AS failed FROM ci_outcomes WHERE captured_at <= TIMESTAMP '1997-01-01' GROUP BY ALL)
SELECT repo, commit_sha, coalesce(pushes, 0) AS pushes, coalesce(forced, 0) AS forced, coalesce(runs, 0) AS runs, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed FROM k LEFT JOIN p USING (repo, commit_sha) LEFT JOIN r USING (repo, commit_sha)""")  # fmt: skip
def delivery_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c: F.concat(F.lit("repo"), (F.col(c) % 20).cast("string")).alias("repo")
    commits = spark.read.parquet(f"{sf_dir}/customer.parquet").select(named("c_custkey"), F.col("c_custkey").alias("commit_sha"))
    outcomes = facts(spark, sf_dir, "ci_outcomes").select(named("commit_key"), F.col("commit_key").alias("commit_sha"), "run_id", "result", "captured_at")
    return reads.deliveries(commits, facts(spark, sf_dir, "pushes"), outcomes, "1997-01-01")


@query("s23_context_source", ctes("parts", "quarantine", "edges") + f""", {_HIDDEN},
s AS (SELECT session_id, count(*) FILTER (WHERE fact_id IS NULL) AS parts, coalesce(sum(strlen(text)) FILTER (WHERE fact_id IS NULL), 0)::bigint AS bytes, count(*) FILTER (WHERE fact_id IS NOT NULL) AS quarantined
  FROM parts LEFT JOIN q ON doc_id = fact_id WHERE session_id IN ('src0', 'src1', 'src2') GROUP BY session_id),
w AS (SELECT 'src' || session_id AS session_id, count(DISTINCT commit_sha) AS commits FROM edges GROUP BY 1)
SELECT session_id, parts, bytes, quarantined, coalesce(commits, 0) AS commits FROM s LEFT JOIN w USING (session_id)""")  # fmt: skip
def context_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    granted = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "session_id string")
    parts = facts(spark, sf_dir, "parts").withColumnRenamed("doc_id", "inference_call_id")
    commits = facts(spark, sf_dir, "edges").select(F.concat(F.lit("src"), F.col("session_id").cast("string")).alias("session_id"), "commit_sha")
    return reads.context_source(parts, facts(spark, sf_dir, "quarantine"), granted, commits)


@query("s24_reconciled_ids", ctes("calls", "aliases") + """,
a AS (SELECT alias, min(inference_call_id) AS low, max(inference_call_id) AS high FROM aliases WHERE inference_call_id % 3 = 0 GROUP BY alias),
j AS (SELECT o_orderkey AS w, inference_call_id, low, high FROM orders LEFT JOIN (SELECT inference_call_id FROM calls WHERE model = 'click') ON inference_call_id = o_orderkey LEFT JOIN a ON alias = o_orderkey)
SELECT w::varchar AS wanted, CASE WHEN inference_call_id IS NOT NULL THEN inference_call_id WHEN low = high THEN low END AS inference_call_id,
  CASE WHEN inference_call_id IS NOT NULL THEN 'call' WHEN low = high THEN 'alias' WHEN low IS NOT NULL THEN 'ambiguous' ELSE 'absent' END AS status FROM j""")  # fmt: skip
def reconciled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("wanted"))
    return reads.reconciled(wanted, reads.matching(facts(spark, sf_dir, "calls"), model="click"), facts(spark, sf_dir, "aliases").where("inference_call_id % 3 = 0"))


@query("s25_fact_counts", ctes("calls", "decisions", "quarantine") + f""", {_HIDDEN}
SELECT 'inference_calls' AS fact_table, count(*) AS total, count(*) FILTER (WHERE inference_call_id NOT IN (SELECT fact_id FROM q)) AS visible FROM calls
UNION ALL SELECT 'developer_decisions', count(*), count(*) FROM decisions""")  # fmt: skip
def fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = facts(spark, sf_dir, "quarantine").withColumn("fact_table", F.lit("inference_calls"))
    return reads.counts({"inference_calls": (facts(spark, sf_dir, "calls"), "inference_call_id"), "developer_decisions": (facts(spark, sf_dir, "decisions"), "decision_id")}, log)


@query("s27_snapshot", "SELECT count(*) AS rows, count(*) AS again FROM orders")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = reads.Snapshot(spark, sf_dir)
    first = pinned.table("orders").agg(F.count("*").alias("rows"))
    return first.join(pinned.table("orders").agg(F.count("*").alias("again")))


@query("s28_json_input", "SELECT (props::json->>'k')::bigint AS k, count(*) AS n FROM events GROUP BY 1")
def json_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.from_json("props", "k long", {"mode": "FAILFAST"}).alias("p")).groupBy("p.k").agg(F.count("*").alias("n"))


_NOW = "n AS (SELECT fact_id, arg_max(action, quarantine_revision) AS a FROM quarantine GROUP BY fact_id)"


@query("k03_quarantine_actions", ctes("calls", "quarantine") + f""", {_NOW},
s AS (SELECT DISTINCT session_id FROM calls WHERE model = 'purchase'), t AS (SELECT session_id FROM s LEFT JOIN n ON fact_id = session_id WHERE coalesce(a, 'release') <> 'quarantine')
SELECT session_id AS fact_id, 'quarantine' AS action, 'bulk' AS reason, (SELECT max(quarantine_revision) FROM quarantine) + row_number() OVER (ORDER BY session_id) AS quarantine_revision FROM t""")  # fmt: skip
def quarantine_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = reads.matching(facts(spark, sf_dir, "calls"), model="purchase")
    return reads.quarantine_actions(facts(spark, sf_dir, "quarantine"), chosen, "session_id", "quarantine", "bulk")


@query("k03_release_actions", ctes("quarantine") + f""", {_NOW}
SELECT fact_id, 'release' AS action, 'all clear' AS reason, (SELECT max(quarantine_revision) FROM quarantine) + row_number() OVER (ORDER BY fact_id) AS quarantine_revision FROM n WHERE a = 'quarantine'""")  # fmt: skip
def release_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = facts(spark, sf_dir, "quarantine")
    return reads.quarantine_actions(log, log, "fact_id", "release", "all clear")


@query("f02_inclusive_lookback", ctes("calls") + """
SELECT p.inference_call_id AS push_id, c.inference_call_id FROM calls p JOIN calls c ON p.model = 'error' AND c.model = 'click' AND p.session_id = c.session_id
WHERE c.observed_at BETWEEN p.observed_at - INTERVAL 60 MINUTE AND p.observed_at + INTERVAL 10 MINUTE""")  # fmt: skip
def inclusive_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = facts(spark, sf_dir, "calls")
    pushes = reads.matching(calls, model="error").select(F.col("inference_call_id").alias("push_id"), "session_id", F.col("observed_at").alias("captured_at"))
    both = pushes.join(reads.matching(calls, model="click"), "session_id")
    return both.where(attribution.in_lookback(F.col("observed_at"), F.col("captured_at"), attribution.JACCARD_MINUTES)).select("push_id", "inference_call_id")


@query("f03_cohort", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01' AND l_shipdate <= TIMESTAMP '1996-03-01'")
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return reads.scope(both, "o_orderdate", "1996-01-01", "1996-02-01", "1996-03-01", "l_shipdate").select("l_orderkey", "l_linenumber")


@query("f04_derivation_scope", ctes("calls") + """,
f AS (SELECT session_id, user_id, min(observed_at) AS first_at FROM calls GROUP BY session_id, user_id)
SELECT session_id, user_id, first_at FROM f WHERE first_at >= TIMESTAMP '2024-01-01 06:00:00' AND first_at < TIMESTAMP '2024-01-02' AND user_id IN ('user1', 'user2')""")  # fmt: skip
def derivation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope is applied to what was derived from all facts, so a session's first call isn't the first one inside the scope."""
    derived = facts(spark, sf_dir, "calls").groupBy("session_id", "user_id").agg(F.min("observed_at").alias("first_at"))
    return reads.matching(reads.scope(derived, "first_at", "2024-01-01 06:00:00", "2024-01-02"), user_id=["user1", "user2"])


@query("f05_since_days", ctes("calls") + "SELECT inference_call_id FROM calls WHERE observed_at BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20'")
def since_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.since_days(facts(spark, sf_dir, "calls"), "observed_at", "2024-01-20", 7).select("inference_call_id")


@query("f07_composite_members", ctes("pushes", "merges") + "SELECT merge_id FROM merges WHERE (repo, head_sha) IN (SELECT (repo, after_sha) FROM pushes)")
def composite_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.member(facts(spark, sf_dir, "merges"), facts(spark, sf_dir, "pushes").withColumnRenamed("after_sha", "head_sha"), ["repo", "head_sha"]).select("merge_id")


@query("f08_repository_selector", ctes("pushes") + """
SELECT 'forge/host/3' AS selector, push_id FROM pushes WHERE repository_provider = 'forge' AND repository_host = 'host' AND repository_id = '3'
UNION ALL SELECT 'repo17', push_id FROM pushes WHERE repo = 'repo17' AND repository_id IS NULL""")  # fmt: skip
def repository_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushes = facts(spark, sf_dir, "pushes")
    own = lambda s: reads.selected(pushes, s).select(F.lit(s).alias("selector"), "push_id")
    return own("forge/host/3").unionAll(own("repo17"))


@query("l07_bounded_read", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 5")
def bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.bounded(spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 5").select("s_suppkey", "s_name"), 50_000)
