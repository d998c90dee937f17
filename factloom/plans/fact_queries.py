"""Queries over bound facts: scans, visibility, joins, CI, ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import split_of, split_score, wilson_sql
from ..functions.times import micros
from ..operators import attachment, ci, sequences, visibility
from ..sources.bindings import ctes, facts
from . import reports
from .registry import query

_RUN = "org_id, provider, repository_provider, repository_host, run_id"
_COMMIT = "org_id, repository, commit_sha"
_RUNS = ctes("ci_outcomes") + f""",
run_attempts AS (SELECT {_RUN}, coalesce(run_attempt, 0) AS attempt, count(DISTINCT result) AS results FROM ci_outcomes GROUP BY ALL),
run_results AS (SELECT {_RUN}, max(results) AS results FROM run_attempts GROUP BY ALL),
run_reasons AS (SELECT {_RUN}, CASE WHEN count(DISTINCT ({_COMMIT})) > 1 THEN 'commit_conflict' WHEN count(DISTINCT branch) > 1 THEN 'branch_conflict'
    WHEN count(DISTINCT nullif(workflow_id, '')) > 1 OR count(DISTINCT nullif(workflow_name, '')) > 1 OR count(DISTINCT nullif(workflow_path, '')) > 1 THEN 'workflow_conflict'
    WHEN max(results) > 1 THEN 'attempt_conflict' END AS reason
  FROM ci_outcomes JOIN run_results USING ({_RUN}) GROUP BY {_RUN})"""
_VERDICTS = _RUNS + f""",
v AS (SELECT {_COMMIT}, {_RUN[8:]}, min(workflow_name) AS workflow_name, min(commit_key) AS commit_key,
  arg_max(result, run_attempt * 1000000000 + outcome_id) FILTER (WHERE result IN ('passed', 'failed')) AS verdict,
  bool_or(result = 'passed') AND bool_or(result = 'failed') AS flake, count(*) AS attempts FROM ci_outcomes JOIN run_reasons USING ({_RUN}) WHERE reason IS NULL GROUP BY {_COMMIT}, {_RUN[8:]})"""


@query("a01_ci_resolution", _VERDICTS + f"""
SELECT {_COMMIT}, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS verdict,
  CASE WHEN min(verdict) = max(verdict) THEN min(CASE WHEN verdict IS NOT NULL THEN CASE WHEN flake THEN 0e0 ELSE 1e0 END END) END AS reliability,
  count(*) AS workflows, count(*) FILTER (WHERE flake) AS flakes,
  CASE WHEN min(verdict) IS NULL THEN 'no_verdict' WHEN min(verdict) <> max(verdict) THEN 'ambiguous_workflow_verdicts' END AS reason
FROM v GROUP BY {_COMMIT}""")  # fmt: skip
def ci_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.resolve(facts(spark, sf_dir, "ci_outcomes"))[0]


@query("a01_declined_runs", _RUNS + f" SELECT {_RUN}, reason FROM run_reasons WHERE reason IS NOT NULL")
def declined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.resolve(facts(spark, sf_dir, "ci_outcomes"))[1]


@query("a02_run_consistency", _RUNS + f" SELECT {_RUN}, reason FROM run_reasons")
def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.consistent_runs(facts(spark, sf_dir, "ci_outcomes"))


def _kept_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = facts(spark, sf_dir, "ci_outcomes")
    tasks = ci.tasks_of(outcomes)
    return ci.workflow_verdicts(ci.same_key(outcomes, ci.consistent_runs(outcomes, tasks).where("reason is not null"), ci.RUN, "left_anti"), tasks)


@query("a03_pass_rates", _VERDICTS + f""",
s AS (SELECT workflow_name, count(*) AS n, sum(CASE WHEN verdict = 'passed' THEN 1 ELSE 0 END)::bigint AS successes FROM v WHERE verdict IS NOT NULL GROUP BY workflow_name)
SELECT workflow_name, n, successes, successes / n AS rate, {wilson_sql('successes', 'n', 'low')} AS low, {wilson_sql('successes', 'n', 'high')} AS high FROM s""")  # fmt: skip
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _kept_verdicts(spark, sf_dir).where("verdict is not null")
    return reports.outcome_rates(verdicts.withColumn("ok", F.col("verdict") == "passed"), ["workflow_name"], "ok")


@query("f01_visibility", ctes("calls", "quarantine") + """,
q AS (SELECT fact_id FROM quarantine GROUP BY fact_id HAVING arg_max(action, quarantine_revision) = 'quarantine')
SELECT inference_call_id, session_id, model FROM calls WHERE session_id NOT IN (SELECT fact_id FROM q)""")  # fmt: skip
def visible_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.visible(facts(spark, sf_dir, "calls"), facts(spark, sf_dir, "quarantine"), "session_id").select("inference_call_id", "session_id", "model")


@query("a28_session_coverage", ctes("calls", "quarantine") + """,
q AS (SELECT fact_id FROM quarantine GROUP BY fact_id HAVING arg_max(action, quarantine_revision) = 'quarantine')
SELECT model, count(*) AS total, count(*) FILTER (WHERE q.fact_id IS NULL) AS visible, count(*) FILTER (WHERE q.fact_id IS NOT NULL) AS quarantined
FROM calls LEFT JOIN q ON session_id = q.fact_id GROUP BY model""")  # fmt: skip
def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.coverage(facts(spark, sf_dir, "calls"), facts(spark, sf_dir, "quarantine"), "session_id", "model")


@query("s03_attribution_candidates", ctes("calls") + """
SELECT inference_call_id, session_id FROM calls
WHERE observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08' OR (session_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND observed_at < TIMESTAMP '2024-01-15')""")  # fmt: skip
def attribution_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = facts(spark, sf_dir, "calls")
    noted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("session_id"), F.lit(True).alias("noted"))
    marked = calls.join(noted, "session_id", "left")
    in_window = F.col("observed_at").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-08").cast("timestamp"))
    by_note = F.col("noted") & (F.col("observed_at") < F.lit("2024-01-15").cast("timestamp"))
    return marked.where(in_window | F.coalesce(by_note, F.lit(False))).select("inference_call_id", "session_id")


@query("s15_keyset_page", ctes("ci_outcomes") + """
SELECT outcome_id, captured_at FROM ci_outcomes WHERE result = 'failed' AND (captured_at < TIMESTAMP '1997-01-01' OR (captured_at = TIMESTAMP '1997-01-01' AND outcome_id < 500))
ORDER BY captured_at DESC, outcome_id DESC LIMIT 51""")  # fmt: skip
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = facts(spark, sf_dir, "ci_outcomes").where("result = 'failed'").select("outcome_id", "captured_at")
    return visibility.keyset_page(failed, "captured_at", "outcome_id", 50, (F.lit("1997-01-01").cast("timestamp"), 500))


@query("s20_session_dossier", ctes("calls", "decisions") + """
SELECT session_id, observed_at AS "at", 'inference_calls' AS fact_table, inference_call_id::varchar AS fact_id FROM calls
UNION ALL SELECT session_id, occurred_at, 'developer_decisions', decision_id::varchar FROM decisions""")  # fmt: skip
def session_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"inference_calls": (facts(spark, sf_dir, "calls"), "observed_at", "inference_call_id"), "developer_decisions": (facts(spark, sf_dir, "decisions"), "occurred_at", "decision_id")}
    return visibility.dossier(tables, "session_id")


@query("s26_quarantine_revision", ctes("quarantine") + "\nSELECT coalesce(max(quarantine_revision), 0) AS quarantine_revision FROM quarantine")
def quarantine_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "quarantine").agg(F.coalesce(F.max("quarantine_revision"), F.lit(0)).alias("quarantine_revision"))


@query("k01_first_write_wins", ctes("decisions") + """
SELECT session_id, file_path, arg_min(decision_id, (occurred_at, decision_id)) AS decision_id FROM decisions GROUP BY session_id, file_path""")  # fmt: skip
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = facts(spark, sf_dir, "decisions").select("session_id", "file_path", "occurred_at", "decision_id")
    return visibility.first_written(decisions, ["session_id", "file_path"], ["occurred_at", "decision_id"]).drop("occurred_at")


@query("k02_session_upsert", ctes("calls") + """
SELECT session_id, CASE WHEN min(model) = max(model) THEN min(model) END AS user, min(model) <> max(model) AS user_conflict, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at
FROM calls GROUP BY session_id""")  # fmt: skip
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.session_upsert(facts(spark, sf_dir, "calls"), "session_id", "model", "observed_at")


_ALIASES = """SELECT event_id % 50000 AS alias, event_id AS inference_call_id, 1 AS org_id, user_id % 3 AS session_id FROM {events}"""
_ATTACHED = ctes("decisions") + f""", aliases AS ({_ALIASES.format(events='events')}),
o AS (SELECT alias, min(inference_call_id) AS owner, max(inference_call_id) AS other, min(session_id) AS s FROM aliases GROUP BY alias),
j AS (SELECT decision_id, owner, CASE WHEN alias IS NULL THEN 'unmatched_call_id' WHEN owner <> other THEN 'ambiguous_decision_call_id' WHEN d.session_id % 3 <> o.s THEN 'session_mismatch' END AS reason
  FROM decisions d LEFT JOIN o ON d.call_id = o.alias)
"""


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = facts(spark, sf_dir, "decisions").select("decision_id", "call_id", F.lit(1).alias("org_id"), (F.col("session_id") % 3).alias("session_id"))
    aliases = spark.sql(_ALIASES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return attachment.attach_decisions(decisions, aliases)


@query("j01_decision_attachment", _ATTACHED + "SELECT decision_id, CASE WHEN reason IS NULL THEN owner END AS owner, reason FROM j")
def decision_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).select("decision_id", "owner", "reason")


@query("j01_decision_skips", _ATTACHED + "SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def decision_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachment.skip_counts(_attached(spark, sf_dir))


@query("j02_subsumed_decisions", ctes("decisions") + """
SELECT decision_id FROM decisions d WHERE NOT (agent_harness = 'codex' AND file_path = '' AND EXISTS
  (SELECT 1 FROM decisions e WHERE e.agent_harness = 'codex' AND e.file_path <> '' AND e.session_id = d.session_id AND e.accepted = d.accepted AND e.explicit = d.explicit AND e.occurred_at = d.occurred_at))""")  # fmt: skip
def subsumed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachment.drop_subsumed(facts(spark, sf_dir, "decisions"), "codex", ["session_id", "accepted", "explicit", "occurred_at"]).select("decision_id")


@query("j03_retention_fill", ctes("decisions") + """,
o AS (SELECT session_id, part, arg_min(score, (occurred_at, observation_id)) AS s FROM
  (SELECT session_id, part, decision_id AS observation_id, occurred_at, edit_retention_score * 1.5 AS score FROM decisions WHERE edit_retention_score IS NOT NULL) GROUP BY session_id, part)
SELECT decision_id, coalesce(edit_retention_score, least(1e0, greatest(0e0, s))) AS edit_retention_score FROM decisions LEFT JOIN o USING (session_id, part)""")  # fmt: skip
def retention_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = facts(spark, sf_dir, "decisions")
    seen = decisions.select("session_id", "part", F.col("decision_id").alias("observation_id"), "occurred_at", (F.col("edit_retention_score") * 1.5).alias("score"))
    return attachment.fill_retention(decisions, seen, ["session_id", "part"]).select("decision_id", "edit_retention_score")


@query("j07_commit_owner", "SELECT l_partkey AS commit_sha, arg_min(l_orderkey * 10 + l_linenumber, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS push_id FROM lineitem GROUP BY l_partkey")
def commit_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("commit_sha"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("push_id"), F.col("l_shipdate").alias("captured_at"))
    return attachment.commit_owners(ranges)


@query("j08_pr_membership", """
WITH c AS (SELECT l_orderkey AS outcome_id, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS merge_id, l_linenumber <> 7 AS resolved FROM lineitem),
g AS (SELECT outcome_id, count(DISTINCT merge_id) AS n, min(merge_id) AS merge_id, bool_or(NOT resolved) AS open FROM c GROUP BY outcome_id)
SELECT outcome_id, CASE WHEN open THEN 'unresolved' WHEN n = 1 THEN 'joined' WHEN n = 0 THEN 'without_merge' ELSE 'ambiguous' END AS status, CASE WHEN NOT open AND n = 1 THEN merge_id END AS merge_id FROM g""")  # fmt: skip
def pr_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    candidates = lines.select(F.col("l_orderkey").alias("outcome_id"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("merge_id"), (F.col("l_linenumber") != 7).alias("resolved"))
    return attachment.pull_request_membership(candidates)


@query("j15_price_interval", """
WITH p AS (SELECT p_type AS model, p_retailprice AS price, date_trunc('year', TIMESTAMP '1992-01-01' + INTERVAL (p_size) MONTH) AS f FROM part),
prices AS (SELECT model, f AS valid_from, lead(f) OVER (PARTITION BY model ORDER BY f) AS valid_until, price FROM (SELECT model, f, max(price) AS price FROM p GROUP BY model, f))
SELECT l_orderkey, l_linenumber, price FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN prices ON model = p_type AND l_shipdate >= valid_from AND (valid_until IS NULL OR l_shipdate < valid_until)""")  # fmt: skip
def price_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    starts = part.groupBy(F.col("p_type").alias("model"), F.date_trunc("year", F.expr("timestamp'1992-01-01' + make_interval(0, p_size)")).alias("valid_from")).agg(F.max("p_retailprice").alias("price"))
    prices = starts.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy("model").orderBy("valid_from")))
    calls = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_type").alias("model"), "l_shipdate")
    return attachment.price_at(calls, prices, "l_shipdate").select("l_orderkey", "l_linenumber", "price")


@query("j17_retry_linkage", """
WITH t AS (SELECT conv_id, turn, role, text, length(text) % 3 AS file FROM conversations WHERE role <> 'system'),
r AS (SELECT * FROM t WHERE role = 'assistant' AND length(text) % 2 = 0), a AS (SELECT * FROM t WHERE role = 'assistant' AND length(text) % 2 = 1)
SELECT r.conv_id AS session_id, r.turn AS rejected_turn, min(a.turn) AS accepted_turn, r.file AS file_path FROM r JOIN a ON r.conv_id = a.conv_id AND r.file = a.file AND a.turn > r.turn
WHERE EXISTS (SELECT 1 FROM t u WHERE u.conv_id = r.conv_id AND u.role = 'user' AND u.turn > r.turn AND u.turn < a.turn) GROUP BY r.conv_id, r.turn, r.file""")  # fmt: skip
def retry_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = facts(spark, sf_dir, "turns").where("role <> 'system'")
    id_ = F.format_string("%d-%d", "session_id", "turn")
    edits = turns.where("role = 'assistant'").select("session_id", (F.length("text") % 3).alias("file_path"), F.lit("edit").alias("tool_name"), F.col("turn").alias("position"), id_.alias("id"), (F.length("text") % 2).alias("odd"))
    found = attachment.retry_links(edits.where("odd = 0").drop("odd"), edits.where("odd = 1").drop("odd"), turns.where("role = 'user'").select("session_id", F.col("turn").alias("position")))
    number = lambda c: F.split_part(c, F.lit("-"), F.lit(2)).cast("long")
    return found.select("session_id", number(F.col("rejected_id")).alias("rejected_turn"), number(F.col("accepted_id")).alias("accepted_turn"), F.col("file_path").cast("long").alias("file_path"))


@query("w01_tail_sums", ctes("edits") + """
SELECT call_id, CASE WHEN max(CASE WHEN lines_added IS NULL OR lines_removed IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN (sum(lines_added) OVER w)::bigint END AS tail_lines_added,
  CASE WHEN max(CASE WHEN lines_added IS NULL OR lines_removed IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN (sum(lines_removed) OVER w)::bigint END AS tail_lines_removed
FROM edits WINDOW w AS (PARTITION BY session_id, file_id ORDER BY occurred_at, call_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")  # fmt: skip
def tail_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.tail_sums(facts(spark, sf_dir, "edits"), ["session_id", "file_id"], ["occurred_at", "call_id"], ["lines_added", "lines_removed"])
    return out.select("call_id", "tail_lines_added", "tail_lines_removed")


@query("w02_turn_segments", ctes("turns") + """,
s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (role = 'user' AND lag(role) OVER w = 'assistant') THEN 1 ELSE 0 END AS b FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT session_id, turn, (sum(b) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::bigint AS segment FROM s""")  # fmt: skip
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("turn")
    starts = (F.col("role") == "user") & (F.lag("role").over(w) == "assistant")
    return sequences.segments(facts(spark, sf_dir, "turns"), "session_id", ["turn"], starts).select("session_id", "turn", "segment")


_LINEAGE = "org_id, repository, branch, provider, workflow_id"


@query("w03_red_to_green", ctes("ci_outcomes") + f""",
s AS (SELECT {_LINEAGE}, outcome_id, commit_sha, result, captured_at, lag(result) OVER w AS before, lag(outcome_id) OVER w AS red_id, lag(commit_sha) OVER w AS red_commit, lag(captured_at) OVER w AS red_at
  FROM ci_outcomes WHERE result IN ('passed', 'failed') WINDOW w AS (PARTITION BY {_LINEAGE} ORDER BY captured_at, outcome_id))
SELECT {_LINEAGE}, red_id, red_commit, outcome_id AS green_id, commit_sha AS green_commit, epoch_us(captured_at) - epoch_us(red_at) AS micros FROM s WHERE result = 'passed' AND before = 'failed'""")  # fmt: skip
def red_to_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.red_to_green(facts(spark, sf_dir, "ci_outcomes"), _LINEAGE.split(", "))


@query("w04_busy_time", ctes("calls") + """,
i AS (SELECT session_id, epoch_us(observed_at) // 1000 AS a, epoch_us(observed_at) // 1000 + duration_ms * 100 AS b FROM calls),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY session_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n),
m AS (SELECT session_id, island, min(a) AS a, max(b) AS b, sum(b - a) AS t FROM g GROUP BY session_id, island)
SELECT session_id, max(b) - min(a) AS elapsed, sum(t)::bigint AS total, sum(b - a)::bigint AS busy, (max(b) - min(a) - sum(b - a))::bigint AS "between" FROM m GROUP BY session_id""")  # fmt: skip
def busy_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(micros("observed_at") / 1000).cast("long")
    calls = facts(spark, sf_dir, "calls").select("session_id", start.alias("a"), (start + F.col("duration_ms") * 100).alias("b"))
    return sequences.busy_time(calls, "session_id", "a", "b")


@query("a17_final_allocation", """
WITH l AS (SELECT user_id AS session_id, ts, min(event_type) AS low, max(event_type) AS high FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id, ts)
SELECT session_id, CASE WHEN arg_max(low, ts) = arg_max(high, ts) THEN arg_max(low, ts) END AS arm, arg_max(low, ts) <> arg_max(high, ts) AS ambiguous FROM l GROUP BY session_id""")  # fmt: skip
def final_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('signup', 'view')").select(F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("arm"))
    return sequences.final_allocation(events, "session_id", "ts", "arm")


@query("w07_quantile_buckets", ctes("calls") + """
SELECT inference_call_id, CAST(((row_number() OVER (PARTITION BY model ORDER BY duration_ms, inference_call_id)) * 4 - 1) // (count(*) OVER (PARTITION BY model)) AS integer) AS bucket FROM calls""")  # fmt: skip
def quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.quantile_buckets(facts(spark, sf_dir, "calls"), "duration_ms", "inference_call_id", 4, ["model"]).select("inference_call_id", "bucket")


@query("w08_round_robin", ctes("calls") + """
SELECT inference_call_id, model FROM calls QUALIFY true ORDER BY row_number() OVER (PARTITION BY model ORDER BY inference_call_id), model LIMIT 23""")  # fmt: skip
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.round_robin(facts(spark, sf_dir, "calls"), ["model"], "inference_call_id", 23).select("inference_call_id", "model")


@query("w10_prefix_checkpoints", ctes("calls") + """,
r AS (SELECT model, value > 50 AS ok, row_number() OVER (PARTITION BY model ORDER BY observed_at, inference_call_id) AS i, count(*) OVER (PARTITION BY model) AS n FROM calls)
SELECT model, f.fraction, count(*) AS n, sum(CASE WHEN ok THEN 1 ELSE 0 END)::bigint AS successes FROM r CROSS JOIN (VALUES (0.25::double), (0.5::double), (1.0::double)) f(fraction) WHERE i <= ceil(r.n * f.fraction) GROUP BY model, f.fraction""")  # fmt: skip
def prefix_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = facts(spark, sf_dir, "calls").withColumn("ok", F.col("value") > 50)
    return sequences.prefix_checkpoints(trials, ["model"], ["observed_at", "inference_call_id"], "ok", [0.25, 0.5, 1.0])


_BLOCKS = ctes("calls") + """,
r AS (SELECT model, CASE WHEN value > 50 THEN 1 ELSE 0 END AS ok, (row_number() OVER (PARTITION BY model ORDER BY observed_at, inference_call_id) * 10 - 1) // count(*) OVER (PARTITION BY model) AS block FROM calls),
b AS (SELECT model, block::integer AS block, count(*) AS n, sum(ok)::bigint AS successes FROM r GROUP BY ALL)"""


@query("w10_disjoint_blocks", _BLOCKS + " SELECT * FROM b")
def disjoint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = facts(spark, sf_dir, "calls").withColumn("ok", F.col("value") > 50)
    return sequences.disjoint_blocks(trials, ["model"], ["observed_at", "inference_call_id"], "ok")


@query("w10_effect_decay", _BLOCKS + """,
h AS (SELECT a.model AS "left", b.model AS "right", a.block, abs(2 * asin(sqrt(a.successes / a.n)) - 2 * asin(sqrt(b.successes / b.n))) AS e FROM b a JOIN b ON a.block = b.block AND a.model < b.model),
s AS (SELECT x."left", x."right", sum(sign(y.e - x.e))::bigint AS s FROM h x JOIN h y ON x."left" = y."left" AND x."right" = y."right" AND x.block < y.block GROUP BY ALL),
t AS (SELECT "left", "right", sum(t)::bigint AS n, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT "left", "right", e, count(*) AS t FROM h GROUP BY ALL) GROUP BY ALL),
z AS (SELECT "left", "right", n, s, (n * (n - 1) * (2 * n + 5) - tied) / 18.0::double AS v FROM s JOIN t USING ("left", "right")),
w AS (SELECT model, sum(successes) / sum(n) AS p FROM b GROUP BY model)
SELECT "left", "right", z.n AS blocks, s, CASE WHEN v > 0 THEN (s - sign(s)) / sqrt(v) ELSE 0e0 END AS z, CASE WHEN v > 0 THEN (s - sign(s)) / sqrt(v) < -1.959963984540054::double ELSE false END AS decreasing, abs(2 * asin(sqrt(l.p)) - 2 * asin(sqrt(r.p))) AS effect
FROM z JOIN w l ON l.model = "left" JOIN w r ON r.model = "right" """)  # fmt: skip
def effect_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do differences between models' rates shrink as calls arrive? Trend over ten disjoint blocks, not over nested prefixes."""
    trials = facts(spark, sf_dir, "calls").withColumn("ok", F.col("value") > 50)
    order = ["observed_at", "inference_call_id"]
    return sequences.effect_decay(sequences.disjoint_blocks(trials, ["model"], order, "ok"), "model", sequences.prefix_checkpoints(trials, ["model"], order, "ok", [1.0]))


@query("w16_external_changes", ctes("edits") + """
SELECT call_id, lead(lines_removed) OVER w AS next_before, CASE WHEN lead(lines_removed) OVER w IS NOT NULL THEN lead(lines_removed) OVER w <> lines_added END AS changed_outside
FROM edits WINDOW w AS (PARTITION BY session_id, file_id ORDER BY occurred_at, call_id)""")  # fmt: skip
def external_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.external_changes(facts(spark, sf_dir, "edits"), "session_id", "file_id", ["occurred_at", "call_id"], "lines_removed", "lines_added")
    return out.select("call_id", "next_before", "changed_outside")


@query("d04_fates", ctes("decisions") + """
SELECT decision_id, CASE WHEN edit_retention_score IS NULL THEN NULL WHEN least(1e0, greatest(0e0, edit_retention_score)) <= 0.1::double THEN 'deleted' WHEN least(1e0, greatest(0e0, edit_retention_score)) >= 0.9::double THEN 'unmodified' ELSE 'partial' END AS fate FROM decisions""")  # fmt: skip
def fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "decisions").select("decision_id", sequences.fate(F.col("edit_retention_score")).alias("fate"))


@query("d12_stale_repositories", "SELECT o_custkey, max(o_orderdate) AS last_push FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '1998-06-01' - INTERVAL 90 DAY")
def stale_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.latest_pushes(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderdate", "1998-06-01")


@query("d18_rewards", _VERDICTS + """,
t AS (SELECT c_nationkey AS session_id, commit_key AS commit_sha, verdict FROM v JOIN customer ON commit_key = c_custkey),
k AS (SELECT session_id, max((commit_sha, verdict)) FILTER (WHERE verdict IS NOT NULL) AS m FROM t GROUP BY session_id)
SELECT session_id, m[1] AS commit_sha, CASE m[2] WHEN 'passed' THEN 1 WHEN 'failed' THEN 0 END AS reward FROM k""")  # fmt: skip
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projections import rewards as of

    key = F.col("c_custkey")
    named = lambda c, n: F.concat(F.lit(c), (key % n).cast("string"))
    sessions = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        named("org", 2).alias("org_id"), named("repo", 5).alias("repository"), F.floor(key / 10).alias("commit_sha"), F.col("c_nationkey").alias("session_id"), key.alias("position")
    )
    placed = _kept_verdicts(spark, sf_dir).join(sessions, ci.COMMIT).withColumn("commit_sha", F.col("position"))
    return of(placed)


@query("x05_split", """
SELECT doc_id, h.s AS score, CASE WHEN h.s < 0.1::double THEN 'eval' ELSE 'train' END AS split
FROM documents, LATERAL (SELECT (('0x' || substr(sha256(doc_id::varchar), 1, 16))::ubigint)::double / 18446744073709551616::double AS s) h""")  # fmt: skip
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.col("doc_id").cast("string")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", split_score(session).alias("score"), split_of(session, 0.1).alias("split"))
