"""Queries of the full reports over bound facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import Z95, wilson_sql
from ..operators import ci, sequences
from ..operators.confidence import branch
from ..sources.bindings import ctes, facts
from ..sources.shared import Workspace
from . import outcomes, reports
from .fact_queries import _VERDICTS, _kept_verdicts
from .registry import query

_ATT = """e AS (SELECT DISTINCT l_partkey AS commit_key, l_suppkey AS session_id FROM lineitem WHERE l_linenumber = 1),
att AS (SELECT l_orderkey AS call_id, l_partkey AS commit_key, l_suppkey AS session_id, 0.3::double + abs(l_discount) * 7 AS similarity, l_linenumber AS line,
  EXISTS (SELECT 1 FROM e WHERE e.commit_key = l_partkey AND e.session_id = l_suppkey) AS observed FROM lineitem WHERE l_linenumber <= 4),
c AS (SELECT event_id AS call_id, event_type AS model FROM events), r AS (SELECT commit_key, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS verdict FROM v GROUP BY commit_key)"""
_FATES = """fates AS (SELECT l_orderkey * 10 + l_linenumber AS observation_id, l_suppkey AS session_id, l_orderkey AS call_id, CASE WHEN l_discount * 10 <= 0.1::double THEN 'deleted' WHEN l_discount * 10 >= 0.9::double THEN 'unmodified' ELSE 'partial' END AS fate,
  CASE WHEN l_tax > 0.05::double THEN 1 END AS external_added, CASE WHEN l_tax < 0.02::double THEN 2 ELSE 0 END AS external_removed FROM lineitem WHERE l_linenumber IN (2, 3))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _commit(key: str) -> list:
    k = F.col(key)
    named = lambda c, n: F.concat(F.lit(c), (k % n).cast("string"))
    return [named("org", 2).alias("org_id"), named("repo", 5).alias("repository"), F.floor(k / 10).alias("commit_sha"), k.alias("commit_key")]


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    rows = lines.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("call_id"), *_commit("l_partkey"), F.col("l_suppkey").alias("session_id"), (0.3 + F.abs("l_discount") * 7).alias("similarity"), F.col("l_linenumber").alias("line"))
    edges = lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("commit_key"), F.col("l_suppkey").alias("session_id"))
    return outcomes.observed_edges(rows, edges, ["commit_key"])


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("model"))


def _fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_discount") * 10
    return _lines(spark, sf_dir).where("l_linenumber in (2, 3)").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation_id"), F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("call_id"), F.when(s <= 0.1, "deleted").when(s >= 0.9, "unmodified").otherwise("partial").alias("fate"),
        F.when(F.col("l_tax") > 0.05, 1).alias("external_added"), F.when(F.col("l_tax") < 0.02, 2).otherwise(0).alias("external_removed"),
    )


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.resolve(facts(spark, sf_dir, "ci_outcomes"))[0].select(*ci.COMMIT, "verdict")


def _mapped(rows: str, name: str, alias: str, key: str = "*") -> str:
    """SQL of ``outcomes.counted`` by model."""
    return f"(SELECT model, string_agg(k || '=' || n, ',' ORDER BY k) AS {alias} FROM (SELECT model, {name} AS k, count({key}) AS n FROM {rows} GROUP BY ALL) GROUP BY model)"


_REPORT = _VERDICTS + f", {ctes('decisions')[5:]}, {_ATT}, {_FATES}" + """,
t AS (SELECT model, count(*) AS completions FROM c GROUP BY model),
l AS (SELECT model, count(DISTINCT call_id) AS attributed, avg(similarity) AS mean_similarity, count(DISTINCT (commit_key, session_id)) FILTER (WHERE NOT observed) AS unobserved FROM att JOIN c USING (call_id) GROUP BY model),
k AS (SELECT DISTINCT model, commit_key, r.verdict FROM att JOIN c USING (call_id) JOIN r USING (commit_key) WHERE observed AND r.verdict IS NOT NULL),
i AS (SELECT model, count(*) AS ci_linked, count(*) FILTER (WHERE verdict = 'passed') AS ci_passed FROM k GROUP BY model),
f AS (SELECT DISTINCT model, commit_key, run_id, coalesce(nullif(workflow_name, ''), '(unnamed)') AS w FROM k JOIN v USING (commit_key) WHERE k.verdict = 'failed' AND v.verdict = 'failed'),
s AS (SELECT d.*, model FROM decisions d JOIN c USING (call_id)),
x AS (SELECT model, decision_id, bool_and(accepted) AS accepted, min(agent_harness) AS agent_harness FROM s WHERE explicit GROUP BY ALL),
a AS (SELECT model, count(*) FILTER (WHERE accepted) AS explicit_accepts, count(*) FILTER (WHERE NOT accepted) AS explicit_rejects FROM x GROUP BY model),
y AS (SELECT model, session_id, call_id, bool_or(explicit AND accepted) AS ea FROM s GROUP BY ALL),
z AS (SELECT model, observation_id, min(fate) AS fate, bool_or(ea) AS ea, bool_or(coalesce(external_added, 0) > 0 OR coalesce(external_removed, 0) > 0) AS ext FROM fates JOIN y USING (session_id, call_id) GROUP BY ALL)
"""


@query("a03_model_report", _REPORT + f""", o AS (SELECT t.model, completions, coalesce(attributed, 0) AS attributed, coalesce(mean_similarity, 0e0) AS mean_similarity, coalesce(unobserved, 0) AS unobserved, coalesce(ci_linked, 0) AS ci_linked, coalesce(ci_passed, 0) AS ci_passed,
  coalesce(explicit_accepts, 0) AS explicit_accepts, coalesce(explicit_rejects, 0) AS explicit_rejects, coalesce(failures, '') AS failures, coalesce(rejects_by_harness, '') AS rejects_by_harness, coalesce(p.fates, '') AS fates, coalesce(accepted_fates, '') AS accepted_fates, coalesce(external_fates, '') AS external_fates
FROM t LEFT JOIN l USING (model) LEFT JOIN i USING (model) LEFT JOIN a USING (model) LEFT JOIN {_mapped('f', 'w', 'failures')} USING (model) LEFT JOIN {_mapped('(SELECT * FROM x WHERE NOT accepted)', 'agent_harness', 'rejects_by_harness')} USING (model)
LEFT JOIN {_mapped('z', 'fate', 'fates')} p USING (model) LEFT JOIN {_mapped('(SELECT * FROM z WHERE ea)', 'fate', 'accepted_fates')} USING (model) LEFT JOIN {_mapped('(SELECT * FROM z WHERE ext)', 'fate', 'external_fates')} USING (model))
SELECT *, attributed / completions AS attribution_rate, {wilson_sql('attributed', 'completions', 'low')} AS low, {wilson_sql('attributed', 'completions', 'high')} AS high,
  CASE WHEN ci_linked = 0 THEN 0e0 ELSE ci_passed / ci_linked END AS ci_rate, {wilson_sql('ci_passed', 'ci_linked', 'low')} AS ci_low, {wilson_sql('ci_passed', 'ci_linked', 'high')} AS ci_high FROM o""")  # fmt: skip
def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Workspace(spark, "report").save(_kept_verdicts(spark, sf_dir).select(*ci.COMMIT, "run_id", "workflow_name", "verdict", "flake", "reliability"), "kept")
    verdicts = ci.commit_verdicts(kept).select(*ci.COMMIT, "verdict")
    return outcomes.model_outcomes(_calls(spark, sf_dir), _attributed(spark, sf_dir).drop("commit_key"), verdicts, kept, facts(spark, sf_dir, "decisions"), _fates(spark, sf_dir), ci.COMMIT)


@query("a05_signal_stages", _REPORT + """,
g AS (SELECT model, call_id, EXISTS (SELECT 1 FROM att WHERE att.call_id = c.call_id) AS ad, EXISTS (SELECT 1 FROM att JOIN r USING (commit_key) WHERE att.call_id = c.call_id AND observed AND verdict IS NOT NULL) AS lk,
  EXISTS (SELECT 1 FROM decisions d WHERE d.call_id = c.call_id AND explicit) AS sd FROM c),
m AS (SELECT model, count(*) AS completions, count(*) FILTER (WHERE ad) AS attributed, count(*) FILTER (WHERE lk) AS ci_linked, count(*) FILTER (WHERE sd) AS has_decision, count(*) FILTER (WHERE lk OR sd) AS eligible FROM g GROUP BY model)
SELECT *, attributed / completions AS attributed_rate, CASE WHEN attributed = 0 THEN 0e0 ELSE ci_linked / attributed END AS ci_linked_rate, CASE WHEN ci_linked = 0 THEN 0e0 ELSE has_decision / ci_linked END AS has_decision_rate,
  CASE WHEN has_decision = 0 THEN 0e0 ELSE eligible / has_decision END AS eligible_rate FROM m""")  # fmt: skip
def signal_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.signal_funnel(_calls(spark, sf_dir), _attributed(spark, sf_dir).drop("commit_key"), _verdicts(spark, sf_dir), facts(spark, sf_dir, "decisions"), ci.COMMIT)


@query("j09_observed_edges", _VERDICTS + f", {_ATT} SELECT call_id, commit_key, session_id, line, observed FROM att")
def observed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("call_id", "commit_key", "session_id", "line", "observed")


@query("j10_joined_fates", ctes("decisions") + f""", {_FATES}, y AS (SELECT agent_harness, session_id, call_id, bool_or(explicit AND accepted) AS ea FROM decisions GROUP BY ALL)
SELECT agent_harness, observation_id, min(fate) AS fate, bool_or(ea) AS explicit_accept, bool_or(coalesce(external_added, 0) > 0 OR coalesce(external_removed, 0) > 0) AS external FROM fates JOIN y USING (session_id, call_id) GROUP BY ALL""")  # fmt: skip
def joined_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.joined_fates(_fates(spark, sf_dir), facts(spark, sf_dir, "decisions"), ["agent_harness"])


@query("a22_fate_diagnostic", ctes("decisions") + f""", {_FATES}, y AS (SELECT session_id, call_id, bool_or(explicit AND accepted) AS ea FROM decisions GROUP BY ALL),
z AS (SELECT observation_id, min(fate) AS fate, bool_or(ea) AS ea, bool_or(coalesce(external_added, 0) > 0 OR coalesce(external_removed, 0) > 0) AS ext FROM fates JOIN y USING (session_id, call_id) GROUP BY observation_id)
SELECT fate, count(*) AS n, count(*) FILTER (WHERE ea) AS explicit_accepts, count(*) FILTER (WHERE ext) AS with_external_changes FROM z GROUP BY fate""")  # fmt: skip
def fate_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.fate_diagnostic(_fates(spark, sf_dir), facts(spark, sf_dir, "decisions"))


_SIZES = "z AS (SELECT c_custkey, floor(abs(c_acctbal))::bigint % 1200 AS size FROM customer)"
_BIN = "CASE WHEN size <= 0 THEN '0' WHEN size <= 5 THEN '1-5' WHEN size <= 10 THEN '6-10' WHEN size <= 25 THEN '11-25' WHEN size <= 50 THEN '26-50' WHEN size <= 100 THEN '51-100' WHEN size <= 200 THEN '101-200' WHEN size <= 500 THEN '201-500' WHEN size <= 1000 THEN '501-1000' ELSE '>1000' END"


@query("a13_recovery_yield", f"""WITH {_SIZES}, b AS (SELECT size <= 200 AS kept, {_BIN} AS b, min(size) AS low, count(*) AS n FROM z GROUP BY 1, 2), h AS (SELECT kept, string_agg(b || '=' || n, ',' ORDER BY low) AS histogram FROM b GROUP BY kept)
SELECT size <= 200 AS kept, count(*) AS n, min(size) AS low, quantile_cont(size::double, 0.5) AS median, max(size) AS high, (list_sort(list(size)))[ceil(count(*) * 0.9)::bigint]::double AS p90, any_value(histogram) AS histogram FROM z JOIN h ON h.kept = (size <= 200) GROUP BY 1""")  # fmt: skip
def recovery_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.pmod(F.floor(F.abs("c_acctbal")).cast("long"), F.lit(1200)).alias("size"))
    return outcomes.recovery_yield(sizes, "size")


_SESSIONS = """s AS (SELECT l_suppkey % 4 AS stratum, l_orderkey AS session_id, bool_or(l_returnflag <> 'R') AS accepted, bool_or(l_linenumber > 2) AS attributed, CASE l_orderkey % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'passed' END AS verdict,
  CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS merged, bool_or(l_returnflag = 'R') AS rejected, bool_or(l_linenumber > 6) AS retried, l_orderkey % 5 = 1 AS failed_ci, l_orderkey % 11 = 0 AS reverted, min(l_discount) < 0.01::double AS deleted, max(l_tax) > 0.07::double AS external_changes
FROM lineitem GROUP BY ALL)"""


@query("a14_accepted_work", f"""WITH {_SESSIONS}, q AS (SELECT *, accepted AS s1, accepted AND attributed AS s2, accepted AND attributed AND coalesce(verdict IN ('passed', 'failed'), false) AS s3, rejected OR retried OR failed_ci OR reverted OR deleted OR external_changes AS w FROM s),
x AS (SELECT stratum, string_agg(session_id::varchar, ',' ORDER BY session_id) AS examples FROM (SELECT stratum, session_id FROM q WHERE w QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY session_id) <= 3) GROUP BY stratum)
SELECT stratum, count(*) AS sessions, count(*) FILTER (WHERE s1) AS accepted, count(*) FILTER (WHERE s2) AS attributed, count(*) FILTER (WHERE s3) AS resolved, count(*) FILTER (WHERE s3 AND verdict = 'passed') AS passed, count(*) FILTER (WHERE s3 AND verdict = 'passed' AND merged) AS merged,
  count(*) FILTER (WHERE rejected) AS rejected_sessions, count(*) FILTER (WHERE retried) AS retried_sessions, count(*) FILTER (WHERE failed_ci) AS failed_ci_sessions, count(*) FILTER (WHERE reverted) AS reverted_sessions, count(*) FILTER (WHERE deleted) AS deleted_sessions,
  count(*) FILTER (WHERE external_changes) AS external_changes_sessions, count(*) FILTER (WHERE verdict IN ('passed', 'failed')) AS observed, count(*) FILTER (WHERE verdict IS NULL) AS missing, count(*) FILTER (WHERE q.merged IS NULL) AS unsupported, count(*) FILTER (WHERE verdict = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE w) AS reworked, coalesce(any_value(examples), '') AS examples FROM q LEFT JOIN x USING (stratum) GROUP BY stratum""")  # fmt: skip
def accepted_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("session_id")
    grouped = _lines(spark, sf_dir).groupBy((F.col("l_suppkey") % 4).alias("stratum"), F.col("l_orderkey").alias("session_id")).agg(
        F.max(F.col("l_returnflag") != "R").alias("accepted"), F.max(F.col("l_linenumber") > 2).alias("attributed"), F.max(F.col("l_returnflag") == "R").alias("rejected"), F.max(F.col("l_linenumber") > 6).alias("retried"),
        (F.min("l_discount") < 0.01).alias("deleted"), (F.max("l_tax") > 0.07).alias("external_changes"),
    )
    verdict = F.when(key % 5 == 0, "passed").when(key % 5 == 1, "failed").when(key % 5 == 2, "ambiguous").when(key % 5 == 3, "passed")
    flags = {"verdict": verdict, "merged": F.when(key % 7 == 1, False).when(key % 7 > 1, True), "failed_ci": key % 5 == 1, "reverted": key % 11 == 0}
    return outcomes.accepted_work(grouped.withColumns(flags), ["stratum"])


@query("a15_merge_retention", """WITH s AS (SELECT l_returnflag, 'at_head' AS score, abs(l_discount) * 10 AS value FROM lineitem WHERE l_linenumber < 6 UNION ALL SELECT l_returnflag, 'at_merge', abs(l_tax) * 12 FROM lineitem)
SELECT l_returnflag, score, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90,
  concat('0.8=', count(*) FILTER (WHERE value < 0.8::double), ',0.9=', count(*) FILTER (WHERE value < 0.9::double), ',1.0=', count(*) FILTER (WHERE value < 1.0::double)) AS below,
  [count(*) FILTER (WHERE value < 0.8::double) / count(*), count(*) FILTER (WHERE value < 0.9::double) / count(*), count(*) FILTER (WHERE value < 1.0::double) / count(*)] AS rates FROM s GROUP BY ALL""")  # fmt: skip
def merge_retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_returnflag", F.when(F.col("l_linenumber") < 6, F.abs("l_discount") * 10).alias("at_head"), (F.abs("l_tax") * 12).alias("at_merge"))
    return outcomes.retention_summary(rows, ["at_head", "at_merge"], ["l_returnflag"])


_TIMINGS = ctes("calls") + """,
al AS (SELECT user_id AS session_id, ts, min(event_type) AS low, max(event_type) AS high FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id, ts),
fa AS (SELECT session_id, CASE WHEN arg_max(low, ts) = arg_max(high, ts) THEN arg_max(low, ts) END AS arm, min(low) <> max(high) AS changed FROM al GROUP BY session_id),
i AS (SELECT session_id, epoch_us(observed_at) // 1000 AS a, epoch_us(observed_at) // 1000 + duration_ms * 100 AS b FROM calls),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY session_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n),
m AS (SELECT session_id, island, min(a) AS a, max(b) AS b, sum(b - a) AS t FROM g GROUP BY session_id, island),
tm AS (SELECT session_id, max(b) - min(a) AS elapsed, sum(t)::bigint AS model, (max(b) - min(a) - sum(b - a))::bigint AS "between" FROM m GROUP BY session_id),
x AS (SELECT session_id, arm, changed, elapsed, model, "between", CASE WHEN session_id % 2 = 0 THEN 'randomized' ELSE 'default' END AS source FROM fa JOIN tm USING (session_id) WHERE arm IS NOT NULL)"""


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('signup', 'view')").select(F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("arm"))
    final = sequences.final_allocation(events, "session_id", "ts", "arm").where("arm is not null")
    changed = events.groupBy("session_id").agg((F.min("arm") != F.max("arm")).alias("changed"))
    start = F.floor(F.unix_micros(F.col("observed_at").cast("timestamp")) / 1000).cast("long")
    calls = facts(spark, sf_dir, "calls").select("session_id", start.alias("a"), (start + F.col("duration_ms") * 100).alias("b"))
    timed = sequences.busy_time(calls, "session_id", "a", "b").select("session_id", "elapsed", F.col("total").alias("model"), "between")
    return final.join(changed, "session_id").join(timed, "session_id").withColumn("source", F.when(F.col("session_id") % 2 == 0, "randomized").otherwise("default"))


@query("a17_session_timings", _TIMINGS + ' SELECT session_id, source, arm, changed, elapsed, model, "between" FROM x')
def session_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timings(spark, sf_dir).select("session_id", "source", "arm", "changed", "elapsed", "model", "between")


_ARM_SQL = ", ".join(f'quantile_cont("{d}"::double, {q}) AS {d}_{n}' for d in ("elapsed", "model", "between") for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)))


@query("a16_compute_arms", _TIMINGS + f" SELECT source, arm, count(*) AS sessions, count(*) FILTER (WHERE changed) AS changed, {_ARM_SQL} FROM x GROUP BY source, arm")
def compute_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.compute_arms(_timings(spark, sf_dir), ["source", "arm"], ["elapsed", "model", "between"])


@query("a16_arm_differences", _TIMINGS + f""", p AS (SELECT source, arm, {_ARM_SQL} FROM x GROUP BY source, arm)
SELECT a.source, a.arm AS arm_a, b.arm AS arm_b, b.elapsed_median - a.elapsed_median AS elapsed_difference, b.between_median - a.between_median AS between_difference FROM p a JOIN p b ON a.source = b.source AND a.arm < b.arm""")  # fmt: skip
def arm_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = outcomes.compute_arms(_timings(spark, sf_dir), ["source", "arm"], ["elapsed", "between"])
    return outcomes.arm_differences(arms, "source", "arm", ["elapsed", "between"])


@query("a18_dataset_distributions", """WITH b AS (SELECT o_orderpriority AS stratum, unnest([o_orderstatus, 'overall']) AS model, o_totalprice AS v FROM orders)
SELECT stratum, model, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS low, max(v) AS high, CASE WHEN count(*) > 1 THEN stddev_samp(v) ELSE 0e0 END AS deviation FROM b GROUP BY ALL""")  # fmt: skip
def dataset_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("model"), "o_totalprice")
    return outcomes.dataset_distributions(rows, ["stratum"], "model", "o_totalprice")


_SIDES = ctes("decisions") + """,
d AS (SELECT call_id, CASE WHEN bool_or(explicit AND NOT accepted) THEN false WHEN bool_or(explicit AND accepted) THEN true WHEN bool_or(NOT accepted) THEN false WHEN bool_and(agent_harness = 'codex') THEN NULL ELSE true END AS good, min(part) % 400 AS bucket FROM decisions GROUP BY call_id)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = branch(F.col("decisions"))
    grouped = facts(spark, sf_dir, "decisions").groupBy(F.col("call_id").alias("id")).agg(F.collect_list(F.struct("accepted", "explicit", "agent_harness")).alias("decisions"), (F.min("part") % 400).alias("bucket"))
    good = F.when(kind.isin("explicit_accept", "implicit_accept"), True).when(kind.isin("explicit_reject", "implicit_reject"), False)
    return grouped.select("id", "bucket", good.alias("good"))


@query("a20_pair_sparsity", _SIDES + """, s AS (SELECT bucket, count(*) FILTER (WHERE good) AS c, count(*) FILTER (WHERE NOT good) AS r, count(*) AS n FROM d WHERE good IS NOT NULL GROUP BY bucket)
SELECT count(*) AS buckets, sum(n)::bigint AS candidates, concat('1=', count(*) FILTER (WHERE n = 1), ',2=', count(*) FILTER (WHERE n = 2), ',3-5=', count(*) FILTER (WHERE n BETWEEN 3 AND 5), ',6-10=', count(*) FILTER (WHERE n BETWEEN 6 AND 10), ',10+=', count(*) FILTER (WHERE n > 10)) AS histogram,
  count(*) FILTER (WHERE n = 1) AS alone, count(*) FILTER (WHERE c * r > 3) AS capped, count(*) FILTER (WHERE n = 1) / sum(n) AS alone_share FROM s""")  # fmt: skip
def pair_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.pair_sparsity(_sides(spark, sf_dir), ["bucket"])


_PAIRS = "WITH p AS (SELECT least(1e0, n_chars / 4000e0) AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return both.select(F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"), F.col("quality").alias("label"))


@query("a23_bin_inversions", _PAIRS + """, b AS (SELECT least(floor(score * 10), 9)::integer AS bin, count(*) AS n, avg(label::double) AS rate FROM p GROUP BY 1)
SELECT a.bin AS lower_bin, c.bin AS upper_bin, a.rate AS lower_rate, c.rate AS upper_rate FROM b a JOIN b c ON a.bin < c.bin AND a.rate > c.rate""")  # fmt: skip
def bin_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.bin_inversions(reports.calibration(_pairs(spark, sf_dir), "score", "label"))


@query("a25_best_threshold", _PAIRS + f""", s AS (SELECT h.t AS threshold, count(*) FILTER (WHERE score >= h.t AND label = 1) AS tp, count(*) FILTER (WHERE score >= h.t AND label = 0) AS fp, count(*) FILTER (WHERE score < h.t AND label = 1) AS fn
  FROM p CROSS JOIN (VALUES (0.1::double), (0.3::double), (0.5::double), (0.7::double), (0.9::double)) h(t) GROUP BY h.t),
f AS (SELECT *, tp / (tp + fp) AS precision, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s), b AS (SELECT threshold AS best, f1 AS best_f1, precision AS bp FROM f ORDER BY f1 DESC, threshold LIMIT 1),
o AS (SELECT threshold, f1, best, best_f1, bp, {wilson_sql('tp', '(tp + fp)', 'low')} AS low, {wilson_sql('tp', '(tp + fp)', 'high')} AS high FROM f, b WHERE threshold = 0.7::double)
SELECT threshold, f1, best, best_f1, low, high, best <> threshold AND NOT bp BETWEEN low AND high AS drift FROM o""")  # fmt: skip
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.best_threshold(reports.threshold_sweep(_pairs(spark, sf_dir), "score", "label", [0.1, 0.3, 0.5, 0.7, 0.9]), 0.7)


@query("j16_recovery_evidence", ctes("ci_outcomes") + """,
s AS (SELECT commit_key, result, lag(result) OVER w AS before, lag(commit_key) OVER w AS red_commit FROM ci_outcomes WHERE result IN ('passed', 'failed') WINDOW w AS (PARTITION BY org_id, repository, branch, provider, workflow_id ORDER BY captured_at, outcome_id)),
p AS (SELECT red_commit, commit_key AS green_commit FROM s WHERE result = 'passed' AND before = 'failed'),
a AS (SELECT l_partkey AS green_commit, count(DISTINCT l_orderkey) AS calls, count(DISTINCT l_suppkey) AS sessions, max(0.3::double + abs(l_discount) * 7) AS similarity FROM lineitem WHERE l_linenumber = 4 GROUP BY l_partkey)
SELECT red_commit, green_commit, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions, similarity, CASE WHEN calls > 0 THEN 'attributed' ELSE 'none' END AS evidence FROM p LEFT JOIN a USING (green_commit)""")  # fmt: skip
def recovery_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir, "ci_outcomes").withColumn("commit_sha", F.col("commit_key"))
    pairs = ci.red_to_green(rows, ["org_id", "repository", "branch", "provider", "workflow_id"]).select("red_commit", "green_commit")
    found = _lines(spark, sf_dir).where("l_linenumber = 4").select(F.col("l_partkey").alias("green_commit"), F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("session_id"), (0.3 + F.abs("l_discount") * 7).alias("similarity"))
    return outcomes.enriched_recoveries(pairs, found)


@query("w12_trajectory", "SELECT l_suppkey AS session_id, l_partkey AS commit_sha, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_returnflag, l_partkey, l_orderkey * 10 + l_linenumber)::integer AS position FROM lineitem")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("session_id"), F.col("l_partkey").alias("commit_sha"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_shipdate", "l_returnflag")
    return outcomes.trajectory(commits, "session_id", "l_shipdate", ["l_returnflag", "commit_sha", "id"]).select("session_id", "commit_sha", "id", "position")


@query("x11_two_proportions", f"""WITH r AS (SELECT event_type AS model, count(*)::double AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::double AS s FROM events GROUP BY 1),
p AS (SELECT a.model AS l, b.model AS r, a.n AS na, b.n AS nb, a.s / a.n AS p, b.s / b.n AS q, (a.s + b.s) / (a.n + b.n) AS o FROM r a JOIN r b ON a.model < b.model),
e AS (SELECT *, sqrt(o * (1 - o) * (1 / na + 1 / nb)) AS pe, sqrt(p * (1 - p) / na + q * (1 - q) / nb) AS ue FROM p)
SELECT l AS "left", r AS "right", p - q AS difference, CASE WHEN pe > 0 THEN (p - q) / pe END AS z, p - q - {Z95!r}::double * ue AS low, p - q + {Z95!r}::double * ue AS high, pe = 0 AS degenerate, least(na, nb) < 30 AS insufficient, 10 AS comparisons FROM e""")  # fmt: skip
def two_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("successes"))
    return outcomes.two_proportions(rates, "model", F.lit(Z95), F.lit(10))
