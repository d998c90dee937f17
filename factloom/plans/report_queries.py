"""Queries of reports, statistics, text scores and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import Z95, corpus_floor, wilson_sql
from ..functions.times import micros
from ..operators import attribution, sequences
from ..operators.confidence import ConfidencePolicy, branch_of, confidence, reliability, unreliable_confidence
from ..sources.bindings import ctes, facts
from . import projections, reports
from .registry import query

_TRIALS = ctes("calls") + ", t AS (SELECT *, session_id % 4 AS repo, CASE WHEN value > 50 THEN 1 ELSE 0 END AS ok FROM calls)"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "calls").withColumn("repo", F.col("session_id") % 4).withColumn("ok", F.col("value") > 50)


@query("a03_model_outcomes", _TRIALS + f""", s AS (SELECT model, count(*) AS n, sum(ok)::bigint AS successes FROM t GROUP BY model)
SELECT model, n, successes, successes / n AS rate, {wilson_sql('successes', 'n', 'low')} AS low, {wilson_sql('successes', 'n', 'high')} AS high FROM s""")  # fmt: skip
def model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcome_rates(_trials(spark, sf_dir), ["model"], "ok")


@query("a04_commit_grain", _TRIALS + """, c AS (SELECT model, session_id, max(ok) AS ok FROM t GROUP BY model, session_id)
SELECT model, count(*) AS n, sum(ok)::bigint AS successes FROM c GROUP BY model""")  # fmt: skip
def commit_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    grain = _trials(spark, sf_dir).groupBy("model", "session_id").agg(F.max("ok").alias("ok"))
    return reports.outcome_rates(grain, ["model"], "ok").select("model", "n", "successes")


@query("a05_signal_funnel", _TRIALS + """
SELECT model, count(DISTINCT session_id) AS called, count(DISTINCT CASE WHEN ok = 1 THEN session_id END) AS accepted, count(DISTINCT CASE WHEN ok = 1 AND duration_ms > 8000 THEN session_id END) AS kept,
  CASE WHEN count(DISTINCT session_id) = 0 THEN 0e0 ELSE count(DISTINCT CASE WHEN ok = 1 THEN session_id END) / count(DISTINCT session_id) END AS accepted_rate,
  CASE WHEN count(DISTINCT CASE WHEN ok = 1 THEN session_id END) = 0 THEN 0e0 ELSE count(DISTINCT CASE WHEN ok = 1 AND duration_ms > 8000 THEN session_id END) / count(DISTINCT CASE WHEN ok = 1 THEN session_id END) END AS kept_rate
FROM t GROUP BY model""")  # fmt: skip
def signal_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(_trials(spark, sf_dir), ["model"], "session_id", {"called": F.lit(True), "accepted": F.col("ok"), "kept": F.col("duration_ms") > 8000})


_BUCKETS = _TRIALS + """, b AS (SELECT model, (epoch_us(observed_at) - epoch_us(TIMESTAMP '2024-01-01')) // 172800000000 AS bucket, count(*) AS n, sum(ok)::bigint AS successes FROM t GROUP BY 1, 2)"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tumbling(_trials(spark, sf_dir), ["model"], "observed_at", "ok", 2, "2024-01-01")


@query("a06_tumbling_trend", _BUCKETS + "SELECT model, bucket, n, successes, successes / n AS rate FROM b")
def tumbling_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir)


@query("w09_mann_kendall", _BUCKETS + """, p AS (SELECT model, bucket, successes AS x FROM b),
s AS (SELECT a.model, sum(sign(c.x - a.x))::bigint AS s FROM p a JOIN p c ON a.model = c.model AND a.bucket < c.bucket GROUP BY a.model),
g AS (SELECT model, sum(t)::bigint AS n, sum(t * (t - 1) * (2 * t + 5))::bigint AS tied FROM (SELECT model, x, count(*) AS t FROM p GROUP BY model, x) GROUP BY model),
v AS (SELECT model, n, s, (n * (n - 1) * (2 * n + 5) - tied) / 18e0 AS variance FROM g JOIN s USING (model))
SELECT model, n, s, variance, CASE WHEN variance > 0 THEN (s - sign(s)) / sqrt(variance) ELSE 0e0 END AS z FROM v""")  # fmt: skip
def mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.mann_kendall(_buckets(spark, sf_dir), ["model"], "bucket", "successes")


@query("a07_strata", _TRIALS + " SELECT model, repo, count(*) AS n, sum(ok)::bigint AS successes FROM t GROUP BY GROUPING SETS ((model), (model, repo))")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.strata(_trials(spark, sf_dir), "model", "repo", "ok")


_CELLS = _TRIALS + ", c AS (SELECT model, repo, count(*)::double AS n, sum(ok)::double AS s, sum(ok)::double / count(*) AS p FROM t GROUP BY GROUPING SETS ((model), (model, repo)))"


@query("a07_reversals", _CELLS + """,
d AS (SELECT a.model AS "left", b.model AS "right", a.repo, a.p - b.p AS d FROM c a JOIN c b ON a.model < b.model AND a.repo IS NOT DISTINCT FROM b.repo),
w AS (SELECT "left", "right", d FROM d WHERE repo IS NULL)
SELECT w."left", w."right", w.d AS difference, count(*)::integer AS strata, (count(*) FILTER (WHERE sign(d.d) = -sign(w.d)))::integer AS reversed,
  count(*) FILTER (WHERE sign(d.d) = -sign(w.d)) = count(*) AND w.d <> 0 AS paradox FROM d JOIN w ON d."left" = w."left" AND d."right" = w."right" WHERE d.repo IS NOT NULL GROUP BY w."left", w."right", w.d""")  # fmt: skip
def reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reversals(_trials(spark, sf_dir), "model", "repo", "ok")


@query("a08_mantel_haenszel", _CELLS + """
SELECT a.model AS "left", b.model AS "right", sum(a.n * b.n / (a.n + b.n) * (a.p - b.p)) / sum(a.n * b.n / (a.n + b.n)) AS risk_difference
FROM c a JOIN c b ON a.model < b.model AND a.repo = b.repo GROUP BY a.model, b.model""")  # fmt: skip
def mantel_haenszel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mantel_haenszel(_trials(spark, sf_dir), "model", "repo", "ok")


_RATES = _TRIALS + ", r AS (SELECT model, count(*)::double AS n, sum(ok)::double AS s FROM t GROUP BY model)"


@query("a09_shrinkage", _RATES + """,
m AS (SELECT sum(n) AS total, sum(s) / sum(n) AS mean, count(*) AS g FROM r), b AS (SELECT m.*, (SELECT sum(n * (s / n - mean) * (s / n - mean)) FROM r, m) / total - mean * (1 - mean) * g / total AS between_ FROM m),
k AS (SELECT *, CASE WHEN between_ > 0 THEN greatest(mean * (1 - mean) / between_ - 1, 0e0) ELSE total END AS k FROM b)
SELECT model, (s + k * mean) / (n + k) AS shrunken FROM r, k""")  # fmt: skip
def shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _trials(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.count_if("ok").alias("successes"))
    return reports.shrunken(rates).select("model", "shrunken")


@query("j13_model_pairs", _RATES + """
SELECT a.model AS "left", b.model AS "right", a.s / a.n - b.s / b.n AS difference, 2 * asin(sqrt(a.s / a.n)) - 2 * asin(sqrt(b.s / b.n)) AS h,
  (a.s / a.n - b.s / b.n) / sqrt((a.s + b.s) / (a.n + b.n) * (1 - (a.s + b.s) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) AS z FROM r a JOIN r b ON a.model < b.model""")  # fmt: skip
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pairwise(_trials(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.count_if("ok").alias("successes")), "model")


@query("a11_attribution_share", _TRIALS + f""",
s AS (SELECT repo, count(*) AS n, sum(ok)::bigint AS successes FROM t GROUP BY repo)
SELECT repo, n, successes, successes / n AS rate, {wilson_sql('successes', 'n', 'low')} AS low, {wilson_sql('successes', 'n', 'high')} AS high FROM s""")  # fmt: skip
def attribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcome_rates(_trials(spark, sf_dir), ["repo"], "ok")


def _share_sql(part: str) -> str:
    return f"SELECT repo, count(*) AS n, sum(ok)::bigint AS successes, {wilson_sql('sum(ok)', 'count(*)', 'low')} AS low, {wilson_sql('sum(ok)', 'count(*)', 'high')} AS high FROM t2 WHERE {part} GROUP BY repo"


@query("a12_share_alerts", ctes("calls") + f""", t2 AS (SELECT observed_at, session_id % 40 AS repo, CASE WHEN value > 90 - 40 * (session_id % 3) AND (observed_at < TIMESTAMP '2024-01-16' OR session_id % 3 > 0) THEN 1 ELSE 0 END AS ok FROM calls),
c AS ({_share_sql("observed_at >= TIMESTAMP '2024-01-16'")}), b AS ({_share_sql("observed_at < TIMESTAMP '2024-01-16'")}),
a AS (SELECT c.repo, CASE WHEN c.successes = 0 THEN 'zero_share' WHEN c.n >= 20 AND b.n >= 20 AND c.high < b.low THEN 'decline' END AS alert FROM c LEFT JOIN b USING (repo))
SELECT repo, alert FROM a WHERE alert IS NOT NULL""")  # fmt: skip
def share_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("observed_at") >= F.lit("2024-01-16").cast("timestamp")
    kind = F.col("session_id") % 3
    calls = facts(spark, sf_dir, "calls").withColumn("repo", F.col("session_id") % 40).withColumn("ok", (F.col("value") > 90 - 40 * kind) & (~late | (kind > 0)))
    return reports.share_alerts(reports.outcome_rates(calls.where(late), ["repo"], "ok"), reports.outcome_rates(calls.where(~late), ["repo"], "ok"), "repo", 20)


@query("a13_size_histogram", """WITH z AS (SELECT l_quantity * 20 AS size FROM lineitem)
SELECT CASE WHEN size <= 0 THEN '0' WHEN size <= 5 THEN '1-5' WHEN size <= 10 THEN '6-10' WHEN size <= 25 THEN '11-25' WHEN size <= 50 THEN '26-50' WHEN size <= 100 THEN '51-100' WHEN size <= 200 THEN '101-200'
  WHEN size <= 500 THEN '201-500' WHEN size <= 1000 THEN '501-1000' ELSE '>1000' END AS bin, count(*) AS n FROM z GROUP BY 1""")  # fmt: skip
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") * 20).alias("size")), "size")


@query("a16_compute_quartiles", ctes("calls") + """
SELECT model, count(*) AS n, avg(duration_ms) AS mean, quantile_cont(duration_ms::double, 0.1) AS p10, quantile_cont(duration_ms::double, 0.25) AS q1, quantile_cont(duration_ms::double, 0.5) AS median,
  quantile_cont(duration_ms::double, 0.75) AS q3, quantile_cont(duration_ms::double, 0.9) AS p90 FROM calls GROUP BY model""")  # fmt: skip
def compute_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quartiles(facts(spark, sf_dir, "calls"), ["model"], "duration_ms")


@query("a18_dataset_diagnostics", "SELECT o_orderpriority AS stratum, CASE WHEN grouping(o_orderstatus) = 1 THEN 'overall' ELSE o_orderstatus END AS model, count(*) AS n, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, coalesce(stddev_samp(o_totalprice), 0e0) AS deviation FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))")
def dataset_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("model"), "o_totalprice")
    return reports.diagnostics(rows, "stratum", "model", "o_totalprice")


@query("a19_split_leaks", """
WITH r AS (SELECT lower(trim(text)) AS prompt, conv_id % 2 = 0 AS e FROM conversations WHERE role = 'user')
SELECT prompt, count(*) FILTER (WHERE NOT e) AS train, count(*) FILTER (WHERE e) AS eval FROM r GROUP BY prompt HAVING bool_or(e) AND bool_or(NOT e)""")  # fmt: skip
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").withColumn("split", F.when(F.col("conv_id") % 2 == 0, "eval").otherwise("train"))
    return reports.split_leaks(rows, "text", "split")


@query("a20_bucket_sparsity", ctes("decisions") + """, s AS (SELECT count(*) AS n FROM decisions GROUP BY session_id, part)
SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '10+' END AS size_bin, count(*) AS buckets, sum(n)::bigint AS rows FROM s GROUP BY 1""")  # fmt: skip
def bucket_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bucket_sparsity(facts(spark, sf_dir, "decisions"), ["session_id", "part"])


_PAIRS = "WITH p AS (SELECT least(1e0, n_chars / 4000e0) AS score, quality AS label, toxic FROM documents JOIN labels USING (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return both.select(F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"), F.col("quality").alias("label"), "toxic")


@query("a23_calibration_bins", _PAIRS + """, b AS (SELECT least(floor(score * 10), 9)::integer AS bin, count(*) AS n, avg(score) AS mean_score, avg(label::double) AS rate FROM p GROUP BY 1)
SELECT *, abs(mean_score - rate) AS gap FROM b""")  # fmt: skip
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calibration(_pairs(spark, sf_dir), "score", "label")


@query("a23_calibration_summary", _PAIRS + """, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM p),
b AS (SELECT count(*) AS n, abs(avg(score) - avg(label::double)) AS gap FROM p GROUP BY least(floor(score * 10), 9))
SELECT (SELECT count(*) FROM p) AS n, (SELECT avg((score - label) * (score - label)) FROM p) AS brier,
  (SELECT (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label))) FROM k) AS auroc, (SELECT sum(n * gap) / sum(n) FROM b) AS ece""")  # fmt: skip
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calibration_summary(_pairs(spark, sf_dir), "score", "label")


@query("a24_agreement", _PAIRS + """, t AS (SELECT count(*) AS n, avg((label = toxic)::integer) AS agreement, avg(label::double) * avg(toxic::double) + (1 - avg(label::double)) * (1 - avg(toxic::double)) AS e FROM p)
SELECT n, agreement, (agreement - e) / (1 - e) AS kappa, false AS degenerate FROM t""")  # fmt: skip
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.agreement(_pairs(spark, sf_dir), "label", "toxic")


@query("a25_threshold_sweep", _PAIRS + """, s AS (SELECT h.t AS threshold, count(*) FILTER (WHERE score >= h.t AND label = 1) AS tp, count(*) FILTER (WHERE score >= h.t AND label = 0) AS fp, count(*) FILTER (WHERE score < h.t AND label = 1) AS fn
  FROM p CROSS JOIN (VALUES (0.1::double), (0.3::double), (0.5::double), (0.7::double), (0.9::double)) h(t) GROUP BY h.t)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s""")  # fmt: skip
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_sweep(_pairs(spark, sf_dir), "score", "label", [0.1, 0.3, 0.5, 0.7, 0.9])


@query("a26_corpus_floor", ctes("decisions") + f""", g AS (SELECT agent_harness, count(*) AS cases, avg(accepted::int)::double AS p FROM decisions GROUP BY agent_harness)
SELECT agent_harness, m AS margin, cases, ceil({Z95!r}::double * {Z95!r}::double * 0.25::double / (m * m))::bigint AS floor, cases >= ceil({Z95!r}::double * {Z95!r}::double * 0.25::double / (m * m)) AS enough, {Z95!r}::double * sqrt(p * (1 - p) / cases) AS reached FROM g, (VALUES (0.1::double), (0.05::double), (0.02::double), (0.005::double)) t(m)""")  # fmt: skip
def corpus_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled decisions of each harness a rate needs for a margin, whatever the rate is, and which margin the labels that are there reach."""
    sums = facts(spark, sf_dir, "decisions").groupBy("agent_harness").agg(F.count("*").alias("cases"), F.avg(F.col("accepted").cast("double")).alias("p"))
    margins = F.array(*(F.struct(F.lit(m).alias("margin"), F.lit(corpus_floor(m)).cast("long").alias("floor")) for m in (0.1, 0.05, 0.02, 0.005)))
    each = sums.select("*", F.explode(margins).alias("m"))
    return each.select("agent_harness", "m.margin", "cases", "m.floor", (F.col("cases") >= F.col("m.floor")).alias("enough"), (Z95 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("cases"))).alias("reached"))


def _ladder_sql(base=0.6, accept=1.0, reject=0.0, up=1.1, down=0.9, ci_pass=1.1, ci_fail=0.7, clean=1.0, flake=0.0) -> str:
    """The ladder's numbers as SQL, written out once more."""
    d = lambda v: f"{float(v)!r}::double"
    kept = "least(1e0, greatest(0e0, ret))"
    decision = f"CASE WHEN kind IN ('abandoned', 'explicit_reject') THEN {d(reject)} WHEN kind = 'explicit_accept' THEN {d(accept)} WHEN kind = 'implicit_reject' THEN {d(base)} * {d(down)} WHEN kind = 'neutral' THEN {d(base)} ELSE {d(base)} * coalesce({d(down)} + ({d(up)} - {d(down)}) * {kept}, {d(up)}) END"
    ci = f"CASE verdict WHEN 'passed' THEN {d(ci_pass)} WHEN 'failed' THEN {d(ci_fail)} ELSE 1e0 END * CASE WHEN verdict IS NULL THEN 1e0 WHEN flake THEN {d(flake)} ELSE {d(clean)} END"
    return f"least(1e0, greatest(0e0, {decision} * {ci} * coalesce(sim, 1e0)))"


_SAID = ctes("decisions") + f""",
d AS (SELECT call_id, bool_or(explicit AND NOT accepted) AS er, bool_or(explicit AND accepted) AS ea, bool_or(NOT accepted) AS ir, bool_and(agent_harness = 'codex') AS cx, min(edit_retention_score) AS ret,
  max(CASE WHEN accepted THEN edit_retention_score END) AS kept FROM decisions GROUP BY call_id),
b AS (SELECT *, CASE WHEN ea AND call_id % 13 = 0 THEN 'abandoned' WHEN er THEN 'explicit_reject' WHEN ea THEN 'explicit_accept' WHEN ir THEN 'implicit_reject' WHEN cx THEN 'neutral' ELSE 'implicit_accept' END AS kind,
  CASE call_id % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END AS verdict, call_id % 3 < 2 AND call_id % 5 = 1 AS flake, call_id % 3 = 1 OR call_id % 11 = 2 AS failed, call_id % 7 = 3 AS non_verdict, CASE WHEN call_id % 5 = 0 THEN 0.8::double END AS sim FROM d),
c AS (SELECT *, {_ladder_sql()} AS confidence FROM b)
"""


def _scored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by their decisions, with a verdict, suspected flakes, failed workflows, abandoned accepts and similarities by rules over their ids."""
    accepted, explicit, i = F.col("accepted"), F.col("explicit"), F.col("call_id")
    grouped = facts(spark, sf_dir, "decisions").groupBy("call_id").agg(
        F.bool_or(explicit & ~accepted).alias("vetoed"), F.bool_or(explicit & accepted).alias("accepted"), F.bool_or(~accepted).alias("ir"), F.bool_and(F.col("agent_harness") == "codex").alias("cx"),
        F.min("edit_retention_score").alias("ret"), F.max(F.when(accepted, F.col("edit_retention_score"))).alias("kept"),
    )
    said = branch_of(F.col("vetoed"), F.col("accepted"), F.col("ir"), F.col("cx"), F.lit(True))
    marked = grouped.withColumns({
        "kind": F.when(F.col("accepted") & (i % 13 == 0), "abandoned").otherwise(said), "verdict": F.when(i % 3 == 0, "passed").when(i % 3 == 1, "failed"), "flake": (i % 3 < 2) & (i % 5 == 1), "failed": (i % 3 == 1) | (i % 11 == 2),
        "non_verdict": i % 7 == 3, "similarity": F.when(i % 5 == 0, F.lit(0.8)),
    })
    return marked.withColumn("confidence", confidence(F.col("kind"), F.col("ret"), F.col("verdict"), reliability(F.col("verdict"), F.col("flake")), F.col("similarity")))


@query("x08_confidence", _SAID + "SELECT call_id, kind, confidence FROM c")
def label_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_calls(spark, sf_dir).select("call_id", "kind", "confidence")


#: The knobs of the confidence policy and the grid of each.
KNOBS = {
    "explicit_accept": [0.8, 0.9, 1.0], "explicit_reject": [0.0, 0.1, 0.2], "base": [0.4, 0.5, 0.6, 0.7, 0.8], "up": [1.0, 1.1, 1.2, 1.3, 1.4, 1.5], "down": [0.5, 0.7, 0.9, 1.0, 1.1], "ci_pass": [1.0, 1.1, 1.2, 1.3],
    "ci_fail": [0.5, 0.7, 0.9, 1.0], "clean_reliability": [0.8, 0.9, 1.0], "suspected_flake_reliability": [0.0, 0.25, 0.5, 0.75, 1.0], "non_verdict_reliability": [0.5, 0.75, 1.0],
}

_SOURCE = "CASE WHEN kind = 'abandoned' OR er OR failed THEN NULL WHEN ea THEN 'explicit_accept' WHEN kept >= 0.8::double THEN 'edit_retention' END"
_TOUCHED = {
    "explicit_accept": ("accept", "kind = 'explicit_accept'"), "explicit_reject": ("reject", "kind IN ('abandoned', 'explicit_reject')"), "base": ("base", "kind IN ('implicit_reject', 'neutral', 'implicit_accept')"), "up": ("up", "kind = 'implicit_accept'"),
    "down": ("down", "kind IN ('implicit_reject', 'implicit_accept')"), "ci_pass": ("ci_pass", "coalesce(verdict = 'passed', false)"), "ci_fail": ("ci_fail", "coalesce(verdict = 'failed', false)"), "clean_reliability": ("clean", "verdict IS NOT NULL AND NOT flake"),
    "suspected_flake_reliability": ("flake", "verdict IS NOT NULL AND flake"), "non_verdict_reliability": ("", "verdict IS NOT NULL AND non_verdict"),
}
_GRID = " UNION ALL ".join(f"SELECT source, '{k}' AS knob, {v!r}::double AS setting, {_TOUCHED[k][1]} AS hit, {_ladder_sql(**({_TOUCHED[k][0]: v} if _TOUCHED[k][0] else {}))} AS v, confidence AS own, older FROM o" for k, grid in KNOBS.items() for v in grid)
_OLDER = _ladder_sql(clean=1.0, flake=1.0).replace("CASE verdict", "CASE coalesce(CASE WHEN flake THEN 'passed' END, verdict)")


@query("a27_sensitivity", _SAID + f""", o AS (SELECT *, {_SOURCE} AS source, {_OLDER} AS older FROM c), g AS ({_GRID})
SELECT source, knob, setting, count(*) FILTER (WHERE hit) AS affected, count(*) AS n, avg(v) AS mean, median(v) AS median, avg(v) - avg(own) AS mean_delta, median(v) - median(own) AS median_delta, count(*) FILTER (WHERE source IS NOT NULL AND v >= 0.6::double) AS eligible,
  count(*) FILTER (WHERE source IS NOT NULL AND v >= 0.6::double) - count(*) FILTER (WHERE source IS NOT NULL AND own >= 0.6::double) AS eligible_delta, avg(older) AS older_mean, count(*) FILTER (WHERE source IS NOT NULL AND older >= 0.6::double) AS older_eligible FROM g GROUP BY ALL""")  # fmt: skip
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_calls(spark, sf_dir).withColumnRenamed("ret", "retention").withColumn("source", projections.eligibility("sft_curated")[0])
    kind, kept, verdict, flake, similarity = map(F.col, ("kind", "retention", "verdict", "flake", "similarity"))
    score = lambda p: confidence(kind, kept, verdict, reliability(verdict, flake, p), similarity, p)
    older = unreliable_confidence(kind, kept, F.when(flake | (verdict == "passed"), True).when(verdict == "failed", False), similarity)
    return projections.rescored(rows, score, older, KNOBS, ConfidencePolicy())


_WHY = {
    "sft_curated": f"CASE WHEN kind = 'abandoned' THEN 'abandoned' WHEN er THEN 'explicit_reject' WHEN failed THEN 'resolved_ci_failure' WHEN {_SOURCE} IS NULL THEN 'no_eligibility_source' WHEN confidence < 0.6::double THEN 'below_confidence_floor' END",
    "sft_verified": "CASE WHEN kind = 'abandoned' THEN 'abandoned' WHEN er THEN 'explicit_reject' WHEN failed THEN 'resolved_ci_failure' WHEN verdict IS DISTINCT FROM 'passed' THEN 'no_eligibility_source' WHEN flake THEN 'unreliable_ci_resolution' WHEN confidence < 0.6::double THEN 'below_confidence_floor' END",
}


@query("d15_curated_samples", _SAID + f"SELECT coalesce({_WHY['sft_curated']}, 'kept') AS reason, count(*) AS n FROM c GROUP BY 1")
def curated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = projections.below_floor(projections.eligibility("sft_curated")[1], F.col("confidence"))
    return _scored_calls(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("a21_floor_exclusion", _SAID + "SELECT kind AS model, count(*) AS calls, count(*) FILTER (WHERE confidence < 0.6::double) AS excluded, count(*) FILTER (WHERE confidence < 0.6::double) / count(*) AS rate FROM c GROUP BY kind")
def floor_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.best_confidence(_scored_calls(spark, sf_dir).withColumnRenamed("kind", "model"), "model", "call_id")


@query("d14_preference_pairs", _SAID + """, x AS (SELECT call_id % 500 AS bucket, call_id AS id, confidence, CASE WHEN kind IN ('explicit_accept', 'implicit_accept') THEN true WHEN kind IN ('explicit_reject', 'implicit_reject') THEN false END AS good FROM c),
g AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS i FROM x WHERE good), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) AS i FROM x WHERE NOT good),
p AS (SELECT g.bucket, g.id AS chosen_id, r.id AS rejected_id, g.confidence AS a, r.confidence AS b, row_number() OVER (PARTITION BY g.bucket ORDER BY g.id, r.id) AS n FROM g JOIN r ON g.bucket = r.bucket AND g.i <= 3 AND r.i <= 3)
SELECT bucket, chosen_id, rejected_id, a AS chosen_confidence, b AS rejected_confidence, a - b AS margin, least(a, b) AS label_confidence FROM p WHERE n <= 3""")  # fmt: skip
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.when(F.col("kind").isin("explicit_accept", "implicit_accept"), True).when(F.col("kind").isin("explicit_reject", "implicit_reject"), False)
    rows = _scored_calls(spark, sf_dir).select((F.col("call_id") % 500).alias("bucket"), F.col("call_id").alias("id"), "confidence", good.alias("good"), F.col("call_id").cast("string").alias("text"))
    return projections.preference_pairs(rows, ["bucket"])


@query("d16_diff_samples", ctes("decisions") + """
SELECT call_id AS call, session_id AS commit_sha, min(agent_harness) AS source, min(coalesce(edit_retention_score, 0.5::double)) AS confidence, string_agg(part::varchar, chr(10) ORDER BY decision_id, part::varchar) AS diff
FROM decisions GROUP BY call_id, session_id HAVING min(agent_harness) = max(agent_harness)""")  # fmt: skip
def diff_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = facts(spark, sf_dir, "decisions").select(
        F.col("call_id").alias("call"), F.col("session_id").alias("commit_sha"), F.col("agent_harness").alias("source"), F.coalesce("edit_retention_score", F.lit(0.5)).alias("confidence"),
        F.col("decision_id").alias("position"), F.col("part").cast("string").alias("patch"),
    )
    return projections.diff_samples(members)


@query("d19_decision_latency", """
WITH j AS (SELECT l_orderkey, min((epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000) AS latency, min(abs(l_discount)) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY l_orderkey),
b AS (SELECT *, ((row_number() OVER (ORDER BY latency, l_orderkey)) * 5 - 1) // count(*) OVER () AS bucket FROM j)
SELECT bucket::integer AS bucket, count(*) AS n, min(latency) AS low, max(latency) AS high, avg(confidence) AS mean_confidence FROM b GROUP BY bucket""")  # fmt: skip
def decision_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("l_orderkey", "o_orderdate", "l_shipdate", F.abs("l_discount").alias("confidence"))
    return projections.decision_latency(rows, "l_orderkey", "o_orderdate", "l_shipdate", 5)


@query("j18_precision", """
WITH m AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey AS commit_sha FROM lineitem WHERE l_returnflag <> 'N'), f AS (SELECT l_orderkey AS call_id, l_suppkey AS commit_sha, l_linestatus AS source FROM lineitem WHERE l_linenumber <= 3)
SELECT coalesce(source, 'none') AS source, count(*) FILTER (WHERE f.call_id IS NOT NULL AND m.call_id IS NOT NULL) AS tp, count(*) FILTER (WHERE m.call_id IS NULL) AS fp, count(*) FILTER (WHERE f.call_id IS NULL) AS fn
FROM f FULL OUTER JOIN m ON f.call_id = m.call_id AND f.commit_sha = m.commit_sha GROUP BY 1""")  # fmt: skip
def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("commit_sha"), "l_returnflag", F.col("l_linestatus").alias("source"), "l_linenumber")
    return reports.precision_against(lines.where("l_returnflag <> 'N'"), lines.where("l_linenumber <= 3"), ["call_id", "commit_sha"])


@query("x01_tokens", r"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: lower(x)))) AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("x03_containment", """
WITH a AS (SELECT item_id, unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS g FROM benchmark WHERE length(text) >= 4), an AS (SELECT item_id, g, count(*) AS n FROM a GROUP BY ALL),
f AS (SELECT conv_id * 100 + turn AS file_id, unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS g FROM conversations WHERE length(text) >= 4), fn AS (SELECT file_id, g, count(*) AS m FROM f GROUP BY ALL),
s AS (SELECT item_id AS applied_id, file_id, sum(least(n, m)) AS shared FROM an JOIN fn USING (g) GROUP BY item_id, file_id)
SELECT applied_id, file_id, shared / (length(text) - 3) AS containment FROM s JOIN benchmark ON item_id = applied_id""")  # fmt: skip
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("applied_id"), F.col("text").alias("applied"))
    files = facts(spark, sf_dir, "turns").select((F.col("session_id") * 100 + F.col("turn")).alias("file_id"), F.col("text").alias("file"))
    return T.containment(applied, files)


_KEY = "[A-Za-z0-9\\-._~+/]{16,}=*"


@query("f14_redaction", rf"""
WITH r AS (SELECT doc_id, concat('id ', text, ' Authorization: Bearer ', sha256(text), ' then bearer ', md5(text), ' and sk-', md5(text)) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?i)(\bAuthorization\s*[:=]\s*Bearer[ \t]+){_KEY}', '\1[REDACTED_CREDENTIAL]', 'g') AS t FROM r)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?i)(\bBearer[ \t]+){_KEY}', '\1[REDACTED_CREDENTIAL]', 'g'), ' sk-[A-Za-z0-9_-]{{16,}}$', ' [REDACTED_CREDENTIAL]')) AS redacted,
  len(regexp_extract_all(t, '(?i)(\bBearer[ \t]+){_KEY}'))::integer AS bearers FROM b""")  # fmt: skip
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("id "), t, F.lit(" Authorization: Bearer "), F.sha2(t, 256), F.lit(" then bearer "), F.md5(t), F.lit(" and sk-"), F.md5(t)).alias("t"))
    return docs.select("doc_id", F.md5(T.redact(F.col("t"))).alias("redacted"), T.redaction_counts(F.col("t"))["bearer_token"].alias("bearers"))


@query("d13_context_retrieval", """
WITH p AS (SELECT doc_id, source AS session_id, text, len(list_intersect(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: lower(x))), ['license', 'token', 'password', 'released']))::integer AS matched FROM documents),
u AS (SELECT session_id, text, matched, min(doc_id) AS doc_id FROM p WHERE matched > 0 GROUP BY session_id, text, matched)
SELECT session_id, doc_id, matched FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY matched DESC, doc_id) <= 8""")  # fmt: skip
def context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    parts = facts(spark, sf_dir, "parts").select("doc_id", "session_id", F.xxhash64("text").alias("content"), T.tokens(F.col("text")).alias("tokens"))
    found = attribution.keyword_overlap(parts, ["license", "token", "password", "released"])
    each = found.groupBy("session_id", "content", "matched").agg(F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("session_id").orderBy(F.desc("matched"), "doc_id")
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("session_id", "doc_id", "matched")


@query("a29_session_status", ctes("decisions") + """
SELECT session_id, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND explicit) AS explicit, max(epoch_us(occurred_at)) FILTER (WHERE accepted) AS last_accepted,
  CASE WHEN session_id IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity = 50) THEN 'committed' ELSE 'attribution_unavailable' END AS status FROM decisions GROUP BY session_id HAVING bool_or(accepted)""")  # fmt: skip
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = facts(spark, sf_dir, "decisions").where("accepted").groupBy("session_id").agg(F.count("*").alias("accepted"), F.count_if("explicit").alias("explicit"), F.max(micros("occurred_at")).alias("last_accepted"))
    committed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'A' and l_quantity = 50").select(F.col("l_suppkey").alias("session_id"), F.lit(True).alias("c")).distinct()
    return grouped.join(committed, "session_id", "left").select("session_id", "accepted", "explicit", "last_accepted", F.when(F.col("c"), "committed").otherwise("attribution_unavailable").alias("status"))
