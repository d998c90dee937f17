"""Queries of rollouts: turns and segments, decisions of turns, rewards of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rollouts
from ..sources.bindings import facts
from .registry import query

#: A call for each turn of a conversation. Its input is the history, but its own turn alone in every third session; some replies are empty and some echoes edited.
_TURNS = """t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT *, conv_id % 5 = 4 AND i % 3 = 2 AS absent, conv_id % 7 = 6 AND i % 4 = 3 AS edited FROM t),
g AS (SELECT *, lag(absent) OVER w AS before_absent, lag(edited) OVER w AS before_edited FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CASE WHEN i = 1 THEN NULL WHEN before_absent THEN 'prior_output_absent' WHEN conv_id % 3 = 0 OR before_edited THEN 'input_history_changed' WHEN edited THEN 'prior_output_not_replayed' END AS reason FROM g),
a AS (SELECT conv_id * 100 + turn AS id, 't' || conv_id || '-' || CASE WHEN conv_id % 4 = 1 THEN i % 3 ELSE i END AS alias FROM t), u AS (SELECT alias, min(id) AS id FROM a GROUP BY alias HAVING count(*) = 1),
d AS (SELECT conv_id * 1000 + turn * 10 + k AS decision_id, CASE WHEN conv_id % 9 = 8 THEN NULL WHEN conv_id % 9 = 7 THEN 'gone' ELSE 't' || conv_id || '-' || CASE WHEN conv_id % 4 = 1 THEN i % 3 ELSE i END END AS call_id, k = 0 AS accepted FROM t, range(2) k(k) WHERE k = 0 OR turn % 2 = 1),
e AS (SELECT id, count(*) AS decisions, count(*) FILTER (WHERE accepted) AS accepted, min(decision_id) AS first_decision FROM d JOIN u ON alias = call_id GROUP BY id),
s AS (SELECT conv_id AS session_id, turn, conv_id * 100 + turn AS id, (sum(CASE WHEN i = 1 OR reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::bigint AS segment, reason,
  CASE WHEN conv_id % 3 = 0 THEN 1 WHEN i = 1 OR reason IS NOT NULL THEN 2 * i - 1 ELSE 2 END::integer AS new_messages FROM r)"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("session_id").orderBy("turn")
    rows = facts(spark, sf_dir, "turns").withColumn("i", F.row_number().over(order)).withColumn("id", F.col("session_id") * 100 + F.col("turn"))
    conv, i, turn = F.col("session_id"), F.col("i"), F.col("turn")
    text = lambda role, content: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), content.alias("content"))).alias("parts"))
    said = text("user", F.concat(F.lit("u"), turn.cast("string"), "text"))
    reply = text("assistant", F.when((conv % 5 == 4) & (i % 3 == 2), "").otherwise(F.concat(F.lit("r"), turn.cast("string"))))
    upto = F.flatten(F.collect_list(F.array("said", "reply")).over(order))
    history = rows.withColumns({"said": said, "reply": reply}).withColumn("upto", upto)
    whole = F.slice("upto", 1, F.size("upto") - 1)
    edited = F.concat(F.slice("upto", 1, F.size("upto") - 3), F.array(text("assistant", F.lit("edited"))), F.array("said"))
    inputs = F.when(conv % 3 == 0, F.array("said")).when((conv % 7 == 6) & (i % 4 == 3), edited).otherwise(whole)
    calls = history.select("session_id", "id", turn.alias("at"), inputs.alias("input_messages"), F.array("reply").alias("output_messages"))
    own: Column = F.concat(F.lit("t"), conv.cast("string"), F.lit("-"), F.when(conv % 4 == 1, i % 3).otherwise(i).cast("string"))
    aliases = rows.select(own.alias("alias"), F.col("id").alias("inference_call_id"), F.lit("o").alias("org_id"), "session_id")
    each = rows.withColumn("k", F.explode(F.when(turn % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    decisions = each.select(
        (conv * 1000 + turn * 10 + F.col("k")).alias("decision_id"), F.lit("o").alias("org_id"), "session_id", F.when(conv % 9 == 8, F.lit(None)).when(conv % 9 == 7, "gone").otherwise(own).alias("call_id"), (F.col("k") == 0).alias("accepted"),
        F.lit(True).alias("explicit"), (turn * 10 + F.col("k")).alias("occurred_at"),
    )
    return rollouts.turns(calls, decisions, aliases)


@query("d05_rollouts", f"WITH {_TURNS} SELECT session_id, turn, segment, reason, new_messages, coalesce(decisions, 0)::integer AS decisions, coalesce(accepted, 0)::integer AS accepted, first_decision FROM s LEFT JOIN e USING (id)")
def rollout_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _turns(spark, sf_dir)
    accepted = F.size(F.filter("decisions", lambda d: d["accepted"]))
    return rows.select("session_id", F.col("at").alias("turn"), "segment", "reason", "new_messages", F.size("decisions").alias("decisions"), accepted.alias("accepted"), F.try_element_at("decisions", F.lit(1))["decision_id"].alias("first_decision"))


@query("d05_rollout_skips", f"""WITH {_TURNS}, n AS (SELECT alias, count(*) AS n FROM a GROUP BY alias)
SELECT CASE WHEN call_id IS NULL THEN 'missing_call_id' WHEN n IS NULL THEN 'unmatched_call_id' ELSE 'ambiguous_decision_call_id' END AS reason, count(*) AS n FROM d LEFT JOIN n ON alias = call_id WHERE coalesce(n, 0) <> 1 GROUP BY 1
UNION ALL SELECT reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY reason""")  # fmt: skip
def rollout_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that came to no turn and boundaries between segments, by reason."""
    rows, skipped = _turns(spark, sf_dir)
    return skipped.unionByName(rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")))


_VERDICT = "v AS (SELECT o_custkey AS commit_sha, c_custkey % 120 AS session_id, c_custkey % 3 = 0 AS noted, CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' END AS verdict FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 32 = 1)"


@query("d18_rollout_rows", f"""WITH {_TURNS}, {_VERDICT}, k AS (SELECT session_id, bool_or(noted) AS noted FROM v GROUP BY session_id),
m AS (SELECT session_id, any_value(k.noted) AS noted, max((commit_sha, verdict)) FILTER (WHERE verdict IS NOT NULL) AS m FROM v JOIN k USING (session_id) WHERE v.noted = k.noted GROUP BY session_id)
SELECT session_id, segment, max(reason) AS reason, count(*)::integer AS turns, coalesce(sum(decisions), 0)::bigint AS decisions, min(id) AS first_call, any_value(m[1]) AS commit_sha, any_value(CASE m[2] WHEN 'passed' THEN 1 WHEN 'failed' THEN 0 END) AS reward,
  any_value(CASE WHEN m[2] IS NOT NULL THEN 'terminal_ci' END) AS reward_source, CASE WHEN any_value(noted) THEN 'git_notes' ELSE 'jaccard' END AS attribution,
  CASE WHEN (('0x' || substr(sha256(session_id::varchar), 1, 16))::ubigint)::double / 18446744073709551616::double < 0.1::double THEN 'eval' ELSE 'train' END AS split
FROM s LEFT JOIN e USING (id) LEFT JOIN m USING (session_id) GROUP BY session_id, segment""")  # fmt: skip
def rollout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training row for each segment, with the reward of its session's last commit that has a verdict."""
    rows, _ = _turns(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 32 = 1").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "failed").alias("verdict"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    key = F.col("c_custkey")
    trajectories = orders.join(customers, "c_custkey").select((key % 120).alias("session_id"), key.alias("commit_sha"), key.alias("position"), "verdict", (key % 3 == 0).alias("noted"))
    found = rollouts.segment_rows(rows, trajectories)
    decisions = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.size(t["decisions"]))
    return found.select("session_id", "segment", "reason", F.size("turns").alias("turns"), decisions.alias("decisions"), F.col("turns")[0]["id"].alias("first_call"), "commit_sha", "reward", "reward_source", "attribution", "split")
