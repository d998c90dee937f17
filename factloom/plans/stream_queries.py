"""Queries that run as streams over a table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context
from ..sources.bindings import ctes
from ..streaming import streams
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t10_stream_dedup", "SELECT count(*) AS facts, count(DISTINCT event_id) AS keys, sum(event_id)::bigint AS total FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact delivered twice is stored once."""
    events = _events(spark, sf_dir)
    twice = events.unionByName(_events(spark, sf_dir)).select("event_id", "ts")
    stored = streams.drained(streams.deduplicated(twice, ["event_id"], "ts", "40 days"), "dedup", "append")
    return stored.agg(F.count("*").alias("facts"), F.count_distinct("event_id").alias("keys"), F.sum("event_id").alias("total"))


@query("a06_stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n, sum(round(value * 100)::bigint)::bigint AS cents FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")]
    out = streams.drained(streams.tumbling(_events(spark, sf_dir), "ts", "1 day", ["event_type"], sums), "tumbling", "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "cents")


@query("w04_stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, id""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drained(streams.sessions(_events(spark, sf_dir), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")]), "sessions", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("a01_stream_verdicts", ctes("ci_outcomes") + """
SELECT org_id, provider, repository_provider, repository_host, run_id, arg_max(result, outcome_id) AS verdict, count(DISTINCT result) > 1 AS flake FROM ci_outcomes WHERE result IN ('passed', 'failed') GROUP BY ALL""")  # fmt: skip
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a run in outcome order, as they come in."""
    result = F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "failed").otherwise("cancelled")
    key = F.col("o_custkey")
    outcomes = streams.source(spark, sf_dir, "orders").select(
        F.concat(F.lit("org"), (key % 2).cast("string")).alias("org_id"), F.lit("github").alias("provider"), F.lit("forge").alias("repository_provider"), F.concat(F.lit("host"), (key % 5).cast("string")).alias("repository_host"),
        F.concat(F.floor(key / 10).cast("string"), F.lit("-"), "o_orderpriority").alias("run_id"), F.lit(1).alias("run_attempt"), F.col("o_orderkey").alias("outcome_id"), result.alias("result"),
    )
    return streams.drained(streams.running_verdicts(outcomes), "verdicts", "complete")


@query("t13_stream_candidates", """WITH p AS (SELECT source, text, len(list_intersect(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: lower(x))), ['license', 'token', 'password', 'released', 'die', 'les'])) AS score FROM documents),
c AS (SELECT source, text, max(score) AS score, max(strlen(text)) + 64 + 512 AS bytes FROM p WHERE score > 0 GROUP BY source, text), s AS (SELECT source AS session_id, count(*) AS contents, sum(bytes)::bigint AS state_bytes, sum(score)::bigint AS scores FROM c GROUP BY source)
SELECT session_id, CASE WHEN state_bytes > 200000 THEN 0 ELSE contents END AS contents, CASE WHEN state_bytes <= 200000 THEN state_bytes END AS state_bytes, CASE WHEN state_bytes <= 200000 THEN scores END AS scores, state_bytes > 200000 AS refused FROM s""")  # fmt: skip
def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best part of each content as parts come in, within a byte budget for each session; sessions beyond it are refused."""
    docs = streams.source(spark, sf_dir, "documents")
    score = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, ["license", "token", "password", "released", "die", "les"]))))
    found = docs.select(
        F.col("source").alias("session_id"), F.sha2("text", 256).alias("content"), score.alias("score"), F.lit(0).cast("long").alias("at"), F.col("doc_id").alias("inference_call_id"), F.lit(0).alias("answered"), F.lit(0).alias("message"), F.lit(0).alias("part"),
        F.octet_length("text").cast("long").alias("bytes"),
    ).where("score > 0")
    rows = streams.drained(context.running_candidates(found, 200_000), "candidates", "update")
    return context.settled_candidates(rows)
