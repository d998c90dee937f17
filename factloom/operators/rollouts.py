"""Rollouts: a session's calls as turns in segments, with their decisions, the session's commits and the reward of its last verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import split_score
from .attachment import attach_decisions
from .sequences import rollouts

EVAL_FRACTION = 0.1


def canonical(messages: Column) -> Column:
    """Typed messages as strings that are equal if role and ordered parts are; the finish reason is no part of a history."""
    return F.transform(messages, lambda m: F.to_json(F.struct(m["role"].alias("role"), m["parts"].alias("parts"))))


def says(messages: Column) -> Column:
    """Whether any part has content: texts and reasonings that are empty say nothing, any other part does."""
    return F.exists(messages, lambda m: F.exists(m["parts"], lambda p: ~p["type"].isin("text", "reasoning") | (F.coalesce(p["content"], F.lit("")) != "")))


def turns(calls: DataFrame, decisions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, skipped) of calls (session_id, id, at, input_messages, output_messages).

    turns: session_id, id, at, segment (from 0), reason (why a segment begins there), new_messages, decisions (decision_id, accepted, explicit, in time order): a row
    for each call. ``decisions`` (decision_id, org_id, session_id, call_id, accepted, explicit, occurred_at) come to the call that alone has their alias in
    ``aliases`` (alias, inference_call_id, org_id, session_id); skipped: reason, n.
    """
    typed = calls.withColumns({"input": canonical(F.col("input_messages")), "output": canonical(F.col("output_messages")), "said": says(F.col("output_messages"))})
    cut = rollouts(typed.select("session_id", "id", "at", "input", "output", "said"))
    told = attach_decisions(decisions, aliases)
    each = F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "decision_id", "accepted", "explicit"))), lambda d: F.struct(d["decision_id"].alias("decision_id"), d["accepted"].alias("accepted"), d["explicit"].alias("explicit")))
    by_call = told.where("reason is null").groupBy(F.col("owner").alias("id")).agg(each.alias("decisions"))
    rows = cut.select("session_id", "id", "at", (F.col("segment") - 1).alias("segment"), "reason", F.size("new_input").alias("new_messages")).join(by_call, "id", "left")
    none = F.array().cast(by_call.schema["decisions"].dataType)
    skipped = told.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return rows.withColumn("decisions", F.coalesce("decisions", none)), skipped


def segment_rows(turn_rows: DataFrame, trajectories: DataFrame, fraction: float = EVAL_FRACTION) -> DataFrame:
    """A row for each segment: session_id, segment, reason, turns (id, new_messages, decisions), commit_sha, reward, reward_source, attribution, split.

    ``trajectories`` (session_id, commit_sha, position, verdict, noted): the session's commits; noted ones replace guessed ones where there are any. The reward is
    1 or 0 by the verdict of the last commit that has one; without one there is none, and the segment stays.
    """
    marked = trajectories.join(trajectories.groupBy("session_id").agg(F.max("noted").alias("_any")), "session_id").where("noted = _any")
    last = marked.groupBy("session_id").agg(F.max("noted").alias("noted"), F.max(F.when(F.col("verdict").isNotNull(), F.struct("position", "commit_sha", "verdict"))).alias("m"))
    reward = F.when(F.col("m.verdict") == "passed", 1).when(F.col("m.verdict") == "failed", 0)
    ends = last.select("session_id", F.col("m.commit_sha").alias("commit_sha"), reward.alias("reward"), F.when(F.col("noted"), "git_notes").otherwise("jaccard").alias("attribution"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "new_messages", "decisions"))), lambda t: F.struct(t["id"].alias("id"), t["new_messages"].alias("new_messages"), t["decisions"].alias("decisions")))
    segments = turn_rows.groupBy("session_id", "segment").agg(F.max("reason").alias("reason"), listed.alias("turns"))
    out = segments.join(ends, "session_id", "left")
    return out.withColumns({
        "attribution": F.coalesce("attribution", F.lit("jaccard")), "reward_source": F.when(F.col("reward").isNotNull(), "terminal_ci"),
        "split": F.when(split_score(F.col("session_id").cast("string")) < fraction, "eval").otherwise("train"),
    })
