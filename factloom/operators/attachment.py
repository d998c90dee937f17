"""Joins that attach evidence to calls: unique or dropped, with one reason for each row that is not used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_decisions(decisions: DataFrame, aliases: DataFrame) -> DataFrame:
    """decisions with ``owner`` (the call that owns their call id) and ``reason`` (null if attached).

    ``aliases``: (alias, inference_call_id, org_id, session_id). Reasons in order: missing_call_id, unmatched_call_id,
    ambiguous_decision_call_id, org_mismatch, session_mismatch. Every decision comes back once.
    """
    owners = aliases.groupBy("alias").agg(
        F.min("inference_call_id").alias("owner"), F.max("inference_call_id").alias("other"), F.min("org_id").alias("owner_org"), F.min("session_id").alias("owner_session")
    )
    joined = decisions.join(owners, F.col("call_id") == F.col("alias"), "left")
    reason = (
        F.when(F.col("call_id").isNull(), "missing_call_id").when(F.col("alias").isNull(), "unmatched_call_id").when(F.col("owner") != F.col("other"), "ambiguous_decision_call_id")
        .when(F.col("org_id") != F.col("owner_org"), "org_mismatch").when(F.col("session_id") != F.col("owner_session"), "session_mismatch")
    )
    marked = joined.withColumn("reason", reason)
    return marked.select(*decisions.columns, F.when(F.col("reason").isNull(), F.col("owner")).alias("owner"), "reason")


def skip_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n) of the rows that were not used."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def drop_subsumed(decisions: DataFrame, harness: str, keys: list[str]) -> DataFrame:
    """Decisions without those of a harness that have no path while a sibling with a path agrees on ``keys``."""
    siblings = decisions.where((F.col("agent_harness") == harness) & (F.col("file_path") != "")).select(*keys).distinct()
    bare = (F.col("agent_harness") == harness) & (F.col("file_path") == "")
    marked = decisions.join(siblings.withColumn("_keyed", F.lit(True)), keys, "left")
    return marked.where(~bare | F.col("_keyed").isNull()).drop("_keyed")


def fill_retention(decisions: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """decisions with a missing retention score filled from the first observation of their keys, clamped to [0, 1]; non-finite scores don't count."""
    finite = observations.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    first = finite.groupBy(*keys).agg(F.min_by("score", F.struct("occurred_at", "observation_id")).alias("_score"))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score")))
    joined = decisions.join(first, keys, "left")
    return joined.select(*(F.coalesce("edit_retention_score", clamped).alias(c) if c == "edit_retention_score" else c for c in decisions.columns))


def session_commits(observations: DataFrame, as_of: str) -> DataFrame:
    """(commit_sha, session_id, observations): edges first seen up to a moment."""
    seen = observations.where(F.col("captured_at") <= F.lit(as_of).cast("timestamp"))
    return seen.groupBy("commit_sha", "session_id").agg(F.count("*").alias("n"), F.min("captured_at").alias("first_seen_at"))


def commit_owners(ranges: DataFrame) -> DataFrame:
    """(commit_sha, push_id): the earliest push, then the smallest id, whose range has the commit."""
    return ranges.groupBy("commit_sha").agg(F.min_by("push_id", F.struct("captured_at", "push_id")).alias("push_id"))


def newest_commits(ranges: DataFrame, cap: int = 20) -> DataFrame:
    """The newest ``cap`` commits of each push."""
    order = Window.partitionBy("push_id").orderBy(F.desc("committed_at"), F.desc("commit_sha"))
    return ranges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")


def pull_request_membership(candidates: DataFrame) -> DataFrame:
    """(outcome_id, status, merge_id) of (outcome_id, merge_id, resolved): joined, without_merge, ambiguous; unresolved wins."""
    grouped = candidates.groupBy("outcome_id").agg(F.count_distinct("merge_id").alias("n"), F.min("merge_id").alias("merge_id"), F.max(~F.col("resolved")).alias("open"))
    status = F.when(F.col("open"), "unresolved").when(F.col("n") == 1, "joined").when(F.col("n") == 0, "without_merge").otherwise("ambiguous")
    return grouped.select("outcome_id", status.alias("status"), F.when(status == "joined", F.col("merge_id")).alias("merge_id"))


def price_at(calls: DataFrame, prices: DataFrame, at: str) -> DataFrame:
    """calls with the price of their model in the half-open interval [valid_from, valid_until) that has their time."""
    p = prices.alias("p")
    match = (calls["model"] == F.col("p.model")) & (calls[at] >= F.col("p.valid_from")) & (F.col("p.valid_until").isNull() | (calls[at] < F.col("p.valid_until")))
    return calls.join(p, match, "left").select(calls["*"], F.col("p.price").alias("price"))


def overlapping_prices(prices: DataFrame) -> DataFrame:
    """Price intervals that begin before the one before them of the same model ends."""
    order = Window.partitionBy("model").orderBy("valid_from", "valid_until")
    before = F.lag("valid_until").over(order)
    number = F.row_number().over(order)
    return prices.withColumn("_before", before).withColumn("_n", number).where((F.col("_n") > 1) & (F.col("_before").isNull() | (F.col("valid_from") < F.col("_before")))).drop("_before", "_n")


def retry_links(rejected: DataFrame, accepted: DataFrame, said: DataFrame) -> DataFrame:
    """(session_id, file_path, rejected_id, accepted_id): the first later accepted edit of the same session, file and tool with a user text strictly between.

    Positions are ordinals of the transcript; ``said`` has (session_id, position) of user texts.
    """
    r = rejected.select("session_id", "file_path", "tool_name", F.col("position").alias("from"), F.col("id").alias("rejected_id"))
    a = accepted.select("session_id", "file_path", "tool_name", F.col("position").alias("to"), F.col("id").alias("accepted_id"))
    # the last user text before an accepted edit decides whether one stands between; ids repeat across sessions, and one edit may come twice
    order = Window.partitionBy("session_id").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, -1)
    marks = said.select("session_id", "position", F.lit(0).alias("kind")).unionByName(accepted.select("session_id", "position", F.lit(-1).alias("kind")).distinct())
    last = marks.withColumn("last_said", F.max(F.when(F.col("kind") == 0, F.col("position"))).over(order)).where("kind = -1").select("session_id", F.col("position").alias("to"), "last_said")
    a = a.join(last, ["session_id", "to"])
    both = r.join(a, ["session_id", "file_path", "tool_name"]).where((F.col("to") > F.col("from")) & (F.col("last_said") > F.col("from")))
    return both.groupBy("session_id", "file_path", "rejected_id").agg(F.min_by("accepted_id", F.struct("to", "accepted_id")).alias("accepted_id"))


def outcomes_by_commit(qualified: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """(repository, sha, reason, outcomes, first_outcome) of outcomes with a qualified ``repository`` or the ``reason`` why there is none."""
    return qualified.groupBy("repository", sha, "reason").agg(F.count("*").alias("outcomes"), F.min(key).alias("first_outcome"))
