"""Reads over fact frames: parameterised scans whose filters and columns reach the Parquet reader.

Facts have the columns of ``schemas.FACTS``. Sets of keys are frames and become semi joins, so they need no size limit. Bounds named
``since`` are inclusive, ``until`` exclusive, ``through`` (as of) inclusive.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.visibility import quarantined, within
from ..schemas import FACTS

#: Columns of a call that a report reads: neither messages nor the raw payload.
SUMMARY = ("inference_call_id", "org_id", "session_id", "user_id", "gateway_provider", "model", "input_tokens", "output_tokens", "duration_ms", "model_call_id", "observed_at")


def moment(at: str) -> Column:
    return F.lit(at).cast("timestamp")


def scope(facts: DataFrame, at: str, since: str | None = None, until: str | None = None, through: str | None = None, captured: str | None = None) -> DataFrame:
    """Facts of a half-open cohort [since, until) of ``at`` that were captured (column ``captured``) by the moment ``through``."""
    if since is not None:
        facts = facts.where(F.col(at) >= moment(since))
    if until is not None:
        facts = facts.where(F.col(at) < moment(until))
    return facts if through is None else facts.where(F.col(captured or at) <= moment(through))


def since_days(facts: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Facts of the last ``days`` days before a moment, both ends inclusive."""
    return facts.where(F.col(at).between(moment(now) - F.make_dt_interval(F.lit(days)), moment(now)))


def member(facts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Facts whose composite key is one of ``keys``."""
    return facts.join(keys.select(*on).distinct(), on, "left_semi")


def matching(facts: DataFrame, **equal) -> DataFrame:
    """Facts whose columns equal the given values; a value of None asks for nothing, a list for any of its values."""
    for name, value in equal.items():
        if value is not None:
            facts = facts.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return facts


def visible(facts: DataFrame, log: DataFrame, key: str, include_quarantined: bool = False) -> DataFrame:
    return facts if include_quarantined else facts.join(quarantined(log).withColumnRenamed("fact_id", key), key, "left_anti")


def bounded(facts: DataFrame, limit: int | None) -> DataFrame:
    """Facts, or an error if there are more than ``limit``."""
    return facts if limit is None else within(facts, limit)


def summaries(calls: DataFrame, since: str | None = None, until: str | None = None, ids: DataFrame | None = None, sessions: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Summary columns of the calls of a half-open window, of some ids, of some sessions."""
    out = scope(calls, "observed_at", since, until)
    out = out if ids is None else member(out, ids, ["inference_call_id"])
    out = out if sessions is None else member(out, sessions, ["session_id"])
    return bounded(out.select(*(c for c in SUMMARY if c in calls.columns)), limit)


def identities(aliases: DataFrame, through: str) -> DataFrame:
    """(inference_call_id, org_id, session_id, call_ids): the ids by which each call observed up to a moment is known, sorted."""
    seen = scope(aliases, "observed_at", through=through)
    return seen.groupBy("inference_call_id", "org_id", "session_id").agg(F.array_sort(F.collect_set("alias")).alias("call_ids"))


def witnesses(aliases: DataFrame, wanted: DataFrame, through: str) -> DataFrame:
    """(alias, calls, first_call, last_call): for each wanted alias how many calls claim it, and two of them: enough to tell whether it is unique."""
    seen = member(scope(aliases, "observed_at", through=through), wanted, ["alias"])
    return seen.groupBy("alias").agg(F.count_distinct("inference_call_id").alias("calls"), F.min("inference_call_id").alias("first_call"), F.max("inference_call_id").alias("last_call"))


def without_raw(facts: DataFrame) -> DataFrame:
    return facts.drop("raw")


def run_receipt(outcomes: DataFrame, run: dict[str, object]) -> DataFrame:
    """The outcomes of one run (provider, run_id, perhaps run_attempt and repository columns); an error if they are of several repositories."""
    found = matching(outcomes, **run)
    owners = found.select("org_id", "repository_provider", "repository_host", "repository").distinct().limit(2).count()
    if owners > 1:
        raise ValueError("the run is claimed by several repositories; name one")
    return found


def push_ages(pushes: DataFrame, repository: list[str]) -> DataFrame:
    """(repository, pushes, last_push): what collection of old mirrors needs of the pushes."""
    return pushes.groupBy(*repository).agg(F.count("*").alias("pushes"), F.max("captured_at").alias("last_push"))


def merges(facts: DataFrame, requests: DataFrame, captured_through: str, merged_through: str | None = None) -> DataFrame:
    """Merges or revisions of some pull requests (repo, pr_number), captured, and merged, up to a moment."""
    seen = member(scope(facts, "captured_at", through=captured_through), requests, ["repo", "pr_number"])
    return seen if merged_through is None else seen.where(F.col("merged_at") <= moment(merged_through))


def identity_evidence(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(role, source_id, repo, repository_provider, repository_host, repository_id, captured_at) of all (facts, key, repo column) sources that name a repository."""
    own = lambda role, df, key, repo: df.where(F.col(repo).isNotNull()).select(
        F.lit(role).alias("role"), F.col(key).cast("string").alias("source_id"), F.col(repo).alias("repo"), "repository_provider", "repository_host", "repository_id", "captured_at"
    )
    return reduce(DataFrame.unionByName, (own(role, *source) for role, source in sources.items()))


def deliveries(commits: DataFrame, pushes: DataFrame, outcomes: DataFrame, through: str) -> DataFrame:
    """(commit, pushes, forced, runs, passed, failed) of some commits (repo, commit_sha) as of a moment; zeros where nothing came."""
    key = ["repo", "commit_sha"]
    pushed = scope(pushes, "captured_at", through=through).withColumnRenamed("after_sha", "commit_sha").groupBy(*key).agg(F.count("*").alias("pushes"), F.count_if("forced").alias("forced"))
    ran = scope(outcomes, "captured_at", through=through).groupBy(*key).agg(F.count_distinct("run_id").alias("runs"), F.count_if(F.col("result") == "passed").alias("passed"), F.count_if(F.col("result") == "failed").alias("failed"))
    both = commits.select(*key).distinct().join(pushed, key, "left").join(ran, key, "left")
    return both.na.fill(0, ["pushes", "forced", "runs", "passed", "failed"])


def context_source(parts: DataFrame, log: DataFrame, granted: DataFrame, commits: DataFrame) -> DataFrame:
    """(session_id, parts, bytes, quarantined, commits) of the granted sessions: visible parts, hidden ones, and commits that witness the session."""
    own = member(parts, granted, ["session_id"])
    hidden = quarantined(log).select(F.col("fact_id").alias("inference_call_id"), F.lit(True).alias("_out"))
    seen = own.join(hidden, "inference_call_id", "left").groupBy("session_id").agg(
        F.count_if(F.col("_out").isNull()).alias("parts"), F.coalesce(F.sum(F.when(F.col("_out").isNull(), F.octet_length("text"))), F.lit(0)).alias("bytes"), F.count_if("_out").alias("quarantined")
    )
    witnessed = commits.groupBy("session_id").agg(F.count_distinct("commit_sha").alias("commits"))
    return seen.join(witnessed, "session_id", "left").na.fill(0, ["commits"])


def reconciled(wanted: DataFrame, calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """(wanted, inference_call_id, status): each id a client names is a call's own id, an alias of one call, ambiguous, or absent."""
    by_id = wanted.join(calls.select(F.col("inference_call_id").cast("string").alias("wanted"), F.col("inference_call_id").alias("_own")), "wanted", "left")
    named = aliases.groupBy(F.col("alias").cast("string").alias("wanted")).agg(F.min("inference_call_id").alias("_low"), F.max("inference_call_id").alias("_high"))
    both = by_id.join(named, "wanted", "left")
    status = F.when(F.col("_own").isNotNull(), "call").when(F.col("_low") == F.col("_high"), "alias").when(F.col("_low").isNotNull(), "ambiguous").otherwise("absent")
    return both.select("wanted", F.when(status == "call", F.col("_own")).when(status == "alias", F.col("_low")).alias("inference_call_id"), status.alias("status"))


def counts(tables: dict[str, tuple[DataFrame, str]], log: DataFrame) -> DataFrame:
    """(fact_table, total, visible) of all (facts, key) tables; ``log`` has fact_table."""
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("fact_table"), F.col(key).cast("string").alias("fact_id")) for name, (df, key) in tables.items()))
    out = log.groupBy("fact_table", F.col("fact_id").cast("string").alias("fact_id")).agg(F.max_by("action", "quarantine_revision").alias("action")).where("action = 'quarantine'")
    marked = rows.join(out, ["fact_table", "fact_id"], "left")
    return marked.groupBy("fact_table").agg(F.count("*").alias("total"), F.count_if(F.col("action").isNull()).alias("visible"))


def selected(facts: DataFrame, repository: str) -> DataFrame:
    """Facts of a repository selector: ``provider/host/id`` for an identified repository, else a name that stands for facts without an identity."""
    parts = repository.split("/")
    if len(parts) == 3:
        return matching(facts, repository_provider=parts[0], repository_host=parts[1], repository_id=parts[2])
    return matching(facts, repo=repository.lower()).where("repository_id is null")


class Snapshot:
    """Tables read once: every later read sees the files that were listed first, whatever is written in between."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(*self.spark.read.parquet(f"{self.folder}/{name}.parquet").inputFiles())
        return self.tables[name]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strictly parsed JSON lines: a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def quarantine_actions(log: DataFrame, facts: DataFrame, key: str, action: str, reason: str) -> DataFrame:
    """(fact_id, action, reason, quarantine_revision): the actions that quarantine or release facts, numbered on from the log.

    Facts that are in the wanted state already get none. Counting the rows is the dry run; appending them to the log does it.
    """
    from ..operators.sequences import numbered

    now = log.groupBy("fact_id").agg(F.max_by("action", "quarantine_revision").alias("_now"))
    state = facts.select(F.col(key).alias("fact_id")).distinct().join(now, "fact_id", "left")
    other = F.coalesce("_now", F.lit("release")) != action
    last = log.agg(F.coalesce(F.max("quarantine_revision"), F.lit(0)).alias("_last"))
    placed = numbered(state.where(other).select("fact_id"), ["fact_id"], "_n", "_m").join(F.broadcast(last))
    return placed.select("fact_id", F.lit(action).alias("action"), F.lit(reason).alias("reason"), (F.col("_n") + F.col("_last")).alias("quarantine_revision"))


COHORT_DAYS = 31


def cohort(facts: DataFrame, at: str, start: str, end: str, as_of: str, captured: str | None = None) -> DataFrame:
    """Facts of a report's half-open cohort, captured as of a moment; an error if it is empty, longer than ``COHORT_DAYS``, or not over by then."""
    first, last, now = (datetime.fromisoformat(x) for x in (start, end, as_of))
    if not first < last <= now or (last - first).days > COHORT_DAYS:
        raise ValueError(f"a cohort ends after it begins, within {COHORT_DAYS} days, and not after the report's moment")
    return scope(facts, at, start, end, as_of, captured)


def fact_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fact table's Parquet files under its own DDL: columns that a file lacks are null, others are not read."""
    return spark.read.schema(FACTS[name]).parquet(f"{folder}/{name}")
