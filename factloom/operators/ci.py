"""CI attempts to verdicts: attempts of a run, runs of a commit, red-to-green pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros

VERDICTS = ("passed", "failed")


#: A run is one of its organisation, CI provider and forge instance; a commit is one of its organisation and repository. A bare number or sha is neither.
RUN = ["org_id", "provider", "repository_provider", "repository_host", "run_id"]
COMMIT = ["org_id", "repository", "commit_sha"]
#: What rows are dealt by: no column that a source may fix to a constant, as a sum leaves constants out of its keys and would then be shuffled anew.
_DEALT = ["org_id", "repository_host", "run_id"]
_IDENTITY = {"branches": "branch", "ids": "workflow_id", "names": "workflow_name", "paths": "workflow_path"}


#: Rows that a task sorts at once, whatever the number of all rows.
TASK_ROWS = 1 << 17


def tasks_of(rows: DataFrame) -> int:
    """The number of tasks that rows ask for: those of any shuffle, and more where a task would have over ``TASK_ROWS``."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def consistent_runs(outcomes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(run, reason): runs, with why one is declined (null if it isn't): several commits, several branches, workflow ids, names or paths, or two results of an attempt.

    Rows are dealt by run, so one sort in a task serves both sums; their texts are no fixed-size sums and would else be sorted before and after each shuffle.
    """
    each = outcomes.select(*RUN, "run_attempt", *COMMIT[1:], *_IDENTITY.values(), "result").repartition(tasks or tasks_of(outcomes), *_DEALT)
    each = each.withColumn("_commit", F.struct(*COMMIT)).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in _IDENTITY.values() if c != "branch"})
    fields = {**_IDENTITY, "commits": "_commit", "results": "result"}
    attempts = each.groupBy(*RUN, F.coalesce("run_attempt", F.lit(0)).alias("attempt")).agg(*(x for n, c in fields.items() for x in (F.min(c).alias(f"{n}_low"), F.max(c).alias(f"{n}_high"))))
    several = lambda n: F.coalesce(F.min(f"{n}_low") != F.max(f"{n}_high"), F.lit(False)).alias(n)
    runs = attempts.groupBy(*RUN).agg(*map(several, ["commits", *_IDENTITY]), F.max(F.col("results_low") != F.col("results_high")).alias("results"))
    workflows = F.col("ids") | F.col("names") | F.col("paths")
    reason = F.when(F.col("commits"), "commit_conflict").when(F.col("branches"), "branch_conflict").when(workflows, "workflow_conflict").when(F.col("results"), "attempt_conflict")
    return runs.select(*RUN, reason.alias("reason"))


def workflow_verdicts(outcomes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(commit, run, workflow_id, workflow_name, workflow_path, verdict, flake, reliability, attempts): the last passed or failed attempt of each run decides.

    A run without one has no verdict. Attempt order is (attempt or 0, outcome_id), never arrival time.
    """
    order = F.struct(F.coalesce("run_attempt", F.lit(0)), "outcome_id")
    is_verdict = F.col("result").isin(*VERDICTS)
    workflow = [F.max(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("workflow_id", "workflow_name", "workflow_path")]
    runs = outcomes.repartition(tasks or tasks_of(outcomes), *_DEALT, *COMMIT[1:]).groupBy(*COMMIT, *RUN[1:]).agg(
        *workflow, F.max_by("result", F.when(is_verdict, order)).alias("last"), F.max(is_verdict).alias("any"),
        F.max(F.col("result") == "passed").alias("passed"), F.max(F.col("result") == "failed").alias("failed"), F.count("*").alias("attempts"),
    )
    flake = F.col("passed") & F.col("failed")
    reliability = F.when(F.col("any"), F.when(flake, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    names = [*COMMIT, *RUN[1:], "workflow_id", "workflow_name", "workflow_path"]
    return runs.select(*names, F.when(F.col("any"), F.col("last")).alias("verdict"), flake.alias("flake"), reliability.alias("reliability"), "attempts")


def commit_verdicts(workflows: DataFrame) -> DataFrame:
    """(commit, verdict, reliability, workflows, flakes, reason): the verdict all workflows share, else none and a reason."""
    commits = workflows.groupBy(*COMMIT).agg(
        F.min("verdict").alias("low"), F.max("verdict").alias("high"), F.min(F.when(F.col("verdict").isNotNull(), F.col("reliability"))).alias("reliability"),
        F.count("*").alias("workflows"), F.count_if("flake").alias("flakes"),
    )
    same = F.col("low") == F.col("high")
    reason = F.when(F.col("low").isNull(), "no_verdict").when(~same, "ambiguous_workflow_verdicts")
    return commits.select(*COMMIT, F.when(same, F.col("low")).alias("verdict"), F.when(same, F.col("reliability")).alias("reliability"), "workflows", "flakes", reason.alias("reason"))


def same_key(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys whose nulls are equal; the right side's keys are left out."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(renamed[f"_{k}"])
    return left.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def resolve(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commit verdicts, declined runs with a reason). Declined runs take all their rows with them."""
    tasks = tasks_of(outcomes)
    declined = consistent_runs(outcomes, tasks).where("reason is not null")
    kept = same_key(outcomes, declined, RUN, "left_anti")
    return commit_verdicts(workflow_verdicts(kept, tasks)), declined


def red_to_green(outcomes: DataFrame, lineage: list[str]) -> DataFrame:
    """(lineage, red_id, red_commit, green_id, green_commit): a pass whose previous verdict in its lineage is a failure, with that failure."""
    order = Window.partitionBy(*lineage).orderBy("captured_at", "outcome_id")
    verdicts = outcomes.where(F.col("result").isin(*VERDICTS))
    seen = verdicts.select(
        *lineage, "outcome_id", "commit_sha", "result", "captured_at",
        F.lag("result").over(order).alias("before"), F.lag("outcome_id").over(order).alias("red_id"), F.lag("commit_sha").over(order).alias("red_commit"), F.lag("captured_at").over(order).alias("red_at"),
    )
    pairs = seen.where("result = 'passed' and before = 'failed'")
    return pairs.select(*lineage, "red_id", "red_commit", F.col("outcome_id").alias("green_id"), F.col("commit_sha").alias("green_commit"), (micros("captured_at") - micros("red_at")).alias("micros"))


def last_verdict_of(trajectory: DataFrame, rollout: str, position: str, verdict: str) -> DataFrame:
    """(rollout, position, verdict): the verdict at the last position of a rollout that has one."""
    known = trajectory.where(F.col(verdict).isNotNull())
    return known.groupBy(rollout).agg(F.max(F.struct(position, verdict)).alias("m")).select(rollout, f"m.{position}", f"m.{verdict}")
