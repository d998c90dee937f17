"""Derivations that join several operators: merge retention, accepted-work lifecycle, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import NORMAL, required_trials, two_sided
from ..functions.text import containment
from ..operators.sequences import benjamini_hochberg
from . import reports


def merge_retention(edits: DataFrame, blobs: DataFrame, merges: DataFrame) -> DataFrame:
    """(applied_id, path, at_head, at_merge, retained): how much of an applied edit stands in its file at a pull request's head and at its merge.

    ``edits`` (applied_id, applied, path, merge_id), ``blobs`` (commit_sha, path, file), ``merges`` (merge_id, head_sha, merge_commit_sha). A file that is gone retains 0;
    an edit that the head doesn't hold has no share. Only the pairs that the edits name are compared.
    """
    named = edits.join(merges, "merge_id").select("applied_id", "applied", "path", F.explode(F.array(F.struct(F.lit("head").alias("at"), F.col("head_sha").alias("sha")), F.struct(F.lit("merge").alias("at"), F.col("merge_commit_sha").alias("sha")))).alias("w"))
    wanted = named.select("applied_id", "path", "w.at", F.concat_ws("\x00", "w.sha", "path").alias("file_id"))
    files = blobs.select(F.concat_ws("\x00", "commit_sha", "path").alias("file_id"), "file").join(wanted.select("file_id").distinct(), "file_id", "left_semi")
    found = containment(edits.select("applied_id", "applied").distinct(), files, wanted.select("applied_id", "file_id").distinct())
    scored = wanted.join(found, ["applied_id", "file_id"], "left").groupBy("applied_id", "path").agg(
        F.max(F.when(F.col("at") == "head", F.coalesce("containment", F.lit(0.0)))).alias("at_head"), F.max(F.when(F.col("at") == "merge", F.coalesce("containment", F.lit(0.0)))).alias("at_merge")
    )
    return scored.withColumn("retained", F.when(F.col("at_head") > 0, F.least(F.lit(1.0), F.col("at_merge") / F.col("at_head"))))


def lifecycle(sessions: DataFrame, group: list[str]) -> DataFrame:
    """The five-stage funnel of accepted work and its rework, a row for each group.

    ``sessions``: session_id, accepted, attributed, verdict, merged, kept, rejected_after, retried. Coverage counts sessions whose verdict is observed, missing or ambiguous.
    """
    stages = {"accepted": F.col("accepted"), "attributed": F.col("attributed"), "resolved": F.col("verdict").isin("passed", "failed"), "passed": F.col("verdict") == "passed", "merged": F.col("merged")}
    found = reports.funnel(sessions, group, "session_id", stages)
    rework = sessions.groupBy(*group).agg(
        F.count_if("rejected_after").alias("rejected_after"), F.count_if("retried").alias("retried"), F.count_if(F.col("verdict") == "failed").alias("failed_ci"), F.count_if(F.col("kept") < 0.1).alias("deleted"),
        F.count_if(F.col("verdict").isNotNull()).alias("observed"), F.count_if(F.col("verdict").isNull()).alias("missing"),
    )
    return found.join(rework, group)


def compare_models(rates: DataFrame, name: str, alpha: float = 0.05, least: int = 30) -> DataFrame:
    """(left, right, difference, h, z, p, significant, needed) of each pair of models of a (name, n, successes) table.

    Two-sided p, Benjamini-Hochberg over the pairs with at least ``least`` trials on both sides; ``needed``: trials of each arm that would show the difference.
    """
    pairs = reports.pairwise(rates, name)
    sides = rates.select(name, "n", "successes")
    both = pairs.join(sides.toDF("left", "nl", "sl"), "left").join(sides.toDF("right", "nr", "sr"), "right")
    both = both.withColumn("needed", required_trials(F.col("sl") / F.greatest("nl", F.lit(1)), -F.col("difference"))).withColumn("enough", (F.least("nl", "nr") >= least) & F.col("z").isNotNull())
    tested = both.where("enough").withColumn("p", two_sided(F.col("z"))).withColumn("key", F.struct("left", "right"))
    ranked = benjamini_hochberg(tested, "p", "key", alpha).select("left", "right", "p", F.col("rejected").alias("significant"))
    return both.join(ranked, ["left", "right"], "left").select("left", "right", "difference", "h", "z", "p", "significant", "needed")


def non_inferiority(difference: Column, error: Column, margin: float, alpha: float = 0.05) -> Column:
    """``non_inferior`` as a Column."""
    return difference - NORMAL.inv_cdf(1 - alpha) * error > -margin


def non_inferior(difference: float, error: float, margin: float, alpha: float = 0.05) -> bool:
    """Whether the lower bound of the 1 - 2 alpha interval of a difference is above -margin."""
    return difference - NORMAL.inv_cdf(1 - alpha) * error > -margin
