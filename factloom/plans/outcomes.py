"""Reports of coding-agent work in full: outcomes of models, funnels, lifecycles, retention, compute arms, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from ..operators.sequences import quantiles, with_quantiles
from ..sources.shared import Workspace
from .reports import RECOVERY_CAP, size_label

#: Retention below which a report counts.
THRESHOLDS = (0.8, 0.9, 1.0)
UNNAMED = "(unnamed)"


def _joined(pairs: Column) -> Column:
    """``name=n`` of (k, n) pairs in name order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit("="), p["n"].cast("string"))), ",")


def listed(counts: DataFrame, group: list[str], name: str, n: str, alias: str) -> DataFrame:
    """(group, alias): the counts of a group's names as ``name=n`` in name order, joined by commas. Names are few: results, harnesses, workflows."""
    return counts.groupBy(*group).agg(_joined(F.collect_list(F.struct(F.col(name).alias("k"), F.col(n).alias("n")))).alias(alias))


def names_of(name: str, n: str) -> Column:
    """An aggregate: what ``listed`` gives for the counts above 0."""
    return _joined(F.collect_list(F.when(F.col(n) > 0, F.struct(F.col(name).alias("k"), F.col(n).alias("n")))))


def counted(rows: DataFrame, group: list[str], name: str, alias: str, key: list[str] | None = None) -> DataFrame:
    """(group, alias): how many rows, or distinct keys, of a group have each name."""
    n = F.count_distinct(*key) if key else F.count("*")
    return listed(rows.groupBy(*group, name).agg(n.alias("_n")), group, name, "_n", alias)


def observed_edges(attributed: DataFrame, edges: DataFrame, commit: list[str]) -> DataFrame:
    """attributed with ``observed``: whether its (commit, session) was captured as an edge. CI counts only over observed ones."""
    seen = edges.select(*commit, "session_id").distinct().withColumn("_seen", F.lit(True))
    return attributed.join(seen, [*commit, "session_id"], "left").withColumn("observed", F.coalesce("_seen", F.lit(False))).drop("_seen")


def fates_said(fates: DataFrame, decisions: DataFrame, group: list[str]) -> DataFrame:
    """fates with the group and ``explicit_accept`` of the decisions that have their key (session_id, call_id)."""
    key = ["session_id", "call_id"]
    return fates.join(decisions.groupBy(*group, *key).agg(F.max(F.col("explicit") & F.col("accepted")).alias("explicit_accept")), key)


def each_fate(said: DataFrame, group: list[str]) -> DataFrame:
    """(group, observation_id, fate, explicit_accept, external): each observed fate once."""
    external = (F.coalesce("external_added", F.lit(0)) > 0) | (F.coalesce("external_removed", F.lit(0)) > 0)
    return said.groupBy(*group, "observation_id").agg(F.min("fate").alias("fate"), F.max("explicit_accept").alias("explicit_accept"), F.max(external).alias("external"))


def joined_fates(fates: DataFrame, decisions: DataFrame, group: list[str]) -> DataFrame:
    """(group, observation_id, fate, explicit_accept, external): each observed fate once, if some decision of the group has its key (session_id, call_id)."""
    return each_fate(fates_said(fates, decisions, group), group)


def fate_diagnostic(fates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(fate, n, explicit_accepts, with_external_changes) of the fates that join a decision."""
    each = joined_fates(fates, decisions.withColumn("_all", F.lit(1)), ["_all"])
    return each.groupBy("fate").agg(F.count("*").alias("n"), F.count_if("explicit_accept").alias("explicit_accepts"), F.count_if("external").alias("with_external_changes"))


def model_outcomes(calls: DataFrame, attributed: DataFrame, verdicts: DataFrame, workflows: DataFrame, decisions: DataFrame, fates: DataFrame, commit: list[str]) -> DataFrame:
    """A row for each model: its calls, those attributed and their Wilson interval, commits with a verdict and those passed, explicit decisions, fates, similarity.

    ``calls`` (call_id, model), ``attributed`` (call_id, commit, session_id, similarity, observed), ``verdicts`` (commit, verdict), ``workflows`` (commit, run_id,
    workflow_name, verdict), ``decisions`` (decision_id, session_id, call_id, agent_harness, accepted, explicit), ``fates`` (observation_id, session_id, call_id, fate, external_added, external_removed).
    CI is counted by commit, so a commit of many files isn't many trials; a failing workflow counts once where its commit failed. Attributed calls and their
    commits with verdicts are stored, as several sums read them; all counts of a kind of rows come from one pass. A fate meets its decisions before its call, which says nothing about them.
    """
    space = Workspace(calls.sparkSession, "outcomes")
    calls = calls.where("model is not null")
    total = calls.groupBy("model").agg(F.count("*").alias("completions"))
    rows = space.save(attributed.select("call_id", *commit, "session_id", "similarity", "observed").join(calls, "call_id"), "rows")
    each = rows.groupBy("model", "call_id").agg(F.sum("similarity").alias("_sum"), F.count("similarity").alias("_n"))
    links = each.groupBy("model").agg(F.count("*").alias("attributed"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean_similarity"))
    unseen = rows.where("not observed").select("model", *commit, "session_id").distinct().groupBy("model").agg(F.count("*").alias("unobserved"))
    commits = space.save(rows.where("observed").select("model", *commit).distinct().join(verdicts, commit).where("verdict is not null").select("model", *commit, "verdict"), "commits")
    ci = commits.groupBy("model").agg(F.count("*").alias("ci_linked"), F.count_if(F.col("verdict") == "passed").alias("ci_passed"))
    workflow = F.coalesce(F.nullif("workflow_name", F.lit("")), F.lit(UNNAMED)).alias("_w")
    failing = workflows.where("verdict = 'failed'").groupBy(*commit, workflow).agg(F.count_distinct("run_id").alias("_n"))
    failed = commits.where("verdict = 'failed'").select("model", *commit).join(failing, commit).groupBy("model", "_w").agg(F.sum("_n").alias("_n"))
    failures = listed(failed, ["model"], "_w", "_n", "failures")
    explicit = decisions.where("explicit").select("call_id", "decision_id", "accepted", "agent_harness").join(calls, "call_id").groupBy("model", "decision_id").agg(F.min("accepted").alias("accepted"), F.min("agent_harness").alias("agent_harness"))
    by_harness = explicit.groupBy("model", "agent_harness").agg(F.count_if("accepted").alias("_yes"), F.count_if(~F.col("accepted")).alias("_no"))
    accepts = by_harness.groupBy("model").agg(F.sum("_yes").alias("explicit_accepts"), F.sum("_no").alias("explicit_rejects"), names_of("agent_harness", "_no").alias("rejects_by_harness"))
    said = fates_said(fates, decisions, []).join(calls, "call_id")
    ends = each_fate(said, ["model"]).groupBy("model", "fate").agg(F.count("*").alias("_n"), F.count_if("explicit_accept").alias("_yes"), F.count_if("external").alias("_changed"))
    lists = ends.groupBy("model").agg(names_of("fate", "_n").alias("fates"), names_of("fate", "_yes").alias("accepted_fates"), names_of("fate", "_changed").alias("external_fates"))
    out = total
    for part in (links, unseen, ci, accepts, failures, lists):
        out = out.join(part, "model", "left")
    names = ["completions", "attributed", "mean_similarity", "unobserved", "ci_linked", "ci_passed", "explicit_accepts", "explicit_rejects", "failures", "rejects_by_harness", "fates", "accepted_fates", "external_fates"]
    out = out.select("model", *names)
    out = out.na.fill(0, ["attributed", "unobserved", "ci_linked", "ci_passed", "explicit_accepts", "explicit_rejects"]).na.fill(0.0, ["mean_similarity"]).na.fill("", ["failures", "rejects_by_harness", "fates", "accepted_fates", "external_fates"])
    low, high = wilson(F.col("attributed"), F.col("completions"))
    ci_low, ci_high = wilson(F.col("ci_passed"), F.col("ci_linked"))
    rates = {"attribution_rate": ratio(F.col("attributed"), F.col("completions")), "low": low, "high": high, "ci_rate": ratio(F.col("ci_passed"), F.col("ci_linked")), "ci_low": ci_low, "ci_high": ci_high}
    return out.withColumns(rates)


def signal_funnel(calls: DataFrame, attributed: DataFrame, verdicts: DataFrame, decisions: DataFrame, commit: list[str]) -> DataFrame:
    """Calls of each model that were attributed, have a verdict on an observed commit, have an explicit decision, and can be a training row; with the share of the stage before."""
    linked = attributed.where("observed").join(verdicts.where("verdict is not null"), commit).select("call_id").distinct().withColumn("_ci", F.lit(True))
    said = decisions.where("explicit").select("call_id").distinct().withColumn("_said", F.lit(True))
    known = attributed.select("call_id").distinct().withColumn("_attributed", F.lit(True))
    rows = calls.where("model is not null").join(known, "call_id", "left").join(linked, "call_id", "left").join(said, "call_id", "left")
    ci, own = F.coalesce("_ci", F.lit(False)), F.coalesce("_said", F.lit(False))
    sums = rows.groupBy("model").agg(F.count("*").alias("completions"), F.count_if("_attributed").alias("attributed"), F.count_if(ci).alias("ci_linked"), F.count_if(own).alias("has_decision"), F.count_if(ci | own).alias("eligible"))
    names = ["completions", "attributed", "ci_linked", "has_decision", "eligible"]
    return sums.select("model", *names, *(ratio(F.col(b), F.col(a)).alias(f"{b}_rate") for a, b in zip(names, names[1:], strict=False)))


def recovery_yield(sizes: DataFrame, size: str, cap: int = RECOVERY_CAP) -> DataFrame:
    """(kept, n, low, median, p90, high, histogram): changed lines of recoveries within the cap and beyond it; p90 is the value at rank ceil(0.9 n), the histogram ``bin=n`` in bin order."""
    rows = sizes.withColumn("kept", F.col(size) <= cap)
    basic = rows.groupBy("kept").agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"))
    found = quantiles(rows, ["kept"], size, {"median": 0.5}, {"p90": 0.9})
    bins = rows.groupBy("kept", size_label(F.col(size), cap).alias("bin")).agg(F.min(size).alias("_at"), F.count("*").alias("_n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.concat("bin", F.lit("="), F.col("_n").cast("string")).alias("t")))), lambda x: x["t"]), ",")
    return with_quantiles(basic, found, ["kept"]).join(bins.groupBy("kept").agg(shown.alias("histogram")), "kept")


REWORK = ("rejected", "retried", "failed_ci", "reverted", "deleted", "external_changes")


def accepted_work(sessions: DataFrame, group: list[str], examples: int = 3) -> DataFrame:
    """Each group's sessions through five stages, six kinds of rework, how much of the evidence is there, and the first sessions with rework.

    ``sessions``: session_id, accepted, attributed, verdict (passed, failed, ``ambiguous`` or null), merged (null: not supported), and a flag for each kind of ``REWORK``.
    """
    reached, stages = F.lit(True), []
    tests = {"accepted": F.col("accepted"), "attributed": F.col("attributed"), "resolved": F.col("verdict").isin("passed", "failed"), "passed": F.col("verdict") == "passed", "merged": F.col("merged")}
    for name, test in tests.items():
        reached = reached & F.coalesce(test, F.lit(False))
        stages.append(F.count_if(reached).alias(name))
    any_rework = F.lit(False)
    for kind in REWORK:
        any_rework = any_rework | F.coalesce(kind, F.lit(False))
    rework = [F.count_if(F.coalesce(kind, F.lit(False))).alias(f"{kind}_sessions") for kind in REWORK]
    evidence = [
        F.count_if(F.col("verdict").isin("passed", "failed")).alias("observed"), F.count_if(F.col("verdict").isNull()).alias("missing"), F.count_if(F.col("merged").isNull()).alias("unsupported"), F.count_if(F.col("verdict") == "ambiguous").alias("ambiguous"),
    ]
    sums = sessions.groupBy(*group).agg(F.count("*").alias("sessions"), *stages, *rework, *evidence, F.count_if(any_rework).alias("reworked"))
    order = Window.partitionBy(*group).orderBy("session_id")
    first = sessions.where(any_rework).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= examples)
    shown = first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col("session_id").cast("string").alias("s")))), lambda x: x["s"]), ",").alias("examples"))
    return sums.join(shown, group, "left").na.fill("", ["examples"])


def retention_summary(rows: DataFrame, scores: list[str], group: list[str]) -> DataFrame:
    """(group, score, n, mean, median, p10, p90, below, rates): exact, linear between ranks; how many are below each of ``THRESHOLDS`` as ``threshold=n`` and which share."""
    each = rows.select(*group, F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores))).alias("s")).select(*group, "s.score", "s.value").where("value is not null")
    under = [F.count_if(F.col("value") < t) for t in THRESHOLDS]
    below = F.concat_ws(",", *(F.concat(F.lit(f"{t}="), n.cast("string")) for t, n in zip(THRESHOLDS, under, strict=True)))
    sums = each.groupBy(*group, "score").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), below.alias("below"), F.array(*(n / F.count("*") for n in under)).alias("rates"))
    return with_quantiles(sums, quantiles(each, [*group, "score"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9}), [*group, "score"])


def compute_arms(timings: DataFrame, arm: list[str], durations: list[str]) -> DataFrame:
    """(arm, sessions, changed, and the quartiles of each duration) of session timings (arm, changed, durations in ms)."""
    sums = timings.groupBy(*arm).agg(F.count("*").alias("sessions"), F.count_if("changed").alias("changed"))
    each = timings.select(*arm, F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).cast("double").alias("v")) for d in durations))).alias("x")).select(*arm, "x.d", "x.v")
    found = quantiles(each, [*arm, "d"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    wide = found.groupBy(*arm).agg(*(F.max(F.when(F.col("d") == d, F.col(n))).alias(f"{d}_{n}") for d in durations for n in ("p25", "median", "p75")))
    return with_quantiles(sums, wide, arm)


def arm_differences(arms: DataFrame, source: str, arm: str, durations: list[str]) -> DataFrame:
    """(source, arm_a, arm_b, median differences): each pair of arms of one allocation source; arms are few."""
    a = arms.select(source, F.col(arm).alias("arm_a"), *(F.col(f"{d}_median").alias(f"a_{d}") for d in durations))
    b = arms.select(source, F.col(arm).alias("arm_b"), *(F.col(f"{d}_median").alias(f"b_{d}") for d in durations))
    return a.join(b, source).where("arm_a < arm_b").select(source, "arm_a", "arm_b", *((F.col(f"b_{d}") - F.col(f"a_{d}")).alias(f"{d}_difference") for d in durations))


def dataset_distributions(rows: DataFrame, stratum: list[str], model: str, value: str) -> DataFrame:
    """(stratum, model, n, mean, median, low, high, deviation) with an ``overall`` row for each stratum; the sample deviation of one row is 0."""
    both = rows.select(*stratum, model, value).withColumn("_m", F.explode(F.array(F.col(model).cast("string"), F.lit("overall"))))
    out = both.groupBy(*stratum, F.col("_m").alias("model")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("deviation"))
    out = with_quantiles(out, quantiles(both.drop(model).withColumnRenamed("_m", "model"), [*stratum, "model"], value, {"median": 0.5}), [*stratum, "model"])
    return out.withColumn("deviation", F.when(F.col("n") > 1, F.col("deviation")).otherwise(F.lit(0.0)))


def pair_sparsity(completions: DataFrame, bucket: list[str], cap: int = 3) -> DataFrame:
    """One row: buckets, candidates, the size histogram, candidates that are alone and their share, buckets with more pairs than the cap.

    ``completions``: bucket, id, good (true chosen, false rejected, null neither), one row for an id.
    """
    sizes = completions.where("good is not null").groupBy(*bucket).agg(F.count_if("good").alias("_c"), F.count_if(~F.col("good")).alias("_r")).withColumn("_n", F.col("_c") + F.col("_r"))
    bins = {"1": F.col("_n") == 1, "2": F.col("_n") == 2, "3-5": F.col("_n").between(3, 5), "6-10": F.col("_n").between(6, 10), "10+": F.col("_n") > 10}
    histogram = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), F.count_if(test).cast("string")) for k, test in bins.items()))
    out = sizes.agg(
        F.count("*").alias("buckets"), F.coalesce(F.sum("_n"), F.lit(0)).alias("candidates"), histogram.alias("histogram"), F.count_if(F.col("_n") == 1).alias("alone"), F.count_if(F.col("_c") * F.col("_r") > cap).alias("capped")
    )
    return out.withColumn("alone_share", ratio(F.col("alone"), F.col("candidates")))


def bin_inversions(bins: DataFrame, least: int = 1) -> DataFrame:
    """(lower_bin, upper_bin, lower_rate, upper_rate): pairs of calibration bins of which the higher one has the lower rate. Bins are a report's few rows."""
    a = bins.where(F.col("n") >= least).select(F.col("bin").alias("lower_bin"), F.col("rate").alias("lower_rate"))
    b = bins.where(F.col("n") >= least).select(F.col("bin").alias("upper_bin"), F.col("rate").alias("upper_rate"))
    return a.join(b, (F.col("lower_bin") < F.col("upper_bin")) & (F.col("lower_rate") > F.col("upper_rate"))).select("lower_bin", "upper_bin", "lower_rate", "upper_rate")


def best_threshold(sweep: DataFrame, pinned: float) -> DataFrame:
    """One row: the threshold of the best F1 (the smallest of equal ones), the pinned one's F1, and whether its Wilson interval of precision leaves the best one's precision out."""
    best = sweep.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"), "precision")).alias("m")).select((-F.col("m.t")).alias("best"), F.col("m.f1").alias("best_f1"), F.col("m.precision").alias("best_precision"))
    own = sweep.where(F.col("threshold") == F.lit(pinned)).select("threshold", "f1", "precision", "tp", "fp")
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    both = own.withColumns({"low": low, "high": high}).join(best)
    return both.select("threshold", "f1", "best", "best_f1", "low", "high", ((F.col("best") != F.col("threshold")) & ~F.col("best_precision").between(F.col("low"), F.col("high"))).alias("drift"))


def enriched_recoveries(pairs: DataFrame, attributed: DataFrame) -> DataFrame:
    """pairs (red_commit, green_commit) with the calls and sessions that the green commit is attributed to, and ``evidence``: attributed or none."""
    known = attributed.groupBy("green_commit").agg(F.count_distinct("call_id").alias("calls"), F.count_distinct("session_id").alias("sessions"), F.max("similarity").alias("similarity"))
    out = pairs.join(known, "green_commit", "left").na.fill(0, ["calls", "sessions"])
    return out.withColumn("evidence", F.when(F.col("calls") > 0, "attributed").otherwise("none"))


def trajectory(commits: DataFrame, session: str, committed_at: str, tie: list[str]) -> DataFrame:
    """commits with ``position``: the order of a session's commits by committer time, then repository and sha."""
    return commits.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(committed_at, *tie)))


def two_proportions(rates: DataFrame, name: str, z: Column, comparisons: Column, least: int = 30) -> DataFrame:
    """Each pair of groups (name, n, successes): pooled z, unpooled interval of the difference at quantile ``z``, flags.

    ``degenerate``: no variance; ``insufficient``: fewer than ``least`` trials on a side; ``comparisons``: by how many the p value is to be multiplied.
    """
    a = rates.select(F.col(name).alias("left"), F.col("n").alias("na"), F.col("successes").alias("sa"))
    b = rates.select(F.col(name).alias("right"), F.col("n").alias("nb"), F.col("successes").alias("sb"))
    both = a.join(b, F.col("left") < F.col("right"))
    p, q = F.col("sa") / F.col("na"), F.col("sb") / F.col("nb")
    pooled = (F.col("sa") + F.col("sb")) / (F.col("na") + F.col("nb"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("na") + 1 / F.col("nb")))
    own = F.sqrt(p * (1 - p) / F.col("na") + q * (1 - q) / F.col("nb"))
    return both.select(
        "left", "right", (p - q).alias("difference"), F.when(error > 0, (p - q) / error).alias("z"), (p - q - z * own).alias("low"), (p - q + z * own).alias("high"),
        (error == 0).alias("degenerate"), (F.least("na", "nb") < least).alias("insufficient"), comparisons.alias("comparisons"),
    )
