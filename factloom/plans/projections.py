"""Training rows: preference pairs, curated samples, diffs, recoveries, rewards."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros

PAIR_CAP = 3
FLOOR, KEPT = 0.6, 0.8


def preference_pairs(completions: DataFrame, bucket: list[str], cap: int = PAIR_CAP) -> DataFrame:
    """(bucket, chosen_id, rejected_id, chosen_confidence, rejected_confidence, margin, label_confidence); the smaller confidence is the pair's.

    ``completions``: bucket, id, good (null: neither), confidence, text. The best row of a call stands for it. Of each bucket the first ``cap`` pairs
    in (chosen, rejected) id order are looked at; those whose texts are the same go, without a refill: only the first ``cap`` ids of a
    side can be in them, so sides are cut before they meet.
    """
    best = completions.groupBy(*bucket, "id").agg(F.max(F.struct("confidence", "text", "good")).alias("m")).select(*bucket, "id", "m.*")
    order = Window.partitionBy(*bucket).orderBy("id")
    side = lambda test, name: best.where(test).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= cap).select(*bucket, F.col("id").alias(f"{name}_id"), F.col("confidence").alias(f"{name}_confidence"), F.col("text").alias(f"{name}_text"))
    both = side(F.col("good"), "chosen").join(side(~F.col("good"), "rejected"), bucket)
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy(*bucket).orderBy("chosen_id", "rejected_id"))).where(F.col("_n") <= cap)
    margin = F.col("chosen_confidence") - F.col("rejected_confidence")
    kept = ranked.where(F.col("chosen_text") != F.col("rejected_text"))
    return kept.select(*bucket, "chosen_id", "rejected_id", "chosen_confidence", "rejected_confidence", margin.alias("margin"), F.least("chosen_confidence", "rejected_confidence").alias("label_confidence"))


def eligibility(recipe: str) -> tuple[Column, Column]:
    """(source, reason) of a completion as a sample of a recipe: what makes it one, or why it is none.

    Columns: kind (decision branch), vetoed (any explicit reject), accepted (any explicit accept), kept (the best retention of its accepted decisions), failed (any
    workflow failed), verdict, flake. Abandonment, an explicit reject and any failed workflow rule out both recipes. ``sft_curated`` wants an explicit accept or an
    accepted decision with retention of ``KEPT``; ``sft_verified`` a pass that is no suspected flake.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    passed = F.coalesce(F.col("verdict") == "passed", F.lit(False))
    bad = F.when(F.col("kind") == "abandoned", "abandoned").when(yes("vetoed"), "explicit_reject").when(yes("failed"), "resolved_ci_failure")
    if recipe == "sft_verified":
        reason = bad.when(~passed, "no_eligibility_source").when(yes("flake"), "unreliable_ci_resolution")
        return F.when(reason.isNull(), "resolved_ci_pass"), reason
    source = F.when(yes("accepted"), "explicit_accept").when(F.coalesce(F.col("kept"), F.lit(0.0)) >= KEPT, "edit_retention")
    reason = bad.when(source.isNull(), "no_eligibility_source")
    return F.when(reason.isNull(), source), reason


def below_floor(reason: Column, confidence: Column, floor: float = FLOOR) -> Column:
    return F.coalesce(reason, F.when(confidence.isNull(), "no_reward_signal").when(confidence < floor, "below_confidence_floor"))


def one_per_call(rows: DataFrame, call: str, evidence: str) -> DataFrame:
    """The row of each call with the largest confidence, then the largest evidence key; calls whose rows disagree on ``text`` are dropped."""
    order = Window.partitionBy(call).orderBy(F.desc("confidence"), F.desc(evidence))
    w = Window.partitionBy(call)
    marked = rows.withColumn("_r", F.row_number().over(order)).withColumn("_same", F.min("text").over(w) == F.max("text").over(w))
    return marked.where("_r = 1 and _same").drop("_r", "_same")


def diff_samples(members: DataFrame) -> DataFrame:
    """(call, commit_sha, source, confidence, diff): the sections of a call's commit joined in diff order, if all have one source; the smallest confidence counts."""
    grouped = members.groupBy("call", "commit_sha").agg(
        F.min("source").alias("source"), F.max("source").alias("other"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("position", "patch"))).alias("sections")
    )
    diff = F.array_join(F.transform("sections", lambda s: s["patch"]), "\n")
    return grouped.where("source = other").select("call", "commit_sha", "source", "confidence", diff.alias("diff"))


def recovery_rows(pairs: DataFrame, sizes: DataFrame, evaluated: DataFrame, most: int = 200) -> DataFrame:
    """(red_commit, green_commit, changed, split) of red-to-green pairs whose diff is not above ``most`` lines; eval if either commit's session is."""
    sized = pairs.join(sizes, "green_commit").where(F.col("changed") <= most)
    flags = evaluated.groupBy("commit_sha").agg(F.max("is_eval").alias("is_eval"))
    red, green = flags.toDF("red_commit", "red_eval"), flags.toDF("green_commit", "green_eval")
    both = sized.join(red, "red_commit", "left").join(green, "green_commit", "left")
    return both.select("red_commit", "green_commit", "changed", F.when(F.coalesce("red_eval", F.lit(False)) | F.coalesce("green_eval", F.lit(False)), "eval").otherwise("train").alias("split"))


def rewards(trajectories: DataFrame) -> DataFrame:
    """(session_id, commit_sha, reward): 1 or 0 by the verdict of the last commit with one, null if none has."""
    known = F.col("verdict").isNotNull()
    last = trajectories.groupBy("session_id").agg(F.max(F.when(known, F.struct("position", "commit_sha", "verdict"))).alias("m"))
    return last.select("session_id", F.col("m.commit_sha").alias("commit_sha"), F.when(F.col("m.verdict") == "passed", 1).when(F.col("m.verdict") == "failed", 0).alias("reward"))


def best_confidence(rows: DataFrame, model: str, call: str, floor: float = FLOOR) -> DataFrame:
    """(model, calls, excluded, rate): calls whose best confidence is below the floor."""
    best = rows.groupBy(model, call).agg(F.max("confidence").alias("c"))
    out = best.groupBy(model).agg(F.count("*").alias("calls"), F.count_if(F.col("c") < floor).alias("excluded"))
    return out.withColumn("rate", F.col("excluded") / F.col("calls"))


def decision_latency(rows: DataFrame, key: str, at: str, decided: str, buckets: int) -> DataFrame:
    """(bucket, n, low, high, mean_confidence) of latencies in milliseconds, buckets by position; negative latencies are left out and one bucket holds constant ones."""
    from ..operators.sequences import quantile_buckets

    ms = F.floor((micros(decided) - micros(at)) / 1000)
    timed = rows.withColumn("latency", ms).where("latency >= 0").groupBy(key).agg(F.min("latency").alias("latency"), F.min("confidence").alias("confidence"))
    placed = quantile_buckets(timed, "latency", key, buckets)
    flat = placed.agg((F.min("latency") == F.max("latency")).alias("_flat"))
    placed = placed.join(F.broadcast(flat)).withColumn("bucket", F.when(F.col("_flat"), F.lit(-1)).otherwise(F.col("bucket")))
    return placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("latency").alias("low"), F.max("latency").alias("high"), F.avg("confidence").alias("mean_confidence"))


def recipe_pairs(completions: DataFrame, recipe: str, cap: int = PAIR_CAP) -> DataFrame:
    """Preference pairs of a recipe, within (org_id, model, prompt_key), with the split of the pair: eval if either side's session is.

    ``completions``: org_id, model, prompt_key, id, text, confidence, kind (decision branch), verdict, flake, is_eval. ``dpo_human``
    takes explicit decisions for labels (an abandoned accept is none), ``dpo_outcome`` resolved CI verdicts that are no suspected flake; a completion without the
    recipe's label is on neither side.
    """
    sure = ~F.coalesce("flake", F.lit(False))
    good = {
        "dpo_human": F.when(F.col("kind") == "explicit_accept", True).when(F.col("kind") == "explicit_reject", False),
        "dpo_outcome": F.when(sure & (F.col("verdict") == "passed"), True).when(sure & (F.col("verdict") == "failed"), False),
    }[recipe]
    bucket = ["org_id", "model", "prompt_key"]
    pairs = preference_pairs(completions.select(*bucket, "id", good.alias("good"), "confidence", "text"), bucket, cap)
    flags = completions.groupBy("id").agg(F.max("is_eval").alias("e"))
    both = pairs.join(flags.toDF("chosen_id", "ce"), "chosen_id").join(flags.toDF("rejected_id", "re"), "rejected_id")
    return both.select(F.lit(recipe).alias("recipe"), *pairs.columns, F.when(F.col("ce") | F.col("re"), "eval").otherwise("train").alias("split"))


def sample_rows(completions: DataFrame, recipe: str) -> DataFrame:
    """(recipe, id, model, confidence, source, reason): a row for each completion, with what makes it a sample or why it is none (see ``eligibility``)."""
    source, reason = eligibility(recipe)
    told = below_floor(reason, F.col("confidence"))
    return completions.select(F.lit(recipe).alias("recipe"), "id", "model", "confidence", F.when(told.isNull(), source).alias("source"), told.alias("reason"))


def tasks(trajectories: DataFrame, patches: DataFrame) -> DataFrame:
    """(session_id, repo, commit_sha, reward, patch, sections): a task for each session whose last commit with a verdict has a patch.

    ``trajectories`` (session_id, repo, commit_sha, position, verdict), ``patches`` (commit_sha, position, patch): the reference patch is the sections in diff order.
    """
    last = trajectories.where("verdict is not null").groupBy("session_id").agg(F.max(F.struct("position", "repo", "commit_sha", "verdict")).alias("m")).select("session_id", "m.repo", "m.commit_sha", "m.verdict")
    joined = patches.groupBy("commit_sha").agg(F.array_sort(F.collect_list(F.struct("position", "patch"))).alias("s"))
    reward = F.when(F.col("verdict") == "passed", 1).when(F.col("verdict") == "failed", 0)
    return last.join(joined, "commit_sha").select("session_id", "repo", "commit_sha", reward.alias("reward"), F.array_join(F.transform("s", lambda x: x["patch"]), "\n").alias("patch"), F.size("s").alias("sections"))


#: Which decision branches each knob of the ladder bears on.
BRANCHES = {
    "explicit_accept": ["explicit_accept"], "explicit_reject": ["abandoned", "explicit_reject"], "base": ["none", "implicit_reject", "neutral", "implicit_accept"], "up": ["implicit_accept"], "down": ["implicit_reject", "implicit_accept"],
}


def _bears(knob: str) -> Column:
    if knob in BRANCHES:
        return F.col("kind").isin(BRANCHES[knob])
    known = F.col("verdict").isNotNull()
    tests = {
        "ci_pass": F.col("verdict") == "passed", "ci_fail": F.col("verdict") == "failed", "clean_reliability": known & ~F.col("flake"), "suspected_flake_reliability": known & F.col("flake"), "non_verdict_reliability": known & F.col("non_verdict"),
    }
    return F.coalesce(tests[knob], F.lit(False))


def rescored(rows: DataFrame, score, older: Column, knobs: dict[str, list[float]], policy, floor: float = FLOOR) -> DataFrame:
    """The ladder computed again with one knob of the policy set to each value of its grid, within each eligibility source (null: not eligible).

    (source, knob, setting, affected, n, mean, median, mean_delta, median_delta, eligible, eligible_delta, older_mean, older_eligible). ``rows``: source, kind,
    retention, verdict, flake, non_verdict, similarity; ``score``: a function from a policy to the confidence Column; ``older``: the older policy's Column. Rows with
    the same inputs are one class, so the grid meets classes and medians are read from counts of equal values.
    """
    inputs = ["source", "kind", "retention", "verdict", "flake", "non_verdict", "similarity"]
    classes = rows.groupBy(*inputs).agg(F.count("*").alias("n")).withColumns({"own": score(policy), "older": older})
    cells = [F.struct(F.lit(k).alias("knob"), F.lit(float(v)).alias("setting"), score(replace(policy, **{k: v})).alias("value"), _bears(k).alias("bears")) for k, grid in knobs.items() for v in grid]
    base = F.struct(F.lit("").alias("knob"), F.lit(0.0).alias("setting"), F.col("own").alias("value"), F.lit(False).alias("bears"))
    each = classes.select("source", "n", "older", F.explode(F.array(base, *cells)).alias("g")).select("source", "n", "older", "g.*")
    cell = ["source", "knob", "setting"]
    values = each.groupBy(*cell, "value").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("affected"), F.sum(F.col("older") * F.col("n")).alias("older"), F.sum(F.when(F.col("older") >= floor, F.col("n")).otherwise(0)).alias("older_eligible"))
    known = F.col("value").isNotNull()
    to = F.sum(F.when(known, F.col("n"))).over(Window.partitionBy(*cell).orderBy(F.col("value").asc_nulls_last()))
    total = F.sum(F.when(known, F.col("n"))).over(Window.partitionBy(*cell))
    placed = values.withColumns({"_to": to, "_all": total}).withColumn("_from", F.col("_to") - F.col("n"))
    at = lambda r: F.max(F.when(known & (F.col("_from") < r) & (F.col("_to") >= r), F.col("value")))
    stats = placed.groupBy(*cell).agg(
        F.sum("affected").alias("affected"), F.sum(F.when(known, F.col("n"))).alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(known, F.col("n")))).alias("mean"),
        ((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias("median"),
        F.sum(F.when(F.col("source").isNotNull() & (F.col("value") >= floor), F.col("n")).otherwise(0)).alias("eligible"), (F.sum("older") / F.sum("n")).alias("older_mean"), F.sum(F.when(F.col("source").isNotNull(), F.col("older_eligible")).otherwise(0)).alias("older_eligible"),
    )
    own = stats.where("knob = ''").select(F.col("source").alias("_s"), F.col("mean").alias("_mean"), F.col("median").alias("_median"), F.col("eligible").alias("_eligible"))
    swept = stats.where("knob <> ''").join(F.broadcast(own), F.col("source").eqNullSafe(F.col("_s")))  # a row for a source
    return swept.select(
        *cell, "affected", "n", "mean", "median", (F.col("mean") - F.col("_mean")).alias("mean_delta"), (F.col("median") - F.col("_median")).alias("median_delta"), "eligible", (F.col("eligible") - F.col("_eligible")).alias("eligible_delta"), "older_mean", "older_eligible",
    )
