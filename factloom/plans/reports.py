"""Reports over derived rows: outcomes, funnels, trends, strata, calibration, agreement, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cohens_h, ratio, two_proportion_z, wilson, wilson_sql  # noqa: F401  reports' SQL uses it
from ..functions.times import micros
from ..operators.sequences import numbered, quantiles, with_quantiles


def outcome_rates(trials: DataFrame, group: list[str], success: str) -> DataFrame:
    """(group, n, successes, rate, low, high): Wilson interval of each group's rate."""
    sums = trials.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("int")).cast("long").alias("successes"))
    low, high = wilson(F.col("successes"), F.col("n"))
    return sums.select(*group, "n", "successes", ratio(F.col("successes"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def attribution_share(attributed: DataFrame) -> DataFrame:
    """(org_id, repository, commits, n, git_notes, jaccard, unattributed, low, high) of ``attribution.attribute`` rows: n commits could be an agent's, as they change code.

    A commit with a noted file counts as noted, else one with a similar file as jaccard. The interval is Wilson's, of the attributed share.
    """
    readable = ~F.coalesce(F.col("reason").isin("no_code_diff", "commit_diff_unavailable"), F.lit(False))
    told = lambda source: F.max(F.coalesce(F.col("source") == source, F.lit(False)))
    commits = attributed.groupBy("org_id", "repository", "commit_sha").agg(told("git_notes").alias("noted"), told("jaccard").alias("guessed"), F.max(readable).alias("plausible"))
    out = commits.groupBy("org_id", "repository").agg(F.count("*").alias("commits"), F.count_if("plausible").alias("n"), F.count_if("noted").alias("git_notes"), F.count_if(~F.col("noted") & F.col("guessed")).alias("jaccard"))
    found = F.col("git_notes") + F.col("jaccard")
    low, high = wilson(found, F.col("n"))
    return out.select("*", (F.col("n") - found).alias("unattributed"), low.alias("low"), high.alias("high"))


def funnel(rows: DataFrame, group: list[str], key: str, stages: dict[str, Column]) -> DataFrame:
    """Distinct keys of each stage, where a stage counts a key only if it passed the stages before it, and the share of each stage's predecessor."""
    reached, counts = F.lit(True), []
    for name, test in stages.items():
        reached = reached & F.coalesce(test, F.lit(False))
        counts.append(F.count_distinct(F.when(reached, F.col(key))).alias(name))
    out = rows.groupBy(*group).agg(*counts)
    names = list(stages)
    return out.select(*group, *names, *(ratio(F.col(b), F.col(a)).alias(f"{b}_rate") for a, b in zip(names, names[1:], strict=False)))


def tumbling(trials: DataFrame, group: list[str], at: str, success: str, days: int, anchor: str = "1970-01-01") -> DataFrame:
    """(group, bucket, n, successes, rate) of windows of whole days from an anchor."""
    width = days * 86_400_000_000
    bucket = F.floor((micros(at) - micros(F.lit(anchor).cast("timestamp"))) / width).cast("long")
    sums = trials.groupBy(*group, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("int")).cast("long").alias("successes"))
    return sums.withColumn("rate", ratio(F.col("successes"), F.col("n")))


def pairwise(rates: DataFrame, name: str) -> DataFrame:
    """(left, right, difference, h, z) of each pair of groups of an (n, successes) table. The groups are a report's few rows."""
    a = rates.select(F.col(name).alias("left"), F.col("n").alias("n_left"), F.col("successes").alias("s_left"))
    b = rates.select(F.col(name).alias("right"), F.col("n").alias("n_right"), F.col("successes").alias("s_right"))
    both = a.join(b, F.col("left") < F.col("right"))
    p, q = ratio(F.col("s_left"), F.col("n_left")), ratio(F.col("s_right"), F.col("n_right"))
    return both.select("left", "right", (p - q).alias("difference"), cohens_h(p, q).alias("h"), two_proportion_z(F.col("s_left"), F.col("n_left"), F.col("s_right"), F.col("n_right")).alias("z"))


def strata(trials: DataFrame, group: str, stratum: str, success: str) -> DataFrame:
    """(group, stratum, n, successes): every stratum of every group, and the whole group with a null stratum, in one pass."""
    sets = trials.select(group, stratum, F.col(success).cast("int").alias("_s")).groupingSets([[group], [group, stratum]], group, stratum)
    return sets.agg(F.count("*").alias("n"), F.sum("_s").cast("long").alias("successes"))


def mantel_haenszel(trials: DataFrame, group: str, stratum: str, success: str) -> DataFrame:
    """(left, right, risk_difference): differences within strata weighted by n_l * n_r / (n_l + n_r)."""
    cells = trials.groupBy(group, stratum).agg(F.count("*").alias("n"), F.avg(F.col(success).cast("double")).alias("p"))
    a = cells.select(stratum, F.col(group).alias("left"), F.col("n").alias("nl"), F.col("p").alias("pl"))
    b = cells.select(stratum, F.col(group).alias("right"), F.col("n").alias("nr"), F.col("p").alias("pr"))
    both = a.join(b, stratum).where(F.col("left") < F.col("right")).withColumn("w", F.col("nl") * F.col("nr") / (F.col("nl") + F.col("nr")))
    return both.groupBy("left", "right").agg((F.sum(F.col("w") * (F.col("pl") - F.col("pr"))) / F.sum("w")).alias("risk_difference"))


def reversals(trials: DataFrame, group: str, stratum: str, success: str) -> DataFrame:
    """(left, right, difference, strata, reversed, paradox): strata whose direction is against the aggregate's; a paradox if all are."""
    cells = strata(trials, group, stratum, success).withColumn("p", ratio(F.col("successes"), F.col("n")))
    a, b = (cells.select(F.col(group).alias(s), F.col(stratum).alias("at"), F.col("p").alias(f"p_{s}")) for s in ("left", "right"))
    both = a.join(b.withColumnRenamed("at", "at2"), F.col("at").eqNullSafe(F.col("at2")) & (F.col("left") < F.col("right"))).withColumn("d", F.col("p_left") - F.col("p_right"))
    pairs = both.groupBy("left", "right").agg(F.max(F.when(F.col("at").isNull(), F.col("d"))).alias("difference"), *(F.count_if(F.col("at").isNotNull() & (F.signum("d") == k)).cast("int").alias(f"_{n}") for n, k in (("up", 1), ("same", 0), ("down", -1))))
    strata_of = F.col("_up") + F.col("_same") + F.col("_down")
    against = F.when(F.col("difference") > 0, F.col("_down")).when(F.col("difference") < 0, F.col("_up")).otherwise(F.col("_same"))
    return pairs.select("left", "right", "difference", strata_of.alias("strata"), against.alias("reversed"), ((against == strata_of) & (strata_of > 0) & (F.col("difference") != 0)).alias("paradox"))


def shrunken(rates: DataFrame) -> DataFrame:
    """rates (n, successes) with ``shrunken``: beta-binomial empirical Bayes by the method of moments over the groups of the report."""
    everything = Window.partitionBy(F.lit(0))
    n, s = F.col("n").cast("double"), F.col("successes").cast("double")
    total = F.sum(n).over(everything)
    mean = F.sum(s).over(everything) / total
    p = s / n
    spread = F.sum(n * (p - mean) * (p - mean)).over(everything) / total
    groups = F.count("*").over(everything)
    within = mean * (1 - mean) * groups / total
    between = spread - within
    k = F.when(between > 0, F.greatest(mean * (1 - mean) / between - 1, F.lit(0.0))).otherwise(total)
    return rates.select("*", ((s + k * mean) / (n + k)).alias("shrunken"))


#: Boundaries of the histogram of diff sizes and the lines of a recovery's diff that count at most.
SIZE_BOUNDS, RECOVERY_CAP = (0, 5, 10, 25, 50, 100, 200, 500, 1000), 200


def size_label(size: Column, cap: int = RECOVERY_CAP) -> Column:
    """The name of a size's bin: bins end with a boundary (the cap among them) and begin after the one before; beyond the last is a bin of its own."""
    bounds = sorted({*SIZE_BOUNDS, max(0, cap)})
    name = F.when(size <= bounds[0], str(bounds[0]))
    for before, bound in zip(bounds, bounds[1:], strict=False):
        name = name.when(size <= bound, str(bound) if before + 1 == bound else f"{before + 1}-{bound}")
    return name.otherwise(f">{bounds[-1]}")


def size_histogram(rows: DataFrame, size: str, cap: int = RECOVERY_CAP) -> DataFrame:
    """(bin, n)."""
    return rows.groupBy(size_label(F.col(size), cap).alias("bin")).agg(F.count("*").alias("n"))


def quartiles(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, p10, q1, median, q3, p90): exact, linear between ranks."""
    sums = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return with_quantiles(sums, quantiles(rows, group, value, {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}), group)


def diagnostics(rows: DataFrame, stratum: str, model: str, value: str) -> DataFrame:
    """(stratum, model, n, mean, low, high, deviation) with an ``overall`` row for each stratum; the sample deviation of one row is 0."""
    sets = rows.groupingSets([[F.col(stratum)], [F.col(stratum), F.col(model)]], stratum, model)
    out = sets.agg(F.grouping(model).alias("_g"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.coalesce(F.try_divide(F.lit(0.0), F.lit(1.0)) * 0 + F.stddev_samp(value), F.lit(0.0)).alias("deviation"))
    return out.select(stratum, F.when(F.col("_g") == 1, "overall").otherwise(F.col(model).cast("string")).alias(model), "n", "mean", "low", "high", "deviation")


def split_leaks(rows: DataFrame, prompt: str, split: str) -> DataFrame:
    """(prompt, train, eval): normalized prompts that stand in both splits."""
    normal = F.lower(F.trim(prompt))
    both = rows.groupBy(normal.alias("prompt")).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "eval").alias("eval"))
    return both.where("train > 0 and eval > 0")


def bucket_sparsity(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """(size_bin, buckets, rows): how large the buckets are."""
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("n"))
    name = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").otherwise("10+")
    return sizes.groupBy(name.alias("size_bin")).agg(F.count("*").alias("buckets"), F.sum("n").alias("rows"))


def calibration(pairs: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate, gap): reliability bins of equal width, the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    sums = pairs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    return sums.withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_summary(pairs: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row: n, brier, auroc (ties by average rank, 0 without both labels), ece. Ranks are given by range, so no task sorts all pairs."""
    y = F.col(label).cast("double")
    basic = pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(score) - y) * (F.col(score) - y)), F.lit(0.0)).alias("brier"))
    placed = numbered(pairs.select(F.col(score).alias("_s"), y.alias("_y")), ["_s"], "_i", "_t")
    values = placed.groupBy("_s").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"), F.avg("_i").alias("_r"))
    ranked = values
    sums = ranked.agg(F.sum(F.col("_r") * F.col("_p")).alias("r"), F.sum("_p").alias("p"), F.sum("_n").alias("t"))
    negatives = F.col("t") - F.col("p")
    auroc = sums.select(F.when((F.col("p") > 0) & (negatives > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * negatives)).otherwise(0.0).alias("auroc"))
    ece = calibration(pairs, score, label, bins).agg(F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), F.lit(0.0)).alias("ece"))
    return basic.join(auroc).join(ece)


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa, degenerate (chance agreement 1: kappa is 0)."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, "v").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("chance"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    both = total.join(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.col("chance") / (F.col("n") * F.col("n"))).alias("e"))
    return both.select("n", "agreement", F.when(F.col("e") == 1, 0.0).otherwise((F.col("agreement") - F.col("e")) / (1 - F.col("e"))).alias("kappa"), (F.col("e") == 1).alias("degenerate"))


def threshold_sweep(cases: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) in one pass over the cases."""
    each = cases.select(score, F.col(truth).cast("boolean").alias("_t"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    said = F.col(score) >= F.col("threshold")
    sums = each.groupBy("threshold").agg(F.count_if(said & F.col("_t")).alias("tp"), F.count_if(said & ~F.col("_t")).alias("fp"), F.count_if(~said & F.col("_t")).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("*", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def precision_against(manifest: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(source, tp, fp, fn) of found rows (keys, source) against expected ones (keys)."""
    both = found.select(*keys, "source").withColumn("_f", F.lit(True)).join(manifest.select(*keys).distinct().withColumn("_m", F.lit(True)), keys, "full_outer")
    return both.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count_if(F.col("_f") & F.col("_m")).alias("tp"), F.count_if(F.col("_f") & F.col("_m").isNull()).alias("fp"), F.count_if(F.col("_f").isNull() & F.col("_m")).alias("fn")
    )


def share_alerts(current: DataFrame, baseline: DataFrame, repo: str, least: int) -> DataFrame:
    """(repo, alert) of (n, successes, low, high) tables: zero share, or a fall whose intervals do not meet with enough commits on both sides."""
    b = baseline.select(repo, F.col("n").alias("bn"), F.col("low").alias("bl"))
    both = current.join(b, repo, "left")
    alert = F.when(F.col("successes") == 0, "zero_share").when((F.col("n") >= least) & (F.col("bn") >= least) & (F.col("high") < F.col("bl")), "decline")
    return both.select(repo, alert.alias("alert")).where("alert is not null")


def confusion(universe: DataFrame, manifest: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, tn over all pairs that could have been found."""
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = universe.select(*keys).distinct().join(flag(manifest, "_m"), keys, "left").join(flag(found, "_f"), keys, "left")
    m, f = F.coalesce("_m", F.lit(False)), F.coalesce("_f", F.lit(False))
    return both.agg(F.count_if(f & m).alias("tp"), F.count_if(f & ~m).alias("fp"), F.count_if(~f & m).alias("fn"), F.count_if(~f & ~m).alias("tn"))
