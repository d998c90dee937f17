"""Operators over ordered rows: tails, segments, busy time, buckets, samples, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z95
from ..functions.text import line_delta
from ..sources.shared import Workspace

DELETED, UNMODIFIED = 0.1, 0.9


def tail_sums(edits: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """edits with ``tail_<value>``: the sum from a row to the end of its group, null if any row from there on has a null."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    missing = F.lit(False)
    for v in values:
        missing |= F.col(v).isNull()
    gaps = F.max(missing).over(frame)
    return edits.select("*", *(F.when(~gaps, F.sum(v).over(frame)).alias(f"tail_{v}") for v in values))


def fate(score: Column) -> Column:
    """deleted, partial or unmodified of a retention score clamped to [0, 1]; null without a score."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(score.isNull(), F.lit(None)).when(s <= DELETED, "deleted").when(s >= UNMODIFIED, "unmodified").otherwise("partial")


def segments(turns: DataFrame, session: str, order: list[str], starts: Column, name: str = "segment") -> DataFrame:
    """turns with a running segment number; a row for which ``starts`` is true begins one, as does a session's first row."""
    w = Window.partitionBy(session).orderBy(*order)
    first = F.row_number().over(w) == 1
    return turns.withColumn("_start", (first | F.coalesce(starts, F.lit(False))).cast("int")).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def rollouts(calls: DataFrame) -> DataFrame:
    """calls (session_id, id, at, input, output: arrays of canonical message strings) with ``segment``, ``reason`` and ``new_input``.

    ``said`` tells whether an output has any content; without that column one that has messages has.

    A call goes on with a segment if its input begins with the input of the call before it and then that call's output; its new messages
    are those after the prior input, the output's echo among them. Else it begins a segment with its full input: ``prior_output_absent`` (no
    output to replay), ``input_history_changed`` or ``prior_output_not_replayed``. A session's first call has no reason.
    """
    w = Window.partitionBy("session_id").orderBy("at", "id")
    any_said = F.col("said") if "said" in calls.columns else F.size("output") > 0
    seen = calls.withColumns({"_before": F.lag("input").over(w), "_said": F.lag("output").over(w), "_any": F.lag(any_said).over(w), "_first": F.row_number().over(w) == 1})
    n, m = F.size(F.coalesce("_before", F.array().cast("array<string>"))), F.size(F.coalesce("_said", F.array().cast("array<string>")))
    begins = lambda whole, part, size: (size == 0) | F.coalesce(F.slice(whole, 1, F.greatest(size, F.lit(1))) == part, F.lit(False))
    reason = (
        F.when(F.col("_first"), F.lit(None)).when(~F.coalesce("_any", F.lit(False)), "prior_output_absent").when(~begins("input", F.col("_before"), n), "input_history_changed")
        .when(~begins("input", F.concat("_before", "_said"), n + m), "prior_output_not_replayed")
    )
    marked = seen.withColumn("reason", reason)
    whole = F.col("_first") | F.col("reason").isNotNull()
    out = marked.withColumn("new_input", F.when(whole, F.col("input")).otherwise(F.slice("input", n + 1, F.greatest(F.size("input") - n, F.lit(1))))).withColumn("_new", whole)
    return out.withColumn("segment", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_said", "_any", "_first", "_new")


def busy_time(intervals: DataFrame, session: str, start: str, end: str) -> DataFrame:
    """(session, elapsed, total, busy, between): length of the union of a session's closed intervals, in their unit, by islands."""
    w = Window.partitionBy(session).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("_new", (reached.isNull() | (F.col(start) > reached)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(session, "_island").agg(F.min(start).alias("a"), F.max(end).alias("b"), F.sum(F.col(end) - F.col(start)).alias("t"))
    sums = merged.groupBy(session).agg((F.max("b") - F.min("a")).alias("elapsed"), F.sum("t").alias("total"), F.sum(F.col("b") - F.col("a")).alias("busy"))
    return sums.withColumn("between", F.col("elapsed") - F.col("busy"))


def final_allocation(allocations: DataFrame, session: str, at: str, arm: str) -> DataFrame:
    """(session, arm, ambiguous): the arm at the latest moment; none if several stand there."""
    latest = allocations.groupBy(session, at).agg(F.min(arm).alias("low"), F.max(arm).alias("high"))
    last = latest.groupBy(session).agg(F.max(F.struct(at, "low", "high")).alias("m"))
    return last.select(session, F.when(F.col("m.low") == F.col("m.high"), F.col("m.low")).alias(arm), (F.col("m.low") != F.col("m.high")).alias("ambiguous"))


def numbered(rows: DataFrame, order: list[str], number: str, total: str) -> DataFrame:
    """rows with their position (from 1) in a total order over the whole table, and the number of rows, without one task that has them all.

    Rows are dealt by range and numbered within each range; a range's offset is the number of rows in the ranges before it.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held = Workspace(rows.sparkSession, "numbered").save(dealt, "rows")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy()).alias(total))
    own = Window.partitionBy("_part").orderBy(*order)
    placed = held.withColumn("_own", F.row_number().over(own)).join(F.broadcast(offsets), "_part")
    return placed.withColumn(number, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def running(rows: DataFrame, group: list[str], order: list[str], weight: Column, to: str, total: str) -> DataFrame:
    """rows with the sum of weights up to them (``to``, themselves included) in the order within their group, and the group's sum, without one task that has a whole group.

    Rows are dealt by range of group and order, so a large group lies in several ranges; a range starts with what the ranges before it hold of its
    group. ``order`` is total within a group, or equal rows may go in any order.
    """
    space = Workspace(rows.sparkSession, "running")
    held = space.save(rows.withColumn("_w", weight).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "rows")
    sums = held.groupBy("_part", *group).agg(F.sum("_w").alias("_n"))  # a row for a group and each range it lies in
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g_{g}") for g in group), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias(total))
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    placed = held.withColumn("_own", F.sum("_w").over(own)).join(offsets, same)
    return placed.withColumn(to, F.col("_own") + F.col("_before")).drop("_w", "_part", "_p", "_own", "_before", *(f"_g_{g}" for g in group))


def quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float], nearest: dict[str, float] = {}) -> DataFrame:
    """(group, the names of ``at`` and ``nearest``): exact quantiles of each group, nulls left out; linear between ranks, or the value at rank ceil(q * n).

    Equal values are counted first, so a value that many rows hold is one row; the wanted ranks are then found by running sums, and no buffer has a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    placed = running(counts, group, [value], F.col("_c"), "_to", "_all").withColumn("_from", F.col("_to") - F.col("_c"))
    held = lambda rank: F.max(F.when((F.col("_from") <= rank) & (F.col("_to") > rank), F.col(value).cast("double")))  # noqa: E731  rank from 0
    out = []
    for name, q in at.items():
        rank = (F.col("_all") - 1) * F.lit(float(q))
        low, high = held(F.floor(rank)), held(F.ceil(rank))
        out.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    out += [held(F.greatest(F.ceil(F.col("_all") * F.lit(float(q)) - 1e-9), F.lit(1)) - 1).alias(name) for name, q in nearest.items()]
    return placed.groupBy(*group).agg(*out)


def with_quantiles(summary: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """A report's rows with the quantiles of their groups, nulls in the groups' keys included."""
    renamed = found.withColumnsRenamed({g: f"_q_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_q_{g}"))
    return summary.join(renamed, same, "left").drop(*(f"_q_{g}" for g in group))


def quantile_buckets(rows: DataFrame, value: str, key: str, buckets: int, within: list[str] = []) -> DataFrame:
    """rows with ``bucket`` by position (within a group): sorted row i of n (from 1) goes to floor((i * buckets - 1) / n)."""
    placed = running(rows, within, [value, key], F.lit(1), "_i", "_n") if within else numbered(rows, [value, key], "_i", "_n")
    return placed.withColumn("bucket", F.floor((F.col("_i") * buckets - 1) / F.col("_n")).cast("int")).drop("_i", "_n")


def round_robin(rows: DataFrame, cell: list[str], key: str, n: int) -> DataFrame:
    """n rows, taken from the cells in turn: all first rows of cells in cell order, then all second ones."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(*cell).orderBy(key)))
    return ranked.where(F.col("position") <= n).orderBy("position", *cell).limit(n)


def mann_kendall(points: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """(group, n, s, variance, z): trend of each group's short series, ties corrected. Series are windows of a report, not raw rows."""
    a = points.select(*group, F.col(at).alias("_i"), F.col(value).alias("_x"))
    b = points.select(*group, F.col(at).alias("_j"), F.col(value).alias("_y"))
    pairs = a.join(b, group).where(F.col("_i") < F.col("_j")) if group else a.join(b, F.col("_i") < F.col("_j"))
    s = pairs.groupBy(*group).agg(F.sum(F.signum(F.col("_y") - F.col("_x"))).cast("long").alias("s"))
    ties = points.groupBy(*group, value).agg(F.count("*").alias("t")).groupBy(*group).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("tied"))
    both = ties.join(s, group, "left") if group else ties.join(s)
    s, n = F.coalesce("s", F.lit(0)), F.col("n")
    out = both.select(*group, "n", s.alias("s"), ((n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18.0).alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")).otherwise(F.lit(0.0)))


def benjamini_hochberg(tests: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """tests with ``rank`` and ``rejected``: those up to the largest rank k with p <= k / m * alpha."""
    ranked = numbered(tests, [p, key], "rank", "_m")
    last = ranked.agg(F.coalesce(F.max(F.when(F.col(p) <= F.col("rank") / F.col("_m") * alpha, F.col("rank"))), F.lit(0)).alias("_last"))
    return ranked.join(F.broadcast(last)).withColumn("rejected", F.col("rank") <= F.col("_last")).drop("_m", "_last")


def prefix_checkpoints(trials: DataFrame, key: list[str], order: list[str], success: str, fractions: list[float]) -> DataFrame:
    """(key, fraction, n, successes) of the first ceil(n * fraction) trials of each group."""
    placed = running(trials, key, order, F.lit(1), "_i", "_n")
    cells = [F.struct(F.lit(float(f)).alias("fraction"), F.ceil(F.col("_n") * f).alias("upto")) for f in fractions]
    each = placed.select(*key, F.col(success).cast("int").alias("_s"), "_i", F.explode(F.array(*cells)).alias("f")).where(F.col("_i") <= F.col("f.upto"))
    return each.groupBy(*key, "f.fraction").agg(F.count("*").alias("n"), F.sum("_s").cast("long").alias("successes"))


def disjoint_blocks(trials: DataFrame, key: list[str], order: list[str], success: str, blocks: int = 10) -> DataFrame:
    """(key, block, n, successes): each group's trials in arrival order cut into disjoint blocks; block b (from 0) has the trials from floor(b * n / blocks) on."""
    placed = running(trials, key, order, F.lit(1), "_i", "_n")
    block = F.floor((F.col("_i") * blocks - 1) / F.col("_n")).cast("int")
    return placed.groupBy(*key, block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("int")).cast("long").alias("successes"))


def effect_decay(blocks: DataFrame, arm: str, checkpoints: DataFrame) -> DataFrame:
    """(left, right, blocks, s, z, decreasing, effect): how the effect between two arms moves over their disjoint blocks.

    The effect of a block is Cohen's h without its sign; blocks that one side lacks are left out. ``s`` and ``z`` are Mann-Kendall's with the variance corrected for
    ties; ``decreasing``: z below -1.96. ``effect``: that of the whole arms (``checkpoints`` at fraction 1).
    """
    h = lambda a, b: F.abs(2 * F.asin(F.sqrt(a)) - 2 * F.asin(F.sqrt(b)))
    rate = F.col("successes") / F.col("n")

    def pairs(df: DataFrame, on: list[str]) -> DataFrame:
        a, b = (df.select(*on, F.col(arm).alias(side), rate.alias(f"_{side}")) for side in ("left", "right"))
        both = a.join(b, on) if on else a.join(b, F.lit(True))
        return both.where("left < right").withColumn("effect", h(F.col("_left"), F.col("_right")))

    series = pairs(blocks, ["block"])
    trend = mann_kendall(series, ["left", "right"], "block", "effect")
    whole = pairs(checkpoints.where("fraction = 1"), ["fraction"]).select("left", "right", "effect")
    return trend.select("left", "right", F.col("n").alias("blocks"), "s", "z", F.coalesce(F.col("z") < -Z95, F.lit(False)).alias("decreasing")).join(whole, ["left", "right"])


def external_changes(edits: DataFrame, session: str, file: str, order: list[str], before: str, after: str) -> DataFrame:
    """edits with ``next_before`` and ``changed_outside``: whether the next edit of the file finds another text than this one left."""
    w = Window.partitionBy(session, file).orderBy(*order)
    following = F.lead(before).over(w)
    return edits.withColumn("next_before", following).withColumn("changed_outside", F.when(following.isNotNull(), following != F.col(after)))


def external_deltas(edits: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, file_path, call_id, added, removed): lines that something else changed after each applied edit, up to the file's next applied edit or its last state.

    ``edits`` (session_id, file_path, call_id, at, applied, pre, post: texts of the file before and after), ``states`` (session_id, file_path, text: at the session's
    end; null or no row where it can't be read). Edits that weren't applied don't close a window; one with an unknown text after it opens none, yet closes the one before.
    """
    own = Window.partitionBy("session_id", "file_path").orderBy("at", "call_id")
    seen = edits.where("applied").select("session_id", "file_path", "call_id", "post", F.lead("pre").over(own).alias("_pre"), F.lead("call_id").over(own).alias("_next"))
    both = seen.where("post is not null").join(states.withColumnRenamed("text", "_state"), ["session_id", "file_path"], "left")
    closed = both.withColumn("closed", F.when(F.col("_next").isNotNull(), F.col("_pre")).otherwise(F.col("_state"))).where("closed is not null")
    delta = closed.withColumn("d", line_delta(F.col("post"), F.col("closed")))
    return delta.select("session_id", "file_path", "call_id", "d.added", "d.removed")
