"""Repository identity: which lifetime a repository name stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Workspace

IDENTITY = ("repository_provider", "repository_host", "repository_id")


def identities(evidence: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(sources, names) of identity-bearing facts (source_id, repo, provider, host, id, captured_at) up to a moment.

    sources: (source_id, identity, conflict); copies of a source that disagree conflict. names: (repo, identity, claims): the identity that claims a name, null if several do.
    """
    seen = evidence.where((F.col("captured_at") <= F.lit(as_of).cast("timestamp")) & F.col("repository_id").isNotNull())
    seen = seen.select("source_id", "repo", F.concat_ws("/", *IDENTITY).alias("identity"))
    sources = seen.groupBy("source_id").agg(F.min("identity").alias("low"), F.max("identity").alias("high"))
    sources = sources.select("source_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("identity"), (F.col("low") != F.col("high")).alias("conflict"))
    names = seen.groupBy("repo").agg(F.min("identity").alias("low"), F.max("identity").alias("high"), F.count_distinct("identity").alias("claims"))
    return sources, names.select("repo", F.when(F.col("low") == F.col("high"), F.col("low")).alias("identity"), "claims")


def labels(evidence: DataFrame) -> DataFrame:
    """(identity, label): the lexicographically smallest name of an identity."""
    named = evidence.where("repository_id is not null").select(F.concat_ws("/", *IDENTITY).alias("identity"), "repo")
    return named.groupBy("identity").agg(F.min("repo").alias("label"))


def qualified(facts: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """facts (source_id, repo, ...) with ``repository`` (identity or name) and ``reason``.

    A source's own identity counts; a name without any claim is a legacy key; a claimed name without an own identity is unresolved; contradicting copies conflict.
    """
    joined = facts.join(sources.select("source_id", F.col("identity").alias("_own"), "conflict"), "source_id", "left").join(names.select("repo", F.col("claims")), "repo", "left")
    reason = F.when(F.col("conflict"), "repository_identity_conflict").when(F.col("_own").isNull() & F.col("claims").isNotNull(), "repository_identity_unresolved")
    key = F.when(reason.isNull(), F.coalesce(F.concat(F.lit("id:"), F.col("_own")), F.concat(F.lit("name:"), F.col("repo"))))
    return joined.select(*facts.columns, key.alias("repository"), reason.alias("reason"))


def by_sort(df: DataFrame) -> DataFrame:
    """df as a side that a join shuffles. A graph's tables are small in files and large as hash tables, so by the size of its files Spark would send one through the driver in each round."""
    return df.hint("merge")


def chains(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, exits): a reachability index of a commit graph (commit_sha, parent, place: 0 for the first parent; a root has one row without a parent).

    commits: (commit_sha, chain, position). First parents make a forest; each commit goes on with its child from which the longest line descends, so
    the forest falls into chains, and of a chain every commit reaches all with smaller positions. exits: (chain, position, to_chain, to_position), the edges that
    leave a chain. Depths, longest lines and chains come by pointer doubling: as many rounds as the depth has binary digits, each a join over the commits whose
    result is written. A parent that isn't a commit of the table ends its line.
    """
    space = Workspace(parents.sparkSession, "chains")
    edges = space.save(parents.select("commit_sha", "parent", "place").distinct(), "edges")
    known = edges.select(F.col("commit_sha").alias("parent")).distinct()
    first = edges.where("place = 0 and parent is not null").join(by_sort(known), "parent", "left_semi").select("commit_sha", F.col("parent").alias("up"))
    own = edges.select("commit_sha").distinct()
    now = space.save(own.join(by_sort(first), "commit_sha", "left").select("commit_sha", "up", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("below")), "up-0")
    k = 0
    while not now.where("up is not null").isEmpty():
        far = now.select(F.col("commit_sha").alias("_c"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        deeper = now.where("up is not null").groupBy(F.col("up").alias("_d")).agg((F.max("below") + (1 << k)).alias("_below"))
        met = now.join(by_sort(far), F.col("up") == F.col("_c"), "left").join(by_sort(deeper), F.col("commit_sha") == F.col("_d"), "left")
        step = met.select("commit_sha", F.col("_up").alias("up"), F.when(F.col("up").isNotNull(), F.col("_depth") + (1 << k)).otherwise(F.col("depth")).alias("depth"), F.greatest("below", F.coalesce("_below", F.lit(0))).alias("below"))
        now, k = space.save(step, f"up-{k + 1}"), k + 1
    lines = now.select("commit_sha", F.col("depth").alias("position"), "below")
    children = first.join(by_sort(lines), "commit_sha").groupBy("up").agg(F.max(F.struct("below", "commit_sha")).alias("m")).select(F.col("m.commit_sha").alias("commit_sha"), F.col("up").alias("top"))
    top, j = space.save(own.join(by_sort(children), "commit_sha", "left").select("commit_sha", F.coalesce("top", "commit_sha").alias("top")), "top-0"), 0
    while (1 << j) < (1 << k):
        far = top.select(F.col("commit_sha").alias("_c"), F.col("top").alias("_top"))
        top, j = space.save(top.join(by_sort(far), F.col("top") == F.col("_c")).select("commit_sha", F.col("_top").alias("top")), f"top-{j + 1}"), j + 1
    placed = space.save(top.join(by_sort(lines), "commit_sha").select("commit_sha", F.col("top").alias("chain"), "position"), "commits")
    to = placed.select(F.col("commit_sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("position").alias("to_position"))
    leaving = edges.where("parent is not null").join(by_sort(placed), "commit_sha").join(by_sort(to), "parent").where("chain <> to_chain or position < to_position")
    return placed, space.save(leaving.select("chain", "position", "to_chain", "to_position"), "exits")


def contours(index: tuple[DataFrame, DataFrame], heads: DataFrame) -> DataFrame:
    """(head, chain, position): the highest commit of each chain that a head reaches.

    A round takes every exit below what is reached, so there are as many rounds as a way changes chains, however long the chains are. Only what a
    round has raised goes on.
    """
    commits, exits = index
    space = Workspace(heads.sparkSession, "contours")
    reached = space.save(heads.select(F.col("head").alias("commit_sha")).distinct().join(by_sort(commits), "commit_sha").select(F.col("commit_sha").alias("head"), "chain", "position"), "0")
    front, k = reached, 0
    while not front.isEmpty():
        ways = exits.withColumnRenamed("position", "_from")
        met = front.join(by_sort(ways), "chain").where(F.col("_from") <= F.col("position")).groupBy("head", F.col("to_chain").alias("chain")).agg(F.max("to_position").alias("_p"))
        both = space.save(reached.join(by_sort(met), ["head", "chain"], "full_outer").select("head", "chain", F.greatest("position", "_p").alias("position"), (F.coalesce("_p", F.lit(-1)) > F.coalesce("position", F.lit(-1))).alias("raised")), f"{k + 1}")
        reached, front, k = both.drop("raised"), both.where("raised").drop("raised"), k + 1
    return reached


def ancestors(index: tuple[DataFrame, DataFrame], pairs: DataFrame, head: str = "head", commit: str = "commit_sha") -> DataFrame:
    """pairs with ``is_ancestor``: whether a head reaches a commit (itself included); false where the graph knows either not."""
    commits, _ = index
    reach = contours(index, pairs.select(F.col(head).alias("head"))).withColumnsRenamed({"head": "_head", "chain": "_at", "position": "_reach"})
    placed = pairs.join(by_sort(commits.withColumnsRenamed({"commit_sha": "_commit", "chain": "_chain", "position": "_position"})), F.col(commit) == F.col("_commit"), "left")
    met = placed.join(by_sort(reach), (F.col(head) == F.col("_head")) & (F.col("_chain") == F.col("_at")), "left")
    return met.select(*pairs.columns, F.coalesce(F.col("_position") <= F.col("_reach"), F.lit(False)).alias("is_ancestor"))


def membership(index: tuple[DataFrame, DataFrame], outcomes: DataFrame, merges: DataFrame) -> DataFrame:
    """(outcome_id, merge_id): outcomes (outcome_id, commit_sha) whose commit the merge's head reaches and its base doesn't; merges (merge_id, head, base).

    Commits meet the contour of a head on their chain, above where its base reaches, so an outcome meets no merge that it doesn't belong to.
    """
    commits, _ = index
    reach = contours(index, merges.select(F.explode(F.array("head", "base")).alias("head")).where("head is not null"))
    of_head = merges.join(by_sort(reach), "head").select("merge_id", "base", "chain", F.col("position").alias("_high"))
    of_base = reach.select(F.col("head").alias("base"), "chain", F.col("position").alias("_low"))
    spans = of_head.join(by_sort(of_base), ["base", "chain"], "left").select("merge_id", "chain", "_high", F.coalesce("_low", F.lit(-1)).alias("_low")).where("_high > _low")
    placed = outcomes.join(by_sort(commits), "commit_sha")
    return placed.join(by_sort(spans), "chain").where((F.col("position") > F.col("_low")) & (F.col("position") <= F.col("_high"))).select("outcome_id", "merge_id")
