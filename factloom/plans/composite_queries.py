"""Composite derivations: assembled completions, recoveries, identities, packed context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import split_score
from ..operators import attachment, attribution, ci, repositories, sequences
from ..sources.bindings import ctes, facts
from ..sources.shared import Workspace
from . import projections
from .fact_queries import _VERDICTS
from .registry import query

@query("d06_assembled_completions", _VERDICTS + f""", {ctes("decisions")[5:]},
r AS (SELECT commit_key, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS verdict FROM v GROUP BY commit_key),
d AS (SELECT call_id, count(*) AS decisions, count(*) FILTER (WHERE accepted) AS accepted, max(edit_retention_score) AS retention FROM decisions GROUP BY call_id)
SELECT o_orderkey AS call_id, o_custkey AS commit_key, verdict, coalesce(decisions, 0) AS decisions, coalesce(accepted, 0) AS accepted, retention,
  CASE WHEN verdict IS NULL AND decisions IS NULL THEN 'no_signal' WHEN verdict IS NULL THEN 'decision_only' WHEN decisions IS NULL THEN 'ci_only' ELSE 'complete' END AS evidence
FROM orders LEFT JOIN r ON o_custkey = r.commit_key LEFT JOIN d ON o_orderkey = d.call_id""")  # fmt: skip
def assembled_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attributed call with its commit's verdict and its decisions; calls without either stay."""
    key = F.col("o_custkey")
    named = lambda c, n: F.concat(F.lit(c), (key % n).cast("string"))
    calls = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("call_id"), key.alias("commit_key"), named("org", 2).alias("org_id"), named("repo", 5).alias("repository"), F.floor(key / 10).alias("commit_sha")
    )
    verdicts = ci.resolve(facts(spark, sf_dir, "ci_outcomes"))[0].select(*ci.COMMIT, "verdict")
    decided = facts(spark, sf_dir, "decisions").groupBy("call_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("a"), F.max("edit_retention_score").alias("retention"))
    both = calls.join(verdicts, ci.COMMIT, "left").join(decided, "call_id", "left")
    kind = F.when(F.col("verdict").isNull() & F.col("n").isNull(), "no_signal").when(F.col("verdict").isNull(), "decision_only").when(F.col("n").isNull(), "ci_only").otherwise("complete")
    return both.select("call_id", "commit_key", "verdict", F.coalesce("n", F.lit(0)).alias("decisions"), F.coalesce("a", F.lit(0)).alias("accepted"), "retention", kind.alias("evidence"))


_PAIRS = ctes("ci_outcomes", "commit_parents").replace("WITH", "WITH RECURSIVE") + """,
s AS (SELECT commit_key AS commit_sha, result, lag(result) OVER w AS before, lag(commit_key) OVER w AS red_commit FROM ci_outcomes WHERE result IN ('passed', 'failed') WINDOW w AS (PARTITION BY org_id, repository, branch, provider, workflow_id ORDER BY captured_at, outcome_id)),
p AS (SELECT red_commit, commit_sha AS green_commit FROM s WHERE result = 'passed' AND before = 'failed'),
a AS (SELECT DISTINCT green_commit AS head, green_commit AS c FROM p UNION SELECT a.head, q.parent FROM a JOIN commit_parents q ON q.commit_sha = a.c WHERE q.parent IS NOT NULL),
f AS (SELECT red_commit, green_commit, EXISTS (SELECT 1 FROM a WHERE head = green_commit AND c = red_commit) AS is_ancestor FROM p)"""


def _recovery_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a failing and a passing commit of one lineage, and whether the passing one descends from the failing one."""
    outcomes = facts(spark, sf_dir, "ci_outcomes").withColumn("commit_sha", F.col("commit_key"))
    pairs = ci.red_to_green(outcomes, ["org_id", "repository", "branch", "provider", "workflow_id"]).select("red_commit", "green_commit")
    return repositories.ancestors(repositories.chains(facts(spark, sf_dir, "commit_parents")), pairs, "green_commit", "red_commit")


@query("d09_recoveries_by_ancestry", _PAIRS + " SELECT CASE WHEN red_commit = green_commit THEN 'same_commit' WHEN NOT is_ancestor THEN 'not_ancestor' ELSE 'recovered' END AS outcome, count(*) AS n, min(green_commit) AS first_green FROM f GROUP BY 1")
def recoveries_by_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("red_commit") == F.col("green_commit"), "same_commit").when(~F.col("is_ancestor"), "not_ancestor").otherwise("recovered")
    return _recovery_pairs(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("green_commit").alias("first_green"))


@query("d09_recovery_rows", _PAIRS + """,
z AS (SELECT c_custkey, floor(abs(c_acctbal))::bigint % 400 AS changed, (('0x' || substr(sha256(c_custkey::varchar), 1, 16))::ubigint)::double / 18446744073709551616::double < 0.2::double AS e FROM customer)
SELECT red_commit, green_commit, g.changed, CASE WHEN r.e OR g.e THEN 'eval' ELSE 'train' END AS split FROM f JOIN z g ON g.c_custkey = green_commit JOIN z r ON r.c_custkey = red_commit WHERE g.changed <= 200 AND is_ancestor AND red_commit <> green_commit""")  # fmt: skip
def recovery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _recovery_pairs(spark, sf_dir).where("is_ancestor and red_commit <> green_commit").drop("is_ancestor")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    changed = F.pmod(F.floor(F.abs("c_acctbal")).cast("long"), F.lit(400))
    sizes = customer.select(F.col("c_custkey").alias("green_commit"), changed.alias("changed"))
    evaluated = customer.select(F.col("c_custkey").alias("commit_sha"), (split_score(F.col("c_custkey").cast("string")) < 0.2).alias("is_eval"))
    return projections.recovery_rows(pairs, sizes, evaluated)


@query("d25_repository_identity", """
WITH e AS (SELECT l_orderkey AS source_id, 'repo' || (l_partkey % 300) AS repo, CASE WHEN l_partkey % 300 < 200 THEN 'gh/h/' || (l_partkey % 150) END AS identity FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT repo, count(DISTINCT identity) AS claims FROM e WHERE identity IS NOT NULL GROUP BY repo), s AS (SELECT source_id, min(identity) AS lo, max(identity) AS hi FROM e WHERE identity IS NOT NULL GROUP BY source_id),
f AS (SELECT o_orderkey AS source_id, 'repo' || (o_custkey % 300) AS repo FROM orders)
SELECT f.source_id, f.repo, CASE WHEN lo <> hi THEN NULL WHEN lo IS NULL AND claims IS NOT NULL THEN NULL ELSE coalesce('id:' || lo, 'name:' || f.repo) END AS repository,
  CASE WHEN lo <> hi THEN 'repository_identity_conflict' WHEN lo IS NULL AND claims IS NOT NULL THEN 'repository_identity_unresolved' END AS reason FROM f LEFT JOIN s USING (source_id) LEFT JOIN n ON n.repo = f.repo""")  # fmt: skip
def repository_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1")
    known = F.col("l_partkey") % 300 < 200
    evidence = lines.select(
        F.col("l_orderkey").alias("source_id"), F.concat(F.lit("repo"), F.col("l_partkey") % 300).alias("repo"), F.when(known, "gh").alias("repository_provider"), F.when(known, "h").alias("repository_host"),
        F.when(known, (F.col("l_partkey") % 150).cast("string")).alias("repository_id"), F.col("l_shipdate").cast("timestamp").alias("captured_at"),
    )
    sources, names = repositories.identities(evidence, "2100-01-01")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("source_id"), F.concat(F.lit("repo"), F.col("o_custkey") % 300).alias("repo"))
    return repositories.qualified(rows, sources, names)


@query("w14_false_discovery", ctes("calls") + """,
r AS (SELECT session_id, count(*)::double AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::double AS s FROM calls GROUP BY session_id),
p AS (SELECT session_id, 1 / (1 + abs(s / n - 0.5::double) * sqrt(n) * 4) AS p FROM r), k AS (SELECT *, row_number() OVER (ORDER BY p, session_id)::integer AS rank, count(*) OVER () AS m FROM p),
l AS (SELECT max(rank) FILTER (WHERE p <= rank / m * 0.3::double) AS last FROM k)
SELECT session_id, p, rank, rank <= coalesce(last, 0) AS rejected FROM k, l""")  # fmt: skip
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = facts(spark, sf_dir, "calls").groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("s"))
    tests = rates.select("session_id", (1 / (1 + F.abs(F.col("s") / F.col("n") - 0.5) * F.sqrt("n") * 4)).alias("p"))
    return sequences.benjamini_hochberg(tests, "p", "session_id", 0.3)


@query("l04_newest_commits", """
SELECT l_suppkey AS push_id, l_orderkey * 10 + l_linenumber AS commit_sha FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) <= 20""")  # fmt: skip
def newest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ranges = lines.select(F.col("l_suppkey").alias("push_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("commit_sha"), F.col("l_shipdate").alias("committed_at"))
    return attachment.newest_commits(ranges).select("push_id", "commit_sha")


@query("l06_capped_examples", "SELECT l_shipmode AS stratum, l_n AS sessions FROM (SELECT l_returnflag AS l_shipmode, list_sort(list(DISTINCT l_suppkey))[1:5]::varchar AS l_n FROM lineitem GROUP BY l_returnflag)")
def capped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five smallest session ids of a stratum: ids are made distinct and ranked before they are gathered."""
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("stratum"), "l_suppkey").distinct()
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("stratum").orderBy("l_suppkey"))).where("n <= 5")
    lists = ranked.groupBy("stratum").agg(F.array_sort(F.collect_list("l_suppkey")).alias("ids"))
    return lists.select("stratum", F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("]")).alias("sessions"))


@query("l02_packed_context")
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parts of each session that fit a byte budget, taken greedily by rank; a part that doesn't fit is skipped."""
    from ..functions.text import tokens

    parts = facts(spark, sf_dir, "parts").select("doc_id", "session_id", F.octet_length("text").cast("long").alias("bytes"), tokens(F.col("text")).alias("tokens"))
    found = attribution.keyword_overlap(parts, ["the", "of", "und", "de", "license"])
    return pack_parts(found)


def pack_parts(found: DataFrame, items: int = 8, room: int = 8192) -> DataFrame:
    """(session_id, rank, doc_id, bytes) of the packed parts of ``found`` (session_id, doc_id, matched, bytes); ranks count every part found."""
    place = F.struct((-F.col("matched")).alias("matched"), "doc_id", "bytes", F.monotonically_increasing_id().alias("row"))
    found = Workspace(found.sparkSession, "parts").save(found.select("session_id", "doc_id", "bytes", place.alias("place")), "found")
    taken = attribution.packed(found, "session_id", "place", "bytes", items, room)
    places = taken.groupBy("session_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    before = F.array(*(F.count_if(F.col("place") <= F.get("places", F.lit(i))) for i in range(items)))
    ranks = found.join(places, "session_id").groupBy("session_id", "places").agg(before.alias("ranks")).select("session_id", F.explode(F.arrays_zip("places", F.slice("ranks", 1, F.size("places")).alias("ranks"))).alias("m"))
    return ranks.select("session_id", F.col("m.ranks").cast("int").alias("rank"), F.col("m.places.doc_id").alias("doc_id"), F.col("m.places.bytes").alias("bytes"))
