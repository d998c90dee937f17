import random

from pyspark.sql import functions as F

from factloom.operators import evidence, repositories
from factloom.schemas import FACTS, NATURAL_KEYS
from factloom.sources import reads


def test_identity_rules(spark):
    rows = [("p1", "acme/app", "gh", "h", "1"), ("p2", "acme/app", "gh", "h", "1"), ("p3", "acme/old", "gh", "h", "1"), ("p4", "x/y", "gh", "h", "2"), ("p4", "x/y", "gh", "h", "3"), ("p5", "solo/repo", None, None, None)]
    df = spark.createDataFrame(rows, "source_id string, repo string, repository_provider string, repository_host string, repository_id string").withColumn("captured_at", F.to_timestamp(F.lit("2026-01-01")))
    sources, names = repositories.identities(df, "2026-02-01")
    facts = spark.createDataFrame([("p1", "acme/app"), ("p4", "x/y"), ("p5", "solo/repo"), ("p9", "acme/old")], "source_id string, repo string")
    got = {r.source_id: (r.repository, r.reason) for r in repositories.qualified(facts, sources, names).collect()}
    assert got == {"p1": ("id:gh/h/1", None), "p4": (None, "repository_identity_conflict"), "p5": ("name:solo/repo", None), "p9": (None, "repository_identity_unresolved")}
    assert {r.identity: r.label for r in repositories.labels(df).collect()}["gh/h/1"] == "acme/app"


def _reached(parents, head):
    seen, front = set(), [head]
    while front:
        c = front.pop()
        if c in parents and c not in seen:
            seen.add(c)
            front += [p for p in parents[c] if p is not None]
    return seen


def test_reachability_against_a_walk(spark):
    rng = random.Random(7)
    parents = {i: sorted({rng.randrange(max(0, i - 6), i) for _ in range(rng.choice([1, 1, 1, 2, 3]))}, key=lambda _: rng.random()) if i % 23 else [None] for i in range(150)}
    parents[150] = [9999]  # a parent that nobody knows
    rows = [(c, p, k) for c, own in parents.items() for k, p in enumerate(own)]
    index = repositories.chains(spark.createDataFrame(rows, "commit_sha long, parent long, place int"))
    pairs = [(rng.randrange(152), rng.randrange(152)) for _ in range(400)]
    got = repositories.ancestors(index, spark.createDataFrame(pairs, "head long, commit_sha long")).collect()
    assert len(got) == len(pairs) and all(r.is_ancestor == (r.commit_sha in _reached(parents, r.head)) for r in got)
    merges = [(k, rng.randrange(150), rng.choice([None, 500, rng.randrange(150)])) for k in range(20)]
    found = repositories.membership(index, spark.createDataFrame([(c, c) for c in range(152)], "outcome_id long, commit_sha long"), spark.createDataFrame(merges, "merge_id long, head long, base long"))
    want = {(c, k) for k, h, b in merges for c in _reached(parents, h) - _reached(parents, b)}
    assert {tuple(r) for r in found.collect()} == want


def test_parts_by_reference(spark):
    part = lambda kind, content=None, name=None, arguments=None: {"type": kind, "content": content, "id": None, "name": name, "arguments": arguments, "result": None}
    base = dict.fromkeys(spark.createDataFrame([], FACTS["inference_calls"]).columns)
    row = base | {"inference_call_id": "c", "org_id": "o", "session_id": "s", "gateway_provider": "g", "observed_at": __import__("datetime").datetime(2026, 1, 1)}
    row["input_messages"] = [{"role": "user", "finish_reason": None, "parts": [part("text", "hi"), part("text", "ö")]}]
    row["output_messages"] = [{"role": "assistant", "finish_reason": "stop", "parts": [part("tool_call", name="Edit", arguments="{}")]}]
    calls = spark.createDataFrame([row], FACTS["inference_calls"])
    assert evidence.manifest(calls).first()[1:] == (2, 3, 2 + 2 + 7)
    ref = spark.createDataFrame([("c", "output", 0, 0), ("c", "input", 5, 0)], "inference_call_id string, side string, message int, part int")
    assert [r.text for r in evidence.referenced(calls, ref).collect()] == ["Edit {}"]
    assert calls.select(evidence.prompt_key("input_messages").alias("k")).first().k


def test_fact_tables_are_read_under_their_schema(spark, tmp_path):
    spark.createDataFrame([("p", "o", 1)], "push_id string, org_id string, other int").write.parquet(f"{tmp_path}/pushes")
    got = reads.fact_table(spark, f"file://{tmp_path}", "pushes")
    assert got.first().push_id == "p" and got.first().ref is None and "other" not in got.columns and all(spark.createDataFrame([], ddl).columns for ddl in FACTS.values())
    assert all(set(keys) <= set(spark.createDataFrame([], FACTS[name]).columns) for name, keys in NATURAL_KEYS.items())


def test_graph_tables_are_not_sent_through_the_driver(spark):
    parents = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 1, 0), (4, 2, 0), (4, 3, 1)], "commit_sha long, parent long, place int")
    pairs = spark.createDataFrame([(4, 3), (3, 2)], "head long, commit_sha long")
    found = repositories.ancestors(repositories.chains(parents), pairs)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.head, r.commit_sha, r.is_ancestor) for r in found.collect()} == {(4, 3, True), (3, 2, False)}
