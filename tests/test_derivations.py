import pytest

from factloom.plans import derivations, outcomes


def test_merge_retention(spark):
    text = "alpha beta gamma delta"
    edits = spark.createDataFrame([(1, text, "a.py", 9), (2, text, "b.py", 9), (3, "never there at all", "a.py", 9)], "applied_id int, applied string, path string, merge_id int")
    blobs = spark.createDataFrame([("h", "a.py", f"x {text} y"), ("m", "a.py", "x alpha beta y"), ("h", "b.py", text)], "commit_sha string, path string, file string")
    got = {r.applied_id: r for r in derivations.merge_retention(edits, blobs, spark.createDataFrame([(9, "h", "m")], "merge_id int, head_sha string, merge_commit_sha string")).collect()}
    assert got[1].at_head == 1.0 and 0.3 < got[1].retained < 0.7 and got[2].retained == 0.0 and (got[3].at_head, got[3].retained) == (0.0, None)


def test_lifecycle(spark):
    rows = [("g", "s1", True, True, "passed", True, 0.9, False, False), ("g", "s2", True, True, "failed", False, 0.05, True, True), ("g", "s3", True, False, None, False, None, False, False)]
    df = spark.createDataFrame(rows, "g string, session_id string, accepted boolean, attributed boolean, verdict string, merged boolean, kept double, rejected_after boolean, retried boolean")
    r = derivations.lifecycle(df, ["g"]).first()
    assert (r.accepted, r.attributed, r.resolved, r.passed, r.merged, r.deleted, r.missing) == (3, 2, 2, 1, 1, 1, 1)


def test_compare_models(spark):
    rates = spark.createDataFrame([("a", 1000, 900), ("b", 1000, 500), ("c", 10, 9)], "model string, n long, successes long")
    got = {(r.left, r.right): r for r in derivations.compare_models(rates, "model").collect()}
    assert got["a", "b"].significant and got["a", "c"].p is None and got["a", "b"].difference == pytest.approx(0.4)
    assert derivations.non_inferior(0.0, 0.01, 0.05) and not derivations.non_inferior(-0.04, 0.01, 0.05)


def test_model_outcomes_reads_each_kind_of_rows_once(spark):
    table = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    calls = table("call_id long, model string", (1, "m"), (2, "m"), (3, None), (4, "n"), (5, "m"))
    attributed = table(
        "call_id long, sha long, session_id long, similarity double, observed boolean",
        (1, 10, 7, 0.5, True), (1, 10, 7, 0.7, True), (1, 11, None, 0.9, False), (2, 11, None, None, False), (2, 12, 7, 0.3, None), (2, 13, 7, 0.6, True), (3, 10, 7, 0.1, True), (4, None, 7, None, True),
    )
    verdicts = table("sha long, verdict string", (10, "failed"), (11, "passed"), (12, "passed"), (13, "passed"))
    workflows = table("sha long, run_id string, workflow_name string, verdict string", (10, "r1", "w", "failed"), (10, "r1", "w", "failed"), (10, "r2", "w", "failed"), (10, None, "", "failed"), (10, "r3", "v", "passed"), (13, "r4", "w", "failed"))
    decisions = table(
        "decision_id long, session_id long, call_id long, agent_harness string, accepted boolean, explicit boolean",
        (1, 7, 1, "b", True, True), (1, 7, 1, "a", False, True), (2, 7, 2, "b", True, True), (3, 7, 2, "b", False, False), (4, 7, 3, "b", False, True), (5, 8, 5, None, False, True),
    )
    fates = table(
        "observation_id long, session_id long, call_id long, fate string, external_added int, external_removed int",
        (1, 7, 1, "partial", None, None), (1, 7, 1, "deleted", 0, 1), (2, 7, 2, "partial", 1, 0), (3, 8, 2, "partial", 1, 0), (4, 7, 3, "partial", 1, 0), (5, 8, 5, "unmodified", 0, 0),
    )
    found = outcomes.model_outcomes(calls, attributed, verdicts, workflows, decisions, fates, ["sha"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    rows = {r.model: r for r in found.collect()}
    m, n = rows["m"], rows["n"]
    assert set(rows) == {"m", "n"} and (n.completions, n.attributed, n.mean_similarity, n.ci_linked, n.failures, n.fates) == (1, 1, 0.0, 0, "", "")
    assert (m.completions, m.attributed, m.unobserved, m.ci_linked, m.ci_passed, m.explicit_accepts, m.explicit_rejects) == (3, 2, 1, 2, 1, 1, 2) and m.mean_similarity == pytest.approx(0.6)
    assert (m.failures, m.rejects_by_harness, m.fates, m.accepted_fates, m.external_fates) == ("(unnamed)=0,w=2", "a=1", "deleted=1,partial=1,unmodified=1", "deleted=1,partial=1", "deleted=1,partial=1")
    assert plan.count("SortMergeJoin [session_id") == 1  # fates meet decisions once, not for each list
