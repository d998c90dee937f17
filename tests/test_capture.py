import json

from pyspark.sql import functions as F

from factloom.functions.text import aliases, scoring_text
from factloom.sources import capture
from factloom.streaming.streams import append_edges

from .conftest import rows_of


def payloads(spark, *values):
    rows = [(f"b{i}", v if isinstance(v, str) else json.dumps(v), "2026-01-01T00:00:00") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "batch_id string, payload string, at string").withColumn("captured_at", F.to_timestamp("at")).withColumn("observed_at", F.to_timestamp("at"))


CALL = {
    "model": "m", "litellm_call_id": "c1", "messages": [{"role": "user", "content": "hi"}], "metadata": {"user_id": "ada_session_01234567-89ab-cdef-0123-456789abcdef"}, "response_time_ms": 50.4,
    "response": {"id": "r1", "choices": [{"finish_reason": "stop", "message": {"role": "assistant", "content": "sure", "tool_calls": [{"id": "t1", "type": "function", "function": {"name": "Edit", "arguments": "{\"a\": 1}"}}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}},
    "usage": {"prompt_tokens": 10, "completion_tokens": 20},
}


def test_gateway_call(spark):
    df = capture.gateway_calls(payloads(spark, CALL, {**CALL, "metadata": {}}, "not json", {"response": {"choices": [{"text": "plain"}]}, "metadata": {"session_id": "s2"}, "response_time": 1.5}))
    got = {r.session_id: r for r in df.withColumn("said", scoring_text(F.col("output_messages"))).withColumn("ids", aliases(F.col("output_messages"), F.col("model_call_id"))).collect()}
    a = got["01234567-89ab-cdef-0123-456789abcdef"]
    assert (a.user_id, a.model, a.input_tokens, a.output_tokens, a.duration_ms, a.model_call_id) == ("ada", "m", 10, 20, 50, "c1")
    assert a.said == "sure" and a.ids == ["c1", "t1"] and a.input_messages[0].parts[0].content == "hi"
    assert got["s2"].said == "plain" and got["s2"].duration_ms == 1500 and got["s2"].ids == [] and len(got) == 2


def record(event, nanos="1700000000000000000", **attributes):
    kind = lambda v: {"boolValue": v} if isinstance(v, bool) else {"stringValue": v}
    return {"timeUnixNano": nanos, "body": {"stringValue": event}, "attributes": [{"key": k.replace("__", "."), "value": kind(v)} for k, v in attributes.items()]}


def otlp(*records):
    return {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "claude-code"}}]}, "scopeLogs": [{"scope": {}, "logRecords": list(records)}]}]}


def test_otlp_decisions_join_paths_in_their_batch(spark):
    patch = "*** Begin Patch\n*** Update File: x.py\n*** Add File: y.py"
    raw = payloads(
        spark,
        otlp(
            record("claude_code.tool_decision", session__id="s", tool_use_id="t1", tool_name="Edit", decision="accept", source="user"), record("claude_code.tool_result", session__id="s", tool_use_id="t1", file_path="old.py"),
            record("claude_code.tool_result", session__id="s", tool_use_id="t1", file_path="new.py"), record("x.tool_decision", session__id="s", tool_use_id="t2", tool_name="Bash", decision="accept"),
            record("x.tool_decision", session__id="s", tool_use_id="t3", tool_name="Write", decision="maybe"), record("x.tool_decision", "0", session__id="s", tool_use_id="t4", tool_name="Write", decision="reject"),
        ),
        otlp(
            record("x.tool_decision", session__id="s", tool_use_id="t1", tool_name="Write", decision="reject", explicit=False),
            record("codex.tool_decision", session__id="s", call_id="p", tool_name="apply_patch", decision="approved"), record("codex.tool_result", session__id="s", call_id="p", arguments=patch), record("other"),
        ),
        "broken",
    )
    got = sorted((r.call_id, r.file_path, r.accepted, r.explicit, r.agent_harness) for r in capture.otlp_decisions(capture.otlp_records(raw)).collect())
    assert got == [("p", "x.py", True, False, "claude-code"), ("p", "y.py", True, False, "claude-code"), ("t1", "", False, False, "claude-code"), ("t1", "new.py", True, True, "claude-code")]
    assert rows_of(capture.otlp_partition(raw)) == [{"translated": 9, "untranslated": 1, "malformed": 1}]


def test_otlp_attributes_last_value_counts_and_payloads_are_parsed_once(spark):
    one = record("x.tool_result", session__id="own", k="1")
    one["attributes"] += [{"key": "k", "value": {"stringValue": "2"}}, {"key": "k", "value": {}}, {"key": None, "value": {"stringValue": "lost"}}, {"key": "n", "value": {"intValue": "7"}}]
    named = {"timeUnixNano": "0", "attributes": [{"key": "event.name", "value": {"stringValue": e}} for e in ("first", "x.edit_observation")]}
    raw = payloads(spark, {"resourceLogs": [{"resource": {"attributes": [{"key": "session.id", "value": {"stringValue": "res"}}, {"key": "event.name", "value": {"stringValue": "res"}}]}, "scopeLogs": [{"logRecords": [one, named, {}]}, {}]}, {}]}, {"resourceLogs": []}, "broken")
    records = capture.otlp_records(raw)
    got = [(r.position, r.event, r.attributes, r.occurred_at is None) for r in records.orderBy("position").collect()]
    assert got[0] == (0, "x.tool_result", {"session.id": "own", "event.name": "res", "k": None, "n": "7"}, False)
    assert got[1:] == [(1, "x.edit_observation", {"session.id": "res", "event.name": "x.edit_observation"}, True), (2, None, {"session.id": "res", "event.name": "res"}, True)]
    assert rows_of(capture.otlp_partition(raw)) == [{"translated": 1, "untranslated": 2, "malformed": 1}]
    for df in (capture.edit_observations(records), capture.retry_linkages(records), capture.otlp_decisions(records), capture.otlp_partition(raw)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("map_from_entries(lambda") <= 1


def test_edits_of_any_length_are_kept(spark):
    own = {"session__id": "s", "agent": "codex", "tool_use_id": "t", "file_path": "a.py"}
    sizes = [(0, 5), ((1 << 20) + 1, 0), (3, (1 << 20) + 2)]
    pairs = [record("x.edit_observation", applied_text="a" * n, observed_file_text="ä" * m, **own) for n, m in sizes]
    records = capture.otlp_records(payloads(spark, otlp(*pairs, record("x.edit_observation", applied_text="a", **own), record("x.rejected_edit", proposed="b" * (1 << 21), **own))))
    got = capture.edit_observations(records).select(F.char_length("applied_text").alias("n"), F.char_length("observed_file_text").alias("m"))
    assert sorted((r.n, r.m) for r in got.collect()) == sorted(sizes)
    assert [r.n for r in capture.rejected_edits(records).select(F.char_length("proposed").alias("n")).collect()] == [1 << 21]


def test_gateway_payloads_are_parsed_once_for_a_manifest(spark):
    from factloom.operators import evidence

    said = {"role": "user", "content": "hi", "tool_calls": [{"id": "t", "function": {"name": "Edit", "arguments": "{}"}}]}
    raw = payloads(spark, {"litellm_call_id": "c", "messages": [said, {"role": "user"}], "metadata": {"session_id": "s"}, "response": {"output_text": "yes"}}, {"litellm_call_id": "d"}, "x").withColumn("observed_at", F.lit(0))
    calls = capture.gateway_calls(raw).withColumn("inference_call_id", F.col("model_call_id"))
    got = evidence.parts(calls)
    assert sorted((r.side, r.message, r.part, r.role, r.type, r.text) for r in got.collect()) == [("input", 0, 0, "user", "text", "hi"), ("input", 0, 1, "user", "tool_call", "Edit {}"), ("output", 0, 0, "assistant", "text", "yes")]
    assert evidence.manifest(calls)._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_webhooks(spark):
    sha = "A" * 40
    run = {"action": "completed", "workflow_run": {"id": 7, "name": "ci", "path": ".github/ci.yml", "workflow_id": 3, "head_branch": "main", "head_sha": sha, "run_attempt": 2, "conclusion": "success", "pull_requests": [{"number": 5}]}, "repository": {"id": 9, "full_name": "Acme/App"}}
    push = {"ref": "refs/heads/main", "before": sha, "after": "b" * 40, "repository": {"full_name": "Acme/App", "clone_url": "u"}}
    r = capture.workflow_outcomes(payloads(spark, run, {**run, "action": "requested"}, "x")).collect()
    assert [(x.run_id, x.repo, x.commit_sha, x.result, x.pr_number, x.run_attempt) for x in r] == [("7", "acme/app", "a" * 40, "passed", 5, 2)]
    p = capture.push_facts(payloads(spark, push, {**push, "after": "short"})).collect()
    assert [(x.repo, x.forced) for x in p] == [("acme/app", False)]


def test_notes_and_diffs(spark):
    one = json.dumps({"version": 1, "sessions": [{"tool": "t", "session_id": "s1"}, {"tool": "t", "session_id": ""}]})
    notes = spark.createDataFrame([("c", one + "\n" + json.dumps({"version": 1, "sessions": [{"tool": "t", "session_id": "s1"}, {"tool": "u", "session_id": "s1"}]}) + "\n{")], "commit_sha string, note string")
    assert sorted((r.tool, r.session_id) for r in capture.noted_sessions(notes).collect()) == [("t", "s1"), ("u", "s1")]
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@\n-x\n+y\n+++z\n q\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\ndiff --git a/bin b/bin\nBinary files differ"
    got = [(r.position, r.path, r.added) for r in capture.diff_sections(spark.createDataFrame([("c", diff)], "commit_sha string, diff string")).orderBy("position").collect()]
    assert got == [(0, "a.py", "y\n++z"), (1, "gone", ""), (2, "bin", "")]


def test_edges_are_appended_once(spark, tmp_path):
    write = append_edges(str(tmp_path / "edges"), ["commit_sha", "session_id"])
    a = spark.createDataFrame([("c", "s", 1), ("c", "s", 2)], "commit_sha string, session_id string, n int")
    write(a, 0)
    write(a.unionByName(spark.createDataFrame([("d", "s", 3)], a.schema)), 1)
    assert sorted(r.commit_sha for r in spark.read.parquet(str(tmp_path / "edges")).collect()) == ["c", "d"]


def test_diff_sections_are_checked(spark):
    good = 'diff --git "a/f\\303\\244 \\"x\\t.py" "b/f\\303\\244 \\"x\\t.py"\n--- "a/f\\303\\244 \\"x\\t.py"\n+++ "b/f\\303\\244 \\"x\\t.py"\n@@ -1,2 +1,3 @@ def f\n a\n-b\n+c\n+d\n\\ No newline at end of file'
    short = "diff --git a/s b/s\n--- a/s\n+++ b/s\n@@ -1 +1,2 @@\n-x\n+y"
    long = "diff --git a/l b/l\n--- a/l\n+++ b/l\n@@ -1 +1 @@\n-x\n+y\n+z"
    header = "diff --git a/h b/h\n--- a/h\n+++ b/h\n@@ nonsense @@\n+y"
    merged = "diff --cc m.py\n@@@ -1 -1 +1 @@@\n++x"
    df = spark.createDataFrame([("c", "\n".join([good, short, long, header, merged]))], "commit_sha string, diff string")
    got = [(r.path, r.added, r.reason) for r in capture.diff_sections(df).orderBy("position").collect()]
    assert got[0] == ('fä "x\t.py', "c\nd", None)
    assert [(p, r) for p, _, r in got[1:]] == [("s", "malformed_diff_section"), ("l", "malformed_diff_section"), ("h", "malformed_diff_section"), ("", "unsupported_diff_section")]
