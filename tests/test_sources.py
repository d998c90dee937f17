import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import ci
from factloom.operators.attachment import retry_links
from factloom.sources import rows_out, transcripts
from factloom.sources.shared import Workspace


def test_transcript_retry(spark):
    use = lambda i, path="a.py": {"type": "tool_use", "id": i, "name": "Edit", "input": {"file_path": path, "new_string": f"text {i}"}}
    entry = lambda kind, content: json.dumps({"sessionId": "s", "type": kind, "message": {"role": kind, "content": content}})
    lines = [
        entry("user", "please"), entry("assistant", [{"type": "text", "text": "ok"}, use("t1")]), entry("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "denied"}]),
        entry("user", "use the other name"), entry("assistant", [use("t2")]), entry("user", [{"type": "tool_result", "tool_use_id": "t2", "content": "done"}]), entry("assistant", [use("t3")]),
        entry("user", [{"type": "tool_result", "tool_use_id": "t3", "content": "done"}]), "{broken",
    ]
    found = transcripts.events(spark.createDataFrame(list(enumerate(lines)), "line long, entry string"))
    edits = transcripts.edits(found)
    assert {r.id: (r.accepted, r.text) for r in edits.collect()} == {"t1": (False, "text t1"), "t2": (True, "text t2"), "t3": (True, "text t3")}
    got = retry_links(edits.where("not accepted"), edits.where("accepted"), transcripts.said(found)).collect()
    assert [(r.rejected_id, r.accepted_id) for r in got] == [("t1", "t2")]


def test_runs_are_dealt_once_to_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ci, "TASK_ROWS", 10)
    rows = spark.range(300).selectExpr(
        "id AS outcome_id", "concat('org', id % 2) AS org_id", "'github' AS provider", "'forge' AS repository_provider", "concat('host', id % 3) AS repository_host", "cast(id % 60 AS string) AS run_id", "cast(id div 120 AS int) AS run_attempt", "'r' AS repository", "id % 60 AS commit_sha",
        "'w' AS workflow_name", "'1' AS workflow_id", "'' AS workflow_path", "if(id = 7, 'side', 'main') AS branch", "if(id % 2 = 0, 'passed', 'failed') AS result",
    )
    runs = ci.consistent_runs(rows)
    assert {(r.run_id, r.reason) for r in runs.where("reason is not null").collect()} == {("7", "branch_conflict")} and runs.count() == 60
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 30), REPARTITION_BY_NUM" in plan


def test_scratch_tables_have_no_mark_of_success(spark):
    space = Workspace(spark, "marks")
    saved = space.save(spark.createDataFrame([(1, "a"), (2, None)], "x long, y string"), "t")
    assert sorted(map(tuple, saved.collect())) == [(1, "a"), (2, None)] and space.save(saved.where("false"), "none").count() == 0
    assert not any(p.name.startswith("_") for p in Path(space.path("t").removeprefix("file:")).iterdir())


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("train", 0.5), ("eval", 1.0)], "split string, x double")
    assert rows_out.write_jsonl(df, str(tmp_path / "o"), "split") and sorted(p.name for p in (tmp_path / "o").iterdir() if p.is_dir()) == ["split=eval", "split=train"]
    assert not rows_out.write_jsonl(df.where("false"), str(tmp_path / "o")) and (tmp_path / "o" / "split=eval").exists()
    with pytest.raises(ValueError):
        rows_out.write_jsonl(df.withColumn("x", F.lit(float("nan"))), str(tmp_path / "p"))


def test_adapters(spark):
    pair = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen_text string, rejected_text string")
    assert rows_out.preference_consumer(pair).first().chosen[0].content == "c"
    task = spark.createDataFrame([("a/b", "f" * 40, "0" * 40, "d", "p", "passed"), ("a/b", "e" * 40, "0" * 40, "d", "p", "failed")], "repo string, commit_sha string, base_sha string, diff string, prompt string, verdict string")
    assert [r.instance_id for r in rows_out.task_consumer(task).collect()] == ["a__b__" + "f" * 12]
    assert rows_out.relation_faults(task, task.limit(1)).count() == 1 and len(task.select(rows_out.digest("repo").alias("d")).first().d) == 64


def test_completions_of_a_bundle_are_derived_once(spark):
    from factloom.plans import bundle_queries

    rows = bundle_queries.training_rows(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in rows.inputFiles())
