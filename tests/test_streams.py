"""Streams give what a batch gives, in whatever order and batches their rows arrive; retrieval against a plain scan."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import ci, context
from factloom.streaming import streams

FOUND = "session_id string, content string, score int, at long, inference_call_id long, answered int, message int, part int, bytes long"


def arriving(spark, rows, schema, folder, batches, seed):
    """The rows as a stream of files in a random order, one file a batch."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{seed}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{seed}")


def test_candidates_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(4)}", f"{rng.randrange(12):064d}", rng.randrange(1, 5), rng.randrange(3), i, i % 2, 0, 0, rng.randrange(100, 200)) for i in range(160)]
    rows += [("full", f"{i:064d}", 1, 0, i, 0, 0, 0, 900) for i in range(20)]
    want = {}
    for s, c, *own, size in rows:
        held = want.setdefault(s, {}).setdefault(c, [0, 0])
        want[s][c] = [max(held[0], size), max(held[1], own[0])]
    expected = {s: (len(m), sum(v[0] + 64 + 512 for v in m.values()), sum(v[1] for v in m.values()), False) for s, m in want.items()}
    expected["full"] = (0, None, None, True)
    for seed in (3, 4):
        stream = arriving(spark, rows, FOUND, tmp_path, 3, seed)
        got = context.settled_candidates(streams.drained(context.running_candidates(stream, 10_000), "t", "update")).collect()
        assert {r.session_id: (r.contents, r.state_bytes, r.scores, r.refused) for r in got} == expected


def test_late_attempts_correct_verdicts(spark, tmp_path):
    schema = "org_id string, provider string, repository_provider string, repository_host string, run_id string, run_attempt int, outcome_id int, result string"
    rng = random.Random(2)
    rows = [("o", "gh", "f", "h", f"r{i % 9}", i // 9, i, rng.choice(["passed", "failed", "cancelled"])) for i in range(90)]
    batch = streams.running_verdicts(spark.createDataFrame(rows, schema))
    want = sorted(map(tuple, batch.collect()))
    for seed in (5, 6):
        assert sorted(map(tuple, streams.drained(streams.running_verdicts(arriving(spark, rows, schema, tmp_path, 4, seed)), "t", "complete").collect())) == want
    assert {r[4] for r in want} <= {f"r{i}" for i in range(9)} and ci.RUN == batch.columns[:5]


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    schema = "k int, at timestamp"
    at = lambda minute: __import__("datetime").datetime(2026, 1, 1, minute // 60, minute % 60)
    for k, rows in enumerate([[(1, at(0)), (2, at(600))], [(3, at(605))], [(1, at(1)), (4, at(606))]]):  # 1 comes again, ten hours late
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
        __import__("time").sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    got = sorted(r.k for r in streams.drained(streams.deduplicated(stream, ["k"], "at", "10 minutes"), "t", "append").collect())
    assert got == [1, 2, 3, 4]


def test_ascii_bytes(spark):
    texts = ["plain", 'quote " and \\ and \n', "ünï", "\U0001f600 😀x", "", "ключ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ascii_bytes(F.to_json(F.struct("t"))).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: len(json.dumps({"t": t}, separators=(",", ":"))) for t in texts}


def test_retrieval_against_a_scan(spark):
    rng = random.Random(9)
    words = ["license", "token", "ünder", "filler", "the"]
    parts = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 3, 400])))
        parts.append((f"s{i % 3}", i, at_minute(i % 7), rng.choice(["input", "output"]), i % 2, 0, "user", rng.choice(["text", "text", "reasoning", "tool_call_response"]), text, None, i % 10 != 0))
    schema = "session_id string, inference_call_id long, observed_at timestamp, side string, message int, part int, role string, type string, text string, finish_reason string, finite boolean"
    items, summary = context.retrieve(spark.createDataFrame(parts, schema), ["license", "token", "the"], 4096, 4)
    got = {}
    for r in sorted(items.collect(), key=lambda r: (r.session_id, r["rank"])):
        got.setdefault(r.session_id, []).append((r.inference_call_id, r.side, r.bytes))
    counts = {r.session_id: r.asDict() for r in summary.collect()}
    for s in ("s0", "s1", "s2"):
        skipped = dict.fromkeys(["reasoning_part", "non_finite_number", "no_match", "repeated_content", "item_limit", "response_budget"], 0)
        best = {}
        for sid, call, at, side, message, part, role, kind, text, finish, finite in parts:
            if sid != s:
                continue
            score = len({"license", "token"} & set(text.split()))  # a stop word asks for nothing
            if kind == "reasoning" or not finite or not score:
                skipped["reasoning_part" if kind == "reasoning" else "non_finite_number" if not finite else "no_match"] += 1
                continue
            size = len(json.dumps({"score": score, "evidence": {"reference": {"inference_call_id": call, "side": side, "message_index": message, "part_index": part}, "observed_at": at.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "role": role, "finish_reason": finish, "part": {"type": kind, "content": text}}}, separators=(",", ":")))
            key, own = (role, finish, kind, text), ((-score, -at.timestamp(), call, side != "input", message, part), call, side, size)
            skipped["repeated_content"] += key in best
            best[key] = min(best.get(key, own), own)
        room, taken = 4096 - 2048, []
        for _, call, side, size in sorted(best.values()):
            if len(taken) == 4:
                skipped["item_limit"] += 1
            elif size + bool(taken) > room:
                skipped["response_budget"] += 1
            else:
                room -= size + bool(taken)
                taken.append((call, side, size))
        assert got.get(s, []) == taken and {k: counts[s][k] for k in skipped} == skipped and counts[s]["selected"] == len(taken)


def at_minute(m):
    import datetime

    return datetime.datetime(2026, 1, 1, 0, m)


def test_a_table_may_be_one_file_or_a_folder_and_may_be_empty(spark, tmp_path):
    rows = spark.range(6).withColumnRenamed("id", "k")
    rows.repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    rows.where("k < 0").coalesce(1).write.parquet(f"{tmp_path}/none.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/folder")
    next((tmp_path / "folder").glob("*.parquet")).rename(tmp_path / "one.parquet")
    got = {t: sorted(r.k for r in streams.drained(streams.source(spark, str(tmp_path), t), t, "append").collect()) for t in ("many", "one", "none")}
    assert got == {"many": list(range(6)), "one": list(range(6)), "none": []}
