import math

import numpy as np
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import stats
from factloom.functions import text as T
from factloom.operators import attachment, attribution, ci, sequences, visibility

from .conftest import rows_of


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, tokens", [("def add(a, b): return a + b", {"def", "add", "a", "b", "return"}), ("Foo() + BAR;", {"foo", "bar"}), ("", set())])
def test_tokens(spark, text, tokens):
    assert set(one(spark, T.tokens(F.col("t")), t=text)) == tokens


def test_jaccard_of_empty_texts_is_zero(spark):
    assert one(spark, T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), a="", b="") == 0.0


def test_survival_of_a_changed_capital_is_half(spark):
    df = spark.createDataFrame([(1, "'hello'", "'Hello'"), (2, "abc", "abc"), (3, "abc", "abd")], "id int, left string, right string")
    assert {r.id: r.survival for r in T.survival(df).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("applied, file, score", [("abc", "xxabcxx", 1.0), ("abc", "xxxxxxx", 0.0), ("", "anything", 1.0), ("text", "", 0.0), ("long text", "abc", 0.0)])
def test_short_containment(spark, applied, file, score):
    assert one(spark, T.short_containment(F.col("a"), F.col("f")), a=applied, f=file) == score


def test_a_snippet_is_contained_in_a_large_file(spark):
    a = spark.createDataFrame([(1, "return value")], "applied_id int, applied string")
    f = spark.createDataFrame([(7, "x = 1\n" * 50 + "return value\n" + "y = 2\n" * 50)], "file_id int, file string")
    assert T.containment(a, f).first().containment > 0.99


def test_pairs_of_a_file_are_made_in_one_task_and_tasks_grow_with_the_pairs(spark, monkeypatch):
    from factloom.functions import text

    a = spark.createDataFrame([(i, w * (i + 1)) for i, w in enumerate(["return ", "value", "abcd", "x", "none of it"])], "applied_id int, applied string")
    f = spark.createDataFrame([(i, f"value {i} return value abcd" * (i % 3)) for i in range(40)], "file_id int, file string")
    monkeypatch.setattr(text, "TASK_PAIRS", 10)
    got = T.containment(a, f)
    rows, plan = sorted(map(str, got.collect())), got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_id" in plan and ", 13), REPARTITION_BY_NUM" in plan and "hashpartitioning(gram" not in plan
    monkeypatch.setattr(text, "BROADCAST_GRAMS", -1)
    assert rows == sorted(map(str, T.containment(a, f).collect())) and rows


def test_four_grams_handle_astral_characters(spark):
    assert sorted(one(spark, T.four_grams(F.col("t")), t="ab😀cd")) == sorted(["ab😀c", "b😀cd"])


@pytest.mark.parametrize(
    "path, code",
    [
        ("src/a.py", True), ("a/b.tsx", True), ("README.md", False), ("node_modules/a.js", True), ("x.min.js", False), ("main.tf", True), ("x.bash", True), ("App.swift", False), ("a.hpp", False),
        ("src/clock.py", True), ("src/block/a.py", True), ("package-lock.json", False), ("uv.lock", False), ("src/uv.lock.py", False), ("vendor/a.go", True), ("A.PY", False), ("py", False),
    ],
)
def test_is_code_file(spark, path, code):
    assert one(spark, T.is_code_file(F.col("p")), p=path) is code


M = T.REDACTION_MARKER
KEY = "abcdefghijklmnop1234"


@pytest.mark.parametrize(
    "text, clean, reason",
    [
        (f"Authorization: Bearer {KEY}==", f"Authorization: Bearer {M}", "authorization_header"), (f"say bearer {KEY} now", f"say bearer {M} now", "bearer_token"), ("Bearer shortone", "Bearer shortone", None),
        (f"use sk-{KEY}.", f"use {M}.", "provider_key"), (f"task-sk-{KEY}", f"task-sk-{KEY}", None), ("token = 'abcdefgh12345678'", "token = 'abcdefgh12345678'", None),
        (f"OPENAI_API_KEY={KEY}", f"OPENAI_API_KEY={M}", "api_key_assignment"), ("api_key = 'abcdefgh1'", f"api_key = '{M}'", "api_key_assignment"), ("api_key = 'abc'", "api_key = 'abc'", None), ("--api-key: shortvalue", "--api-key: shortvalue", None),
        ('{"api_key": "a b"}', f'{{"api_key": "{M}"}}', "structured_credential"), ('{"x-api-key": "q\\\"z"}', f'{{"x-api-key": "{M}"}}', "structured_credential"), ("{'my_api_key': 'v'}", f"{{'my_api_key': '{M}'}}", "structured_credential"), ('{"key": "value"}', '{"key": "value"}', None),
        (f'{{"api_key": "{M}"}}', f'{{"api_key": "{M}"}}', None), ('{"authorization": "cut off', f'{{"authorization": "{M}', "structured_credential"),
    ],
)
def test_redaction(spark, text, clean, reason):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.redact(F.col("t")).alias("x"), *(n.alias(r) for r, n in T.redaction_counts(F.col("t")).items())).first()
    assert got.x == clean and {r for r, _, _ in T.REDACTIONS if got[r]} == ({reason} if reason else set())


def test_known_credentials_reach_whole_lines(spark):
    df = spark.createDataFrame([([("api_key", "hunter2"), ("Authorization", f"Bearer {KEY}"), ("name", "x"), ("x-api-key", M)], f"a\nhunter2\nmy hunter2\n{KEY}")], "e array<struct<key:string,value:string>>, t string")
    known = T.known_credentials(F.col("e"))
    got = df.select(known.alias("k"), T.propagate(F.col("t"), known).alias("t")).first()
    assert got.k == [KEY, "hunter2"] and got.t == f"a\n{M}\nmy hunter2\n{M}"


def test_patch_paths_and_changed_lines(spark):
    patch = "*** Begin Patch\n*** Update File: a.py\n@@\n-x\n+y\n*** Add File: b.py\n+z\n*** Update File: a.py"
    assert one(spark, T.patch_paths(F.col("p")), p=patch) == ["a.py", "b.py"]
    diff = "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\n+y\n z\ndiff --git a/b b/b\n--- a/b\n+++ b/b\n@@ -0,0 +1 @@\n+q"
    assert one(spark, T.changed_lines(F.col("p")), p=diff) == 3


def test_wilson(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "s long, n long")
    low, high = stats.wilson(F.col("s"), F.col("n"))
    got = df.select(low.alias("l"), high.alias("h")).collect()
    assert got[0].l == pytest.approx(0.4901624715366419, rel=1e-9) and got[0].h == pytest.approx(0.9433178485456246, rel=1e-9) and tuple(got[1]) == (0.0, 0.0)


def test_closed_forms():
    assert stats.corpus_floor(0.1) == 97
    assert stats.required_per_arm(0.5, 0.1) == 388 and stats.required_per_arm(1.0, 0.1) is None
    assert stats.minimum_effect(0.5, 388) == pytest.approx(0.1, abs=0.002)
    assert stats.sequential_bound(1.0) == pytest.approx(1.959964, abs=1e-5)
    assert stats.expected_regret(1.0, 0.0) == 1.0 and stats.expected_regret(0.0, 1.0) == pytest.approx(0.398942, abs=1e-5)


def outcomes(spark, rows, **same):
    """(run_id, run_attempt, commit_sha, workflow_name, branch, result, captured_at) rows of one repository, or with other columns."""
    full = [(f"o{i}", *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "outcome_id string, run_id string, run_attempt long, commit_sha string, workflow_name string, branch string, result string, captured_at long")
    common = {"org_id": "o", "provider": "ci", "repository_provider": "f", "repository_host": "h", "repository": "r", "workflow_id": None, "workflow_path": None} | same
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v).cast("string") for k, v in common.items()})


def test_attempts_decide_and_not_arrival(spark):
    got, declined = ci.resolve(outcomes(spark, [("r", 1, "c", "w", "m", "failed", 20), ("r", 2, "c", "w", "m", "passed", 0)]))
    assert declined.count() == 0
    assert rows_of(got) == [{"org_id": "o", "repository": "r", "commit_sha": "c", "verdict": "passed", "reliability": 0.0, "workflows": 1, "flakes": 1, "reason": None}]


def test_contradicting_attempts_are_declined(spark):
    got, declined = ci.resolve(outcomes(spark, [("r", 1, "c", "w", "m", "failed", 0), ("r", 1, "c", "w", "m", "passed", 1), ("s", None, "c", "w", "m", "passed", 1)]))
    assert [r.reason for r in declined.collect()] == ["attempt_conflict"] and got.first().verdict == "passed"


def test_one_run_number_in_two_repositories(spark):
    second = F.col("outcome_id") == "o1"
    rows = [("7", 1, "c", "w", "main", "failed", 0), ("7", 1, "c", "w", "dev", "passed", 1)]
    host, repository = F.when(second, "h2").otherwise("h1"), F.when(second, "r2").otherwise("r1")
    got, declined = ci.resolve(outcomes(spark, rows, repository_host=host, repository=repository))
    assert declined.count() == 0 and {r.repository: r.verdict for r in got.collect()} == {"r1": "failed", "r2": "passed"}
    got, declined = ci.resolve(outcomes(spark, rows, repository_provider=None, repository_host=None))
    assert [r.reason for r in declined.collect()] == ["branch_conflict"] and got.count() == 0


@pytest.mark.parametrize("column", ["workflow_id", "workflow_name", "workflow_path"])
def test_each_workflow_field_is_checked_alone(spark, column):
    two, blank = (F.when(F.col("outcome_id") == "o1", x).otherwise("a") for x in ("b", ""))
    rows = [("7", 1, "c", "w", "m", "failed", 0), ("7", 2, "c", "w", "m", "passed", 1)]
    assert [r.reason for r in ci.consistent_runs(outcomes(spark, rows).withColumn(column, two)).collect()] == ["workflow_conflict"]
    assert [r.reason for r in ci.consistent_runs(outcomes(spark, rows).withColumn(column, blank)).collect()] == [None]


def test_one_pair_of_the_last_red_and_the_first_green(spark):
    rows = [(str(i), None, f"c{i}", "w", "m", r, i) for i, r in enumerate(["failed", "failed", "passed", "passed"], 1)]
    df = outcomes(spark, rows).withColumn("captured_at", F.timestamp_seconds("captured_at"))
    assert [(r.red_commit, r.green_commit) for r in ci.red_to_green(df, ["workflow_name"]).collect()] == [("c2", "c3")]


@pytest.mark.parametrize("intervals, want", [([(0, 10), (40, 45)], (45, 15, 30)), ([(0, 20), (5, 15), (30, 40)], (40, 40, 10))])
def test_busy_time(spark, intervals, want):
    df = spark.createDataFrame([("s", a, b) for a, b in intervals], "s string, a long, b long")
    got = sequences.busy_time(df, "s", "a", "b").first()
    assert (got.elapsed, got.total, got.between) == want


def test_tail_sums_need_every_later_row(spark):
    df = spark.createDataFrame([("k", 1, 1, 0), ("k", 2, 2, 1), ("k", 3, None, None), ("k", 4, 3, 0)], "k string, t int, a long, r long")
    got = {r.t: (r.tail_a, r.tail_r) for r in sequences.tail_sums(df, ["k"], ["t"], ["a", "r"]).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (3, 0)}


def test_quantile_buckets_put_the_remainder_last(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "v int, k int")
    assert [r.bucket for r in sequences.quantile_buckets(df, "v", "k", 2).orderBy("v").collect()] == [0, 0, 1, 1, 1]


def test_rollout_segments(spark):
    rows = [
        ("s", "a", 1, ["u1"], ["r1"]), ("s", "b", 2, ["u1", "r1", "u2"], ["r2"]), ("s", "c", 3, ["x"], []), ("s", "d", 4, ["x", "u"], ["r4"]), ("s", "e", 5, ["x", "u", "other"], ["r5"]),
        ("s", "f", 6, ["x", "u", "other", "r5"], ["r6"]), ("t", "a", 1, [], ["r1"]), ("t", "b", 2, ["r1"], ["r2"]),
    ]
    df = spark.createDataFrame(rows, "session_id string, id string, at int, input array<string>, output array<string>")
    got = {(r.session_id, r.id): (r.segment, r.reason, r.new_input) for r in sequences.rollouts(df).collect()}
    assert got == {
        ("s", "a"): (1, None, ["u1"]), ("s", "b"): (1, None, ["r1", "u2"]), ("s", "c"): (2, "input_history_changed", ["x"]), ("s", "d"): (3, "prior_output_absent", ["x", "u"]),
        ("s", "e"): (4, "prior_output_not_replayed", ["x", "u", "other"]), ("s", "f"): (4, None, ["r5"]), ("t", "a"): (1, None, []), ("t", "b"): (1, None, ["r1"]),
    }


def test_numbering_needs_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id").repartition(7)
    assert {(r.v + 1, 1000) for r in df.collect()} == {(r.n, r.m) for r in sequences.numbered(df, ["v", "id"], "n", "m").where("n = v + 1").collect()}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    assert {r.k for r in sequences.benjamini_hochberg(df, "p", "k").where("rejected").collect()} == {"a"}


def test_visibility_follows_the_latest_action(spark):
    log = spark.createDataFrame([("x", "quarantine", 1), ("x", "release", 2), ("y", "release", 1), ("y", "quarantine", 3)], "fact_id string, action string, quarantine_revision long")
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    assert sorted(r.id for r in visibility.visible(df, log, "id").collect()) == ["x", "z"]


def test_a_bounded_read_refuses(spark):
    with pytest.raises(ValueError):
        visibility.within(spark.range(5), 4)


def test_first_write_wins_in_any_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 5, "c")], "key string, at int, v string")
    for n in (1, 3):
        assert sorted((r.key, r.v) for r in visibility.first_written(df.repartition(n), ["key"], ["at"]).collect()) == [("j", "c"), ("k", "a")]


def test_shared_alias_is_ambiguous(spark):
    decisions = spark.createDataFrame([("d1", "t1", "o", "s"), ("d2", "t2", "o", "s"), ("d3", None, "o", "s"), ("d4", "t2", "p", "s"), ("d5", "zz", "o", "s")], "decision_id string, call_id string, org_id string, session_id string")
    owners = spark.createDataFrame([("t1", "c1", "o", "s"), ("t1", "c2", "o", "s"), ("t2", "c1", "o", "s")], "alias string, inference_call_id string, org_id string, session_id string")
    got = {r.decision_id: (r.owner, r.reason) for r in attachment.attach_decisions(decisions, owners).collect()}
    assert got == {"d1": (None, "ambiguous_decision_call_id"), "d2": ("c1", None), "d3": (None, "missing_call_id"), "d4": (None, "org_mismatch"), "d5": (None, "unmatched_call_id")}


def test_prefix_filter_loses_no_pair(spark):
    import random

    rng = random.Random(3)
    sets = [sorted(set(rng.choices("abcdefghijklmno", k=rng.randint(1, 9)))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    for floor in (0.3, 0.7, 0.8):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= floor}
        assert {(r.left_id, r.right_id) for r in attribution.similar_within(df, [], floor).collect()} == want


def test_prefixes_are_made_in_each_row_and_sketches_differ_in_no_more_bits_than_tokens(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    sets = [sorted({f"w{k}" for k in rng.integers(0, 300, 120)}) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    keys = attribution.rarest(df, attribution.rarity(df), 0.7, "n")
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()
    assert all(len(r._keys) == r.n - math.ceil(0.7 * r.n - 1e-9) + 1 and r._keys == sorted(r._keys) for r in keys.collect())
    bits = [rng.integers(0, 64 * attribution.WORDS, k) for k in (0, 1, 40, 5000)]
    words = attribution.sketch.func(pd.Series(bits))
    for a, x in zip(bits, words, strict=True):
        assert sum(int(w & 0xFFFFFFFFFFFFFFFF).bit_count() for w in map(int, x)) == len(set(a.tolist()))


def test_greedy_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("g", 4, 1), ("g", 5, 1)], "g string, r int, n int")
    assert sorted(r.r for r in attribution.packed(df, "g", "r", "n", 3, 10).collect()) == [1, 3, 4]


def test_packing_tries_every_part(spark):
    import random

    from factloom.plans.composite_queries import pack_parts

    rng = random.Random(4)
    rows = [("oversize", i, 5, 9000) for i in range(40)] + [("oversize", 100 + i, 1 + i % 3, 1000 + i) for i in range(30)]
    rows += [("tight", 0, 5, 8000)] + [("tight", 1 + i, 4, 500) for i in range(70)] + [("tight", 90, 1, 192)]
    rows += [("mixed", i, rng.randint(1, 5), rng.choice([50, 3000, 8192, 9000])) for i in range(300)] + [("none", 1, 1, 8193)]
    want = []
    for session in ("oversize", "tight", "mixed"):
        room, n = 8192, 0
        for rank, (_, doc, _, size) in enumerate(sorted((r for r in rows if r[0] == session), key=lambda r: (-r[2], r[1])), 1):
            if n < 8 and size <= room:
                room, n = room - size, n + 1
                want.append((session, rank, doc, size))
    df = spark.createDataFrame(rows, "session_id string, doc_id long, matched int, bytes long")
    assert sorted(tuple(r) for r in pack_parts(df).collect()) == sorted(want)


def attributed(spark, calls, sections, noted, pushes=((1, 7200),), commits=((1, "c", 0),)):
    push = spark.createDataFrame([(p, "o", "r", at) for p, at in pushes], "push_id int, org_id string, repository string, captured_at long").withColumn("captured_at", F.timestamp_seconds("captured_at"))
    commit = spark.createDataFrame(list(commits), "push_id int, commit_sha string, position int")
    changed = spark.createDataFrame([("r", *s) for s in sections], "repository string, commit_sha string, file_path string, added string")
    seen = spark.createDataFrame(list(calls), "inference_call_id int, org_id string, session_id string, observed_at long, text string").withColumn("observed_at", F.timestamp_seconds("observed_at"))
    notes = spark.createDataFrame([("r", *n) for n in noted], "repository string, commit_sha string, session_id string")
    files = attribution.claimed_files(push, commit, changed)
    got = attribution.attribute(files, seen.withColumn("tokens", T.tokens(F.col("text"))), notes)
    return {(r.commit_sha, r.file_path): (r.push_id, r.inference_call_id, r.source, r.reason) for r in got.collect()}


def test_notes_below_their_floor_do_not_compete(spark):
    calls = [(10, "o", "noted", 7000, "a x y z"), (11, "o", "other", 7100, "a b c d"), (12, "o", "other", 7000, "a b c")]
    assert attributed(spark, calls, [("c", "f.py", "a b c d")], [("c", "noted")]) == {("c", "f.py"): (1, 11, "jaccard", None)}
    calls[0] = (10, "o", "noted", 7000, "a b y z")
    assert attributed(spark, calls, [("c", "f.py", "a b c d")], [("c", "noted")]) == {("c", "f.py"): (1, 10, "git_notes", None)}


def test_windows_are_inclusive_and_ties_go_to_the_earliest_call(spark):
    text, end = "a b c d", 7200
    at = lambda *times: [(i, "o", "s", t, text) for i, t in enumerate(times, 1)]
    found = lambda calls, noted=(): attributed(spark, calls, [("c", "f.py", text)], noted)["c", "f.py"]
    assert found(at(end - 3600)) == (1, 1, "jaccard", None) and found(at(end - 3601)) == (1, None, None, "no_match")
    assert found(at(end + 600)) == (1, 1, "jaccard", None) and found(at(end + 601)) == (1, None, None, "no_match")
    assert found(at(end - 3601), [("c", "s")]) == (1, 1, "git_notes", None) and found(at(100, 50, 50), [("c", "s")]) == (1, 2, "git_notes", None)
    assert found([(1, "p", "s", end, text)], [("c", "s")]) == (1, None, None, "no_match")


def test_the_first_push_claims_a_commit(spark):
    calls = [(1, "o", "s", 7000, "a b c d")]
    pushes, commits = [(1, 7200), (2, 7100), (3, 7100)], [(1, "c", 0), (2, "c", 3), (3, "c", 0), (2, "old", 20), (1, "docs", 1), (1, "gone", 2)]
    sections = [("c", "f.py", "a b c d"), ("c", "g.md", "a b c d"), ("docs", "x.md", "text"), ("docs", "y.py", " \n ")]
    assert attributed(spark, calls, sections, [], pushes, commits) == {("c", "f.py"): (2, 1, "jaccard", None), ("docs", None): (1, None, None, "no_code_diff"), ("gone", None): (1, None, None, "commit_diff_unavailable")}


def brute_attribution(calls, files):
    """{file: call} of (path, captured, text) and (id, observed, text): the best call in the hour, by brute force."""
    words, out = lambda text: set(text.split()), {}
    for path, captured, text in files:
        near = [(len(words(text) & words(t)) / len(words(text) | words(t)), at, i) for i, at, t in calls if captured - 3600 <= at <= captured + 600]
        best = min(((-score, at, i) for score, at, i in near if score >= 0.7), default=None)
        out[path] = best and best[2]
    return out


def test_the_best_call_is_found_in_any_number_of_parts(spark, monkeypatch):
    import random

    rng = random.Random(11)
    stems = [rng.sample([f"w{k}" for k in range(40)], rng.randint(1, 14)) for _ in range(6)]
    text = lambda: " ".join(dict.fromkeys([*(w for w in rng.choice(stems) if rng.random() < 0.93), *(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 0, 1])))])) or "w1"
    calls = [(i, 60 * rng.randrange(400), text()) for i in range(150)]
    pushes = [(p, 60 * rng.randrange(400)) for p in range(60)]
    files = [(f"f{p}.py", captured, text()) for p, captured in pushes]
    want = brute_attribution(calls, files)
    assert sum(v is not None for v in want.values()) > 20 and None in want.values()
    for least, per_row in ((attribution.PAIRS_AT_LEAST, attribution.PAIRS_PER_ROW), (1, 0.5)):
        monkeypatch.setattr(attribution, "PAIRS_AT_LEAST", least)
        monkeypatch.setattr(attribution, "PAIRS_PER_ROW", per_row)
        got = attributed(spark, [(i, "o", "s", at, t) for i, at, t in calls], [(str(p), path, t) for (p, _), (path, _, t) in zip(pushes, files, strict=True)], [], pushes, [(p, str(p), 0) for p, _ in pushes])
        assert {path: call for (_, path), (_, call, _, _) in got.items()} == want


def test_texts_are_compared_only_where_a_call_may_be_the_best(spark, monkeypatch):
    held = []
    save = attribution.Workspace.save
    monkeypatch.setattr(attribution.Workspace, "save", lambda self, df, name: (out := save(self, df, name), name in ("classes", "likely-pairs", "rest-pairs") and held.append(out.count()))[0])
    base = [f"w{k}" for k in range(60)]
    told = lambda k, n: " ".join([*base[: 60 - n], *(f"x{k}_{i}" for i in range(n))])  # noqa: E731  n words of its own
    calls = [(k, k, told(k, 1 + k % 5)) for k in range(40)]
    files = [(f"f{k}.py", 100, told(100 + k, 1 + k % 3)) for k in range(40)] + [("same.py", 100, calls[7][2])]
    got = attributed(spark, [(i, "o", "s", at, t) for i, at, t in calls], [("c", path, t) for path, _, t in files], [], ((1, 100),))
    assert {path: call for (_, path), (_, call, _, _) in got.items()} == brute_attribution(calls, files)
    assert sum(held) < 10 * len(files)


def test_parities_differ_in_no_more_bits_than_tokens(spark):
    import pandas as pd

    rng = np.random.default_rng(7)
    pool = rng.integers(-(2**63), 2**63 - 1, 6000)
    sets = [np.unique(pool[rng.integers(0, 6000, n)]) for n in (1, 5, 60, 64, 65, 90, 130, 1500, 2100, 5000)]
    parities = attribution.parity.func(pd.Series(sets))
    assert [len(b) * 8 for b in parities] == [max(64, 1 << (len(s) - 1).bit_length()) for s in sets]
    x, y = zip(*((i, j) for i in range(len(sets)) for j in range(len(sets))), strict=True)
    got = attribution.apart.func(parities.iloc[list(x)].reset_index(drop=True), parities.iloc[list(y)].reset_index(drop=True))
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) and d % 2 == len(np.setxor1d(sets[i], sets[j])) % 2 for i, j, d in zip(x, y, got, strict=True))
    assert got[2 * len(sets) + 3] > 0 and got[0] == 0


def test_similar_counts_have_no_row_for_a_pair_of_copies(spark):
    rows = [(i, "m", ["a", "b", "c", "d"]) for i in range(50)] + [(99, "m", ["a", "b", "c", "d", "e"]), (100, "m", ["z"])]
    got = attribution.similar_counts(spark.createDataFrame(rows, "id int, g string, tokens array<string>"), ["g"], 0.8).first()
    assert (got.texts, got.pairs) == (52, 50 * 49 // 2 + 50) and [tuple(e) for e in got.examples] == [(0, 49), (0, 99)]


def test_similar_counts_make_the_classes_of_texts_once(spark, monkeypatch):
    saved = []
    save = attribution.Workspace.save
    monkeypatch.setattr(attribution.Workspace, "save", lambda self, df, name: saved.append((name, "tokens" in df.columns)) or save(self, df, name))
    rows = [(i, "m", ["a", "b", "c", "d", str(i // 2)]) for i in range(8)]
    assert attribution.similar_counts(spark.createDataFrame(rows, "id int, g string, tokens array<string>"), ["g"], 0.8).first().pairs == 4
    assert [name for name, whole in saved if whole] == ["classes"]


def test_line_delta_is_that_of_sequence_matcher():
    import difflib
    import random

    from factloom.functions.text import _delta

    rng = random.Random(3)
    for k in range(300):
        a = np.array([rng.randrange(3 if k % 2 else 40) for _ in range(rng.randrange(30))], np.int64)
        b = np.array([rng.choice([*a.tolist(), 99]) if len(a) and rng.random() < 0.7 else rng.randrange(40) for _ in range(rng.randrange(30))], np.int64)
        codes = [c for c in difflib.SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_opcodes() if c[0] != "equal"]
        assert _delta(a, b) == (sum(c[4] - c[3] for c in codes), sum(c[2] - c[1] for c in codes))


def test_line_delta_of_many_short_blocks_takes_one_step(monkeypatch):
    import difflib
    import random

    from factloom.functions import text

    steps = []
    monkeypatch.setattr(text, "_longest", lambda a, b, own=text._longest: steps.append(len(a)) or own(a, b))
    a = np.arange(20_000)
    b = np.concatenate([[x for x in (i, -1 - i if i % 5 == 4 else None) if x is not None and (x < 0 or i % 7 < 6)] for i in range(20_000)]).astype(np.int64)
    assert text._delta(a, b) == (20_000 // 5, 20_000 // 7) and not steps
    rng = random.Random(5)
    for _ in range(200):  # distinct lines, some moved
        a = rng.sample(range(60), 40)
        b = [x for x in a if rng.random() < 0.8] + [99]
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b)), b.pop(rng.randrange(len(b))))
        codes = [c for c in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if c[0] != "equal"]
        assert text._delta(np.array(a), np.array(b)) == (sum(c[4] - c[3] for c in codes), sum(c[2] - c[1] for c in codes))


def test_error_function(spark):
    import math

    xs = [0.0, 1e-9, 0.3, 1.0, 2.0, 2.999, 3.0, 3.001, 4.5, 8.0, 20.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e"), stats.normal_cdf(-F.col("x")).alias("low"), stats.two_sided(F.col("x")).alias("p")).collect():
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=1e-9 if r.x > 2 else 1e-13) and math.isclose(r.low, math.erfc(r.x / math.sqrt(2)) / 2, rel_tol=1e-9) and math.isclose(r.p, math.erfc(r.x / math.sqrt(2)), rel_tol=1e-9)
