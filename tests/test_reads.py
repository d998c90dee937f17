import pytest
from pyspark.sql import functions as F

from factloom.operators import visibility
from factloom.sources import bundles, reads, rows_out

from .conftest import rows_of


def test_a_cursor_is_bound_to_its_question(spark):
    facts = spark.createDataFrame([(i, i // 3) for i in range(10)], "id long, t long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    first, cursor = visibility.page(facts, "at", "id", 4, {"a": 1}, 1)
    assert [r.id for r in first.collect()] == [9, 8, 7, 6]
    second, cursor2 = visibility.page(facts, "at", "id", 4, {"a": 1}, 1, cursor)
    assert [r.id for r in second.collect()] == [5, 4, 3, 2]
    third, end = visibility.page(facts, "at", "id", 4, {"a": 1}, 1, cursor2)
    assert [r.id for r in third.collect()] == [1, 0] and end is None
    for asked, revision in (({"a": 2}, 1), ({"a": 1}, 2)):
        with pytest.raises(ValueError):
            visibility.page(facts, "at", "id", 4, asked, revision, cursor)


def test_a_run_of_several_repositories_is_refused(spark):
    rows = [("o", "ci", "7", 1, "f", "h", "r1"), ("o", "ci", "7", 1, "f", "h2", "r2")]
    outcomes = spark.createDataFrame(rows, "org_id string, provider string, run_id string, run_attempt long, repository_provider string, repository_host string, repository string")
    with pytest.raises(ValueError):
        reads.run_receipt(outcomes, {"run_id": "7"})
    assert reads.run_receipt(outcomes, {"run_id": "7", "repository": "r2"}).count() == 1


@pytest.mark.parametrize("start, end, as_of", [("2026-02-01", "2026-01-01", "2026-03-01"), ("2026-01-01", "2026-03-01", "2026-03-01"), ("2026-01-01", "2026-01-10", "2026-01-05")])
def test_odd_cohorts_are_refused(spark, start, end, as_of):
    with pytest.raises(ValueError):
        reads.cohort(spark.createDataFrame([], "at timestamp"), "at", start, end, as_of)


def test_bounds(spark):
    facts = spark.createDataFrame([(i, f"2026-01-0{i}") for i in range(1, 6)], "id int, d string").select("id", F.to_timestamp("d").alias("at"))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(reads.scope(facts, "at", "2026-01-02", "2026-01-04")) == [2, 3] and ids(reads.scope(facts, "at", through="2026-01-02")) == [1, 2]
    assert ids(reads.since_days(facts, "at", "2026-01-04", 2)) == [2, 3, 4]
    with pytest.raises(ValueError):
        reads.bounded(facts, 4)
    assert reads.bounded(facts, 5).count() == 5


def test_quarantine_actions_leave_what_is_quarantined(spark):
    log = spark.createDataFrame([(1, "a", "quarantine"), (2, "b", "quarantine"), (3, "b", "release")], "quarantine_revision long, fact_id string, action string")
    facts = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")
    got = reads.quarantine_actions(log, facts, "id", "quarantine", "why")
    assert rows_of(got.select("fact_id", "quarantine_revision")) == [{"fact_id": "b", "quarantine_revision": 4}, {"fact_id": "c", "quarantine_revision": 5}]
    assert rows_of(reads.quarantine_actions(log, facts, "id", "release", "why").select("fact_id")) == [{"fact_id": "a"}]


def test_json_lines_are_published_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/rows"
    rows = spark.createDataFrame([(1, 0.5, "train"), (2, 1.5, "eval")], "id int, x double, split string")
    assert rows_out.write_jsonl(rows, folder, "split") and not rows_out.write_jsonl(rows.where("false"), folder)
    with pytest.raises(ValueError):
        rows_out.write_jsonl(rows.withColumn("x", F.lit(float("inf"))), folder)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["rows"] and spark.read.json(folder).count() == 2


def test_a_changed_bundle_is_told(spark, tmp_path):
    rows = [("completions", "eval" if i % 5 == 0 else "train", str(i), [], f"b{i}") for i in range(3000)] + [("pairs", "eval", "p", [0, 1], "x"), ("pairs", "train", "q", [1, 2], "x"), ("pairs", "train", "q", [1, 2], "x")]
    frame = spark.createDataFrame(rows, bundles.ROWS)
    bundles.write(frame, f"file://{tmp_path}/b")
    manifest = {r.table: (r.rows, r.depth, r.digest) for r in bundles.digests(frame.repartition(7)).collect()}
    assert manifest == {r.table: (r.rows, r.depth, r.digest) for r in spark.read.schema(bundles.MANIFEST).json(f"file://{tmp_path}/b/manifest").collect()}
    assert manifest["completions"][:2] == (3000, 1) and manifest["pairs"][:2] == (3, 0)
    told = {r.table: r.asDict() for r in bundles.faults(spark, f"file://{tmp_path}/b").collect()}
    assert all(r["intact"] for r in told.values()) and told["pairs"]["repeated_ids"] == 1 and told["pairs"]["split_faults"] == 0
    spark.createDataFrame([("pairs", "train", "z", [7, 5000, 5], "x")], bundles.ROWS).write.mode("append").partitionBy("table", "split").parquet(f"file://{tmp_path}/b/rows")
    told = {r.table: r.asDict() for r in bundles.faults(spark, f"file://{tmp_path}/b").collect()}
    assert told["completions"]["intact"] and not told["pairs"]["intact"] and (told["pairs"]["found_rows"], told["pairs"]["dangling"], told["pairs"]["split_faults"]) == (4, 1, 1)
    assert [bundles.depth_of(n) for n in (0, 1000, 1001, 16_000, 16_001)] == [0, 0, 1, 1, 2]
