"""Queries of capture and of functions over messages, diffs and texts: payloads are made of the tables' rows and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..functions.stats import NORMAL, Z95
from ..operators import attachment, evidence, sequences
from ..operators.confidence import unreliable_confidence
from ..sources import capture, rows_out, transcripts
from ..sources.bindings import ctes, facts
from ..streaming import streams
from . import derivations
from .registry import query

def _at() -> Column:
    return F.to_timestamp(F.lit("2026-01-01T00:00:00"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- gateway ---------------------------------------------------------------


def _gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each event: chat choices, plain texts or output items by the id's remainder."""
    i, user = F.col("event_id"), _text("user_id")
    own = lambda test, c: F.when(test, c)
    arguments = F.to_json(F.struct(F.struct(_text("event_type").alias("y"), F.lit('q"\\').alias("x")).alias("b"), F.array(F.lit("one"), F.lit("two:")).alias("a"), F.lit(7).alias("n")))
    call = F.struct(F.concat(F.lit("t"), _text("event_id")).alias("id"), F.struct(F.lit("Edit").alias("name"), arguments.alias("arguments")).alias("function"))
    message = F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("said "), _text("event_type")).alias("content"), F.array(call).alias("tool_calls"))
    choices = F.array(F.struct(own(i % 4 == 1, F.lit("plain")).alias("text"), own(i % 4 == 0, message).alias("message")))
    item = lambda kind, **fields: F.struct(F.lit(kind).alias("type"), *(fields.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("call_id", "string"), ("name", "string"), ("arguments", "string"), ("content", "array<struct<type:string,text:string>>"), ("summary", "array<struct<text:string>>"))))
    items = F.array(
        item("reasoning", summary=F.array(F.struct(F.lit("thinking").alias("text")))), item("message", content=F.array(F.struct(F.lit("output_text").alias("type"), F.concat(F.lit("item "), _text("event_type")).alias("text")))),
        item("function_call", call_id=F.concat(F.lit("f"), _text("event_id")), name=F.lit("Write"), arguments=F.lit('{"content": "body"}')),
    )
    usage = lambda a, b: F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens"))
    response = F.struct(F.concat(F.lit("r"), _text("event_id")).alias("id"), own(i % 4 < 2, choices).alias("choices"), own(i % 4 == 2, items).alias("output"), own(i % 4 == 3, F.lit("whole")).alias("output_text"), own(i % 3 == 1, usage(i % 90, i % 8)).alias("usage"))
    payload = F.struct(
        F.col("event_type").alias("model"), own(i % 6 != 0, F.concat(F.lit("c"), _text("event_id"))).alias("litellm_call_id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages"), response.alias("response"),
        own(i % 3 == 0, usage(i % 100, i % 7)).alias("usage"), (i % 50).alias("prompt_tokens"), (i % 5).alias("completion_tokens"), F.round("value", 2).alias("response_time"), F.struct(own(i % 10 < 6, F.concat(F.lit("s"), user)).alias("session_id")).alias("metadata"),
    )
    raw = _table(spark, sf_dir, "events").select("event_id", F.to_json(payload).alias("payload"), F.col("ts").alias("observed_at"), own(i % 10 < 8, F.concat(F.lit("h"), user)).alias("header"))
    return capture.gateway_calls(raw, header="header")


_GATEWAY = """WITH g AS (SELECT *, CASE WHEN event_id % 10 < 6 THEN 's' || user_id WHEN event_id % 10 < 8 THEN 'h' || user_id END AS session_id,
  CASE WHEN event_id % 6 <> 0 THEN 'c' || event_id ELSE 'r' || event_id END AS model_call_id FROM events)"""


@query("t01_gateway_calls", _GATEWAY + """
SELECT session_id, event_type AS model, CASE event_id % 3 WHEN 0 THEN event_id % 100 WHEN 1 THEN event_id % 90 ELSE event_id % 50 END AS input_tokens, CASE event_id % 3 WHEN 0 THEN event_id % 7 WHEN 1 THEN event_id % 8 ELSE event_id % 5 END AS output_tokens,
  CASE WHEN round(value, 2) >= 0 THEN round(round(value, 2) * 1000)::bigint END AS duration_ms, model_call_id, ts AS observed_at FROM g WHERE session_id IS NOT NULL""")  # fmt: skip
def gateway_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gateway(spark, sf_dir).select("session_id", "model", "input_tokens", "output_tokens", "duration_ms", "model_call_id", "observed_at")


@query("f09_scoring_text", _GATEWAY + r"""
SELECT model_call_id, CASE event_id % 4 WHEN 0 THEN concat('said ', event_type, chr(10), 'one', chr(10), 'two:', chr(10), 'q"\', chr(10), event_type) WHEN 1 THEN 'plain' WHEN 2 THEN concat('item ', event_type, chr(10), 'body') ELSE 'whole' END AS said FROM g WHERE session_id IS NOT NULL""")  # fmt: skip
def scoring_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gateway(spark, sf_dir).select("model_call_id", T.scoring_text(F.col("output_messages")).alias("said"))


@query("f10_alias_set", _GATEWAY + """ SELECT model_call_id, CASE event_id % 4 WHEN 0 THEN concat(model_call_id, ',t', event_id) WHEN 2 THEN concat(model_call_id, ',f', event_id) ELSE model_call_id END AS call_ids FROM g WHERE session_id IS NOT NULL""")
def alias_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.aliases(F.col("output_messages"), F.col("model_call_id"))
    return _gateway(spark, sf_dir).select("model_call_id", F.array_join(F.concat(F.array("model_call_id"), F.array_except(own, F.array("model_call_id"))), ",").alias("call_ids"))


@query("f11_prompt_keys", _GATEWAY + " SELECT model, count(*) AS calls, count(DISTINCT event_id % 37)::integer AS keys FROM (SELECT event_type AS model, event_id FROM g WHERE session_id IS NOT NULL) GROUP BY model")
def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of which 37 differ, by a word in their first part."""
    number = F.regexp_extract("model_call_id", "[0-9]+", 0).cast("long") % 37
    given = F.transform("input_messages", lambda m, i: m.withField("parts", F.transform(m["parts"], lambda p, j: p.withField("content", F.when((i == 0) & (j == 0), F.concat(F.lit("q"), number.cast("string"))).otherwise(p["content"])))))
    calls = _gateway(spark, sf_dir).withColumn("input_messages", given).withColumn("key", evidence.prompt_key("input_messages"))
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.count_distinct("key").cast("int").alias("keys"))


@query("f12_trainable", _GATEWAY + " SELECT model_call_id, NOT (event_id % 5 IN (1, 3)) AS trainable FROM g WHERE session_id IS NOT NULL")
def trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some results hold a number that isn't finite, some half of a surrogate pair."""
    k = F.regexp_extract("model_call_id", "[0-9]+", 0).cast("long") % 5
    part = F.get(F.get(F.col("output_messages"), 0)["parts"], 0)
    result = F.when(k == 1, '{"x":[1,NaN]}').when(k == 2, '{"x":"NaN","y":"\\ud83d\\ude00","z":"\\\\ud83d"}').when(k == 3, '{"x":"half \\ud83d of a pair"}').otherwise(part["result"])
    bad = part.withField("result", result)
    spoilt = F.transform("output_messages", lambda m, i: m.withField("parts", F.when(i == 0, F.concat(F.array(bad), m["parts"])).otherwise(m["parts"])))
    return _gateway(spark, sf_dir).select("model_call_id", T.is_trainable(spoilt).alias("trainable"))


@query("s22_evidence_manifest", _GATEWAY + """
SELECT model_call_id, CASE WHEN event_id % 4 = 0 THEN 3 WHEN event_id % 4 = 2 THEN 4 ELSE 2 END::bigint AS parts FROM g WHERE session_id IS NOT NULL""")  # fmt: skip
def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _gateway(spark, sf_dir).withColumn("inference_call_id", F.col("model_call_id"))
    return evidence.manifest(calls).select(F.col("inference_call_id").alias("model_call_id"), "parts")


@query("s22_evidence_parts", _GATEWAY + " SELECT 'f' || event_id AS id, 'Write {\"content\": \"body\"}' AS text FROM g WHERE session_id IS NOT NULL AND event_id % 4 = 2")
def evidence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _gateway(spark, sf_dir).withColumn("inference_call_id", F.col("model_call_id"))
    wanted = calls.select("inference_call_id", F.lit("output").alias("side"), F.lit(0).alias("message"), F.lit(2).alias("part"))
    ids = calls.select("inference_call_id", F.get(F.get(F.col("output_messages"), 0)["parts"], 2)["id"].alias("id"))
    return evidence.referenced(calls, wanted).join(ids, "inference_call_id").select("id", "text")


@query("t02_session_identity", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'm' || user_id WHEN 1 THEN 'j' || user_id WHEN 2 THEN '01234567-89ab-cdef-0123-456789abcdef' WHEN 3 THEN 'h' || user_id END AS session_id FROM events""")  # fmt: skip
def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, user = F.col("event_id"), _text("user_id")
    metadata = F.when(i % 5 == 0, F.concat(F.lit("m"), user)).otherwise(F.lit(" "))
    identity = F.when(i % 5 == 1, F.to_json(F.struct(F.concat(F.lit("j"), user).alias("session_id")))).when(i % 5 == 2, F.lit("ada_session_01234567-89ab-cdef-0123-456789abcdef")).otherwise(F.lit("ada"))
    header = F.when(i % 5 == 3, F.concat(F.lit("h"), user))
    return _table(spark, sf_dir, "events").select("event_id", capture.session_identity(metadata, identity, header).alias("session_id"))


# --- OTLP ------------------------------------------------------------------

_EVENTS = ("x.tool_decision", "x.tool_result", "x.edit_observation", "x.rejected_edit", "x.retry_linkage", "x.other", "x.other")


#: Columns of a line item that its record is made of, in the order that sorts a batch's records.
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_shipdate")


def _record(l: Column, order: Column) -> Column:  # noqa: E741
    """The log record of a line item."""
    value = lambda c: F.struct(c.cast("string").alias("stringValue"))
    attribute = lambda k, c: F.struct(F.lit(k).alias("key"), value(c).alias("value"))
    line, part, supplier = l["l_linenumber"], l["l_partkey"], l["l_suppkey"]
    call, path = F.concat(F.lit("t"), _text(order)), F.concat(F.lit("src/"), _text(part), F.lit(".py"))
    attributes = F.array(
        attribute("session.id", F.concat(F.lit("s"), _text(supplier))), attribute("agent", F.when(part % 9 == 0, "other").otherwise("codex")), attribute("tool_use_id", call), attribute("tool_name", F.when(part % 7 == 0, "Bash").otherwise("Edit")),
        attribute("decision", F.when(l["l_returnflag"] == "R", "reject").otherwise("accept")), attribute("source", F.when(l["l_linestatus"] == "F", "user").otherwise("config")), attribute("file_path", F.when(line != 1, path)),
        attribute("applied_text", _text(l["l_quantity"])), attribute("observed_file_text", F.when(part % 5 != 0, _text(l["l_tax"]))), attribute("external_lines_added", supplier - 5), attribute("proposed", _text(l["l_discount"])),
        attribute("rejected_call_id", call), attribute("accepted_call_id", F.when(part % 11 != 0, F.concat(F.lit("u"), _text(order)))),
    )
    nanos = F.when(supplier % 13 == 0, F.lit("0")).otherwise((F.unix_micros(l["l_shipdate"].cast("timestamp")) * 1000).cast("string"))
    return F.struct(nanos.alias("timeUnixNano"), value(F.element_at(F.lit(list(_EVENTS)), line)).alias("body"), attributes.alias("attributes"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTLP batches of line items: a record for each, its event by the line's number. Lines are shuffled as they are and become records, which are some ten times as wide, in their batch."""
    each = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct(*_LINE))).alias("lines"))
    records = F.transform("lines", lambda l: _record(l, F.col("batch_id")))  # noqa: E741
    return each.select("batch_id", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(records.alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))).alias("payload"))


@query("t03_otlp_partition", """SELECT count(*) FILTER (WHERE l_linenumber <= 2) AS translated, count(*) FILTER (WHERE l_linenumber > 2) AS untranslated, (SELECT count(*) FROM region) AS malformed FROM lineitem""")
def otlp_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = _table(spark, sf_dir, "region").select(F.lit(-1).cast("long").alias("batch_id"), F.concat(F.lit("{"), F.col("r_name")).alias("payload"))
    return capture.otlp_partition(_batches(spark, sf_dir).unionByName(broken))


@query("x28_otlp_attributes", """SELECT l_orderkey AS batch_id, 's' || l_suppkey AS session, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE epoch_us(l_shipdate) END AS at FROM lineitem WHERE l_linenumber = 2""")
def otlp_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = capture.otlp_records(_batches(spark, sf_dir)).where("event = 'x.tool_result'")
    return records.select("batch_id", F.col("attributes")["session.id"].alias("session"), F.unix_micros("occurred_at").alias("at"))


@query("t04_otlp_decisions", """
WITH r AS (SELECT l_orderkey, arg_max('src/' || l_partkey || '.py', (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS path FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey)
SELECT 's' || l_suppkey AS session_id, 't' || l_orderkey AS call_id, l_returnflag <> 'R' AS accepted, l_linestatus = 'F' AS explicit, coalesce(path, '') AS file_path FROM lineitem LEFT JOIN r USING (l_orderkey) WHERE l_linenumber = 1 AND l_partkey % 7 <> 0 AND l_suppkey % 13 <> 0""")  # fmt: skip
def otlp_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.otlp_decisions(capture.otlp_records(_batches(spark, sf_dir))).select("session_id", "call_id", "accepted", "explicit", "file_path")


@query("t05_edit_observations", """
SELECT 's' || l_suppkey AS session_id, 't' || l_orderkey AS call_id, 'src/' || l_partkey || '.py' AS file_path, CASE WHEN l_suppkey >= 5 THEN l_suppkey - 5 END AS external_lines_added FROM lineitem WHERE l_linenumber = 3 AND l_partkey % 5 <> 0 AND l_suppkey % 13 <> 0""")  # fmt: skip
def edit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.edit_observations(capture.otlp_records(_batches(spark, sf_dir))).select("session_id", "call_id", "file_path", "external_lines_added")


@query("t05_rejected_edits", "SELECT 's' || l_suppkey AS session_id, 't' || l_orderkey AS call_id FROM lineitem WHERE l_linenumber = 4 AND l_suppkey % 13 <> 0")
def rejected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.rejected_edits(capture.otlp_records(_batches(spark, sf_dir))).select("session_id", "call_id")


@query("t05_retry_linkages", """
SELECT coalesce(CASE WHEN l_partkey % 11 = 0 THEN 'missing_accepted_call_id' WHEN l_suppkey % 13 = 0 THEN 'missing_event_time' WHEN l_partkey % 9 = 0 THEN 'invalid_agent_harness' WHEN l_partkey % 7 = 0 THEN 'invalid_tool_name' END, 'linked') AS reason, count(*) AS n FROM lineitem WHERE l_linenumber = 5 GROUP BY 1""")  # fmt: skip
def retry_linkages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.retry_linkages(capture.otlp_records(_batches(spark, sf_dir))).groupBy(F.coalesce("reason", F.lit("linked")).alias("reason")).agg(F.count("*").alias("n"))


# --- webhooks and posted facts ------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    sha = lambda c: F.upper(F.sha1(_text(c)))
    repo = lambda c: F.struct(c.alias("full_name"), F.col("l_suppkey").alias("id"))
    full = F.concat(F.lit("Acme/R"), _text("l_suppkey"))
    end = lambda c, r: F.struct(F.lit("main").alias("ref"), sha(c).alias("sha"), r.alias("repo"))
    action = F.when(k % 3 == 0, "closed").when(k % 3 == 1, "opened").otherwise("synchronize")
    request = F.struct(
        (F.col("l_partkey") + 1).alias("number"), (F.col("l_returnflag") != "R").alias("merged"), F.when(k % 4 == 0, F.lit("2026-01-02T03:04:05")).otherwise(F.lit("2026-01-02T03:04:05Z")).alias("merged_at"), sha(k).alias("merge_commit_sha"),
        end("l_partkey", F.when(k % 17 != 0, repo(full))).alias("head"), end("l_suppkey", repo(full)).alias("base"),
    )
    payload = F.struct(action.alias("action"), request.alias("pull_request"), repo(full).alias("repository"), sha(F.col("l_partkey") + 1).alias("before"), F.when(k % 5 == 0, sha(k)).when(k % 7 == 0, F.lit("short")).otherwise(sha("l_partkey")).alias("after"))
    return _table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.to_json(payload).alias("payload"), _at().alias("captured_at"))


@query("t06_pull_request_merges", """SELECT 'acme/r' || l_suppkey AS repo, l_partkey + 1 AS pr_number, sha1(l_partkey::varchar) AS head_sha, sha1(l_suppkey::varchar) AS base_sha, sha1(l_orderkey::varchar) AS merge_commit_sha, TIMESTAMP '2026-01-02 03:04:05' AS merged_at
FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0 AND l_returnflag <> 'R' AND l_orderkey % 4 <> 0 AND l_orderkey % 17 <> 0""")  # fmt: skip
def pull_request_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.pull_request_merges(_requests(spark, sf_dir)).select("repo", "pr_number", "head_sha", "base_sha", "merge_commit_sha", "merged_at")


@query("t06_pull_request_revisions", """WITH r AS (SELECT *, l_orderkey % 3 = 2 AS pushed, CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey <> l_partkey END AS off FROM lineitem WHERE l_linenumber = 1)
SELECT 'acme/r' || l_suppkey AS repo, sha1(l_partkey::varchar) AS head_sha, CASE WHEN pushed THEN sha1((l_partkey + 1)::varchar) END AS previous_head_sha,
  CASE WHEN l_orderkey % 3 = 0 THEN 'unsupported_action' WHEN l_orderkey % 17 = 0 THEN 'head_repository_deleted' WHEN pushed AND off THEN 'synchronize_head_mismatch' WHEN pushed AND l_orderkey % 5 <> 0 AND l_orderkey % 7 = 0 THEN 'invalid_boundary' END AS reason FROM r""")  # fmt: skip
def pull_request_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.pull_request_revisions(_requests(spark, sf_dir)).select("repo", "head_sha", "previous_head_sha", "reason")


@query("t06_repository_renames", "SELECT s_suppkey::varchar AS repository_id, 'acme/' || lower(s_name) AS old_repo, 'acme/new' || s_suppkey AS new_repo FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0")
def repository_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    new = F.concat(F.lit("Acme/NEW"), _text("s_suppkey"))
    old = F.when(k % 3 == 0, F.concat(F.lit("new"), _text("s_suppkey"))).otherwise(F.col("s_name"))
    payload = F.struct(F.when(k % 2 == 0, "renamed").otherwise("edited").alias("action"), F.struct(F.struct(F.struct(old.alias("from")).alias("name")).alias("repository")).alias("changes"), F.struct(k.alias("id"), new.alias("full_name")).alias("repository"))
    raw = _table(spark, sf_dir, "supplier").select(F.to_json(payload).alias("payload"), _at().alias("captured_at"))
    return capture.repository_renames(raw).drop("captured_at")


@query("t06_workflow_outcomes", """SELECT o_orderkey::varchar AS run_id, 'acme/r' || o_custkey AS repo, sha1(o_custkey::varchar) AS commit_sha, CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'unknown' END AS result FROM orders WHERE o_orderkey % 5 <> 0""")
def workflow_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    conclusion = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failure").otherwise("startup_failure")
    run = F.struct(k.alias("id"), F.lit("ci").alias("name"), F.lit("main").alias("head_branch"), F.sha1(_text("o_custkey")).alias("head_sha"), F.lit(1).alias("run_attempt"), conclusion.alias("conclusion"))
    payload = F.struct(F.when(k % 5 == 0, "requested").otherwise("completed").alias("action"), run.alias("workflow_run"), F.struct(F.concat(F.lit("Acme/R"), _text("o_custkey")).alias("full_name")).alias("repository"))
    return capture.workflow_outcomes(_table(spark, sf_dir, "orders").select(F.to_json(payload).alias("payload"), _at().alias("captured_at"))).select("run_id", "repo", "commit_sha", "result")


@query("t07_vendor_outcomes", """SELECT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'missing_repo' WHEN o_orderkey % 7 = 0 THEN 'invalid_commit' WHEN o_orderkey % 11 = 0 THEN 'partial_identity' WHEN o_orderstatus = 'P' THEN 'unknown_result' END, 'stored') AS reason, count(*) AS n FROM orders GROUP BY 1""")
def vendor_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    payload = F.struct(
        F.lit("jenkins").alias("provider"), _text(k).alias("run_id"), F.when(k % 5 == 0, "").otherwise("Acme/App").alias("repo"), F.when(k % 7 == 0, "abc").otherwise(F.sha1(_text(k))).alias("commit_sha"), F.lit("main").alias("branch"),
        F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "failed").otherwise("odd").alias("result"), F.when(k % 11 == 0, "forge").alias("repository_provider"),
    )
    found = capture.vendor_outcomes(_table(spark, sf_dir, "orders").select(F.to_json(payload).alias("payload"), _at().alias("captured_at")))
    return found.groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


@query("t07_compute_allocations", "SELECT 's' || user_id AS session_id, event_type AS allocation_source, event_id % 4000 - 5 AS cpu_millicores, ts AS occurred_at FROM events WHERE event_id % 4000 >= 5 AND event_id % 3 <> 0")
def compute_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    payload = F.struct(F.when(i % 3 != 0, F.concat(F.lit("s"), _text("user_id"))).alias("session_id"), F.col("event_type").alias("allocation_source"), (i % 4000 - 5).alias("cpu_millicores"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("occurred_at"))
    found = capture.compute_allocations(_table(spark, sf_dir, "events").select(F.to_json(payload).alias("payload"), _at().alias("captured_at")))
    return found.select("session_id", "allocation_source", "cpu_millicores", "occurred_at")


@query("t08_transcript_texts", "SELECT 's' || conv_id AS session_id, turn * 16777216 AS position FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT starts_with(ltrim(text), '[')")
def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.concat(F.lit("s"), _text("conv_id")).alias("sessionId"), F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"))
    lines = _table(spark, sf_dir, "conversations").where("not startswith(ltrim(text), '[')").select(F.col("turn").alias("line"), F.to_json(entry).alias("entry"))
    return transcripts.said(transcripts.events(lines))


def _told(*entries: Column) -> Column:
    """Entries of a transcript as (line, entry) structs."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("line"), c.alias("entry")) for i, c in enumerate(entries)))).alias("l")


_DOCS = "WITH d AS (SELECT doc_id, doc_id % 5 AS k, regexp_replace(text, '[^a-z ]', '', 'g') AS t FROM documents WHERE text <> '')"


@query("t08_message_edits", _DOCS + """ SELECT 's' || doc_id AS session_id, 'w' || doc_id AS id, 'write' AS tool_name, CASE WHEN k IN (0, 4) THEN '/work/src/f.py' END AS file_path, md5(t) AS text, CASE k WHEN 1 THEN 'session_mismatch' WHEN 2 THEN 'execution_directory_invalid' WHEN 3 THEN 'unsupported_path' END AS reason FROM d
UNION ALL SELECT 's' || doc_id, 'e' || doc_id, 'edit', CASE WHEN k <> 1 THEN '/abs/g.py' END, md5(t || chr(10) || 'second'), CASE k WHEN 1 THEN 'session_mismatch' END FROM d WHERE doc_id % 7 <> 0""")  # fmt: skip
def message_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript for each document: a write, an edit of two spans (failed in every seventh) and a call of another tool; some headers and paths are spoilt."""
    i = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", (i % 5).alias("k"), F.regexp_replace("text", "[^a-z ]", "").alias("t"))
    k, name = F.col("k"), lambda c: F.concat(F.lit(c), _text("doc_id"))
    js = lambda *c: F.to_json(F.struct(*c))
    arguments = F.struct(F.when(k == 3, "~/f.py").otherwise("./src/x/../f.py").alias("path"), F.col("t").alias("content"))
    call = lambda id_, tool, args: F.array(F.struct(F.lit("toolCall").alias("type"), id_.alias("id"), F.lit(tool).alias("name"), args.alias("arguments")))
    said = lambda content: js(F.lit("message").alias("type"), F.struct(F.lit("assistant").alias("role"), F.lit(1_700_000_000_000).alias("timestamp"), content.alias("content")).alias("message"))
    result = lambda id_, bad: js(F.lit("message").alias("type"), F.struct(F.lit("toolResult").alias("role"), id_.alias("toolCallId"), bad.alias("isError")).alias("message"))
    edit = F.struct(F.lit("/abs//g.py").alias("path"), F.array(F.struct(F.col("t").alias("newText")), F.struct(F.lit("second").alias("newText"))).alias("edits"))
    header = js(F.lit("session").alias("type"), F.when(k == 1, "other").otherwise(name("s")).alias("id"), F.when(k == 2, "relative").otherwise("/work").alias("cwd"))
    rows = docs.select(name("s").alias("session_id"), _told(
        header, said(call(name("w"), "write", arguments)), result(name("w"), F.lit(False)), F.lit("{broken"), said(call(name("e"), "edit", edit)), result(name("e"), i % 7 == 0), said(call(name("b"), "bash", arguments)),
    )).select("session_id", "l.line", "l.entry")
    return transcripts.message_edits(rows).select("session_id", "id", "tool_name", "file_path", F.md5("text").alias("text"), "reason")


@query("t08_event_edits", _DOCS + """ SELECT 's' || doc_id AS session_id, 'a' || doc_id AS id, CASE WHEN k < 2 THEN '/work/new.py' END AS file_path, CASE WHEN k < 2 THEN md5(t) END AS text, CASE k WHEN 2 THEN 'unsupported_patch_kind' WHEN 3 THEN 'session_mismatch' WHEN 4 THEN 'unsupported_patch_kind' END AS reason FROM d
UNION ALL SELECT 's' || doc_id, 'u' || doc_id, CASE WHEN k NOT IN (3) AND doc_id % 7 NOT IN (1, 2) THEN '/work/moved.py' END, CASE WHEN k <> 3 AND doc_id % 7 NOT IN (1, 2) THEN md5(t || chr(10) || 'more') END,
  CASE WHEN k = 3 THEN 'session_mismatch' WHEN doc_id % 7 = 1 THEN 'execution_failed' WHEN doc_id % 7 = 2 THEN 'malformed_patch' END FROM d""")  # fmt: skip
def event_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript for each document: an added file and an updated one that moved; some patches have several files, are deletions, failed, or are cut off."""
    i = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", (i % 5).alias("k"), F.regexp_replace("text", "[^a-z ]", "").alias("t"))
    k, name = F.col("k"), lambda c: F.concat(F.lit(c), _text("doc_id"))
    js = lambda *c: F.to_json(F.struct(*c))
    entry = lambda kind, *c: js(F.lit(kind).alias("type"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.struct(*c).alias("payload"))
    change = lambda kind, **c: F.struct(F.lit(kind).alias("type"), *(v.alias(n) for n, v in c.items()))
    add, gone = change("add", content=F.col("t")), change("delete", content=F.col("t"))
    patch = lambda changes: entry("event_msg", F.lit("patch_apply_end").alias("type"), name("a").alias("call_id"), F.lit(True).alias("success"), changes.alias("changes"))
    added = F.when(k == 2, patch(F.create_map(F.lit("new.py"), add, F.lit("b.py"), add))).when(k == 4, patch(F.create_map(F.lit("new.py"), gone))).otherwise(patch(F.create_map(F.lit("new.py"), add)))
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@ def f\n same\n-old\n+"), F.col("t"), F.when(i % 7 == 2, "").otherwise("\n+more"), F.lit("\n"))
    item = F.struct(F.lit("FileChange").alias("type"), name("u").alias("id"), F.when(i % 7 == 1, "declined").otherwise("completed").alias("status"), F.create_map(F.lit("x.py"), change("update", unified_diff=diff, move_path=F.lit("moved.py"))).alias("changes"))
    updated = entry("event_msg", F.lit("item_completed").alias("type"), name("s").alias("thread_id"), item.alias("item"))
    header = entry("session_meta", F.when(k == 3, "other").otherwise(name("s")).alias("id"), F.lit("/work").alias("cwd"))
    rows = docs.select(name("s").alias("session_id"), _told(header, added, F.lit("{broken"), updated)).select("session_id", "l.line", "l.entry")
    return transcripts.event_edits(rows).select("session_id", "id", "file_path", F.md5("text").alias("text"), "reason")


@query("t09_captured_edges", ctes("edges") + "SELECT repo, count(*) AS edges FROM (SELECT DISTINCT repo, commit_sha, session_id FROM edges) GROUP BY repo")
def captured_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of line items delivers every edge several times; each is stored once."""
    lines = streams.source(spark, sf_dir, "lineitem")
    found = lines.select(F.concat(F.lit("repo"), _text(F.col("l_suppkey") % 20)).alias("repo"), F.col("l_partkey").alias("commit_sha"), F.col("l_suppkey").alias("session_id"))
    return streams.captured(found, ["repo", "commit_sha", "session_id"]).groupBy("repo").agg(F.count("*").alias("edges"))


@query("s30_noted_sessions", """WITH n AS (SELECT l_orderkey AS commit_sha, 't' || (l_linenumber % 2) AS tool, 's' || l_suppkey AS session_id FROM lineitem WHERE l_suppkey % 9 <> 0) SELECT DISTINCT commit_sha, tool, session_id FROM n""")
def noted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.struct(F.concat(F.lit("t"), _text(F.col("l_linenumber") % 2)).alias("tool"), F.when(F.col("l_suppkey") % 9 == 0, " ").otherwise(F.concat(F.lit("s"), _text("l_suppkey"))).alias("session_id"))
    payload = F.to_json(F.struct(F.lit(1).alias("version"), F.array(session).alias("sessions")))
    notes = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit_sha")).agg(F.concat(F.array_join(F.collect_list(payload), "\n"), F.lit("\n{broken")).alias("note"))
    return capture.noted_sessions(notes)


# --- diffs and texts -----------------------------------------------------------


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hash_, i = F.md5("text"), _text("item_id")
    diff = F.concat(
        F.lit("diff --git a/a"), i, F.lit(".py b/a"), i, F.lit(".py\n--- a/a"), i, F.lit(".py\n+++ b/a"), i, F.lit(".py\n@@ -1,2 +1,2 @@\n-old\n+"), hash_, F.lit("\n same\ndiff --git a/gone"), i, F.lit(" b/gone"), i, F.lit("\n--- a/gone"), i, F.lit("\n+++ /dev/null\n@@ -1 +0,0 @@\n-x"),
    )
    return _table(spark, sf_dir, "benchmark").select("item_id", diff.alias("diff"))


@query("x23_diff_sections", "SELECT item_id, 0 AS position, 'a' || item_id || '.py' AS path, md5(text) AS added FROM benchmark UNION ALL SELECT item_id, 1, 'gone' || item_id, '' FROM benchmark")
def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.diff_sections(_diffs(spark, sf_dir)).select("item_id", "position", "path", "added")


@query("x24_changed_lines", "SELECT item_id, 3 AS changed FROM benchmark")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("item_id", T.changed_lines(F.col("diff")).alias("changed"))


@query("x29_patch_paths", "SELECT item_id, concat('a', item_id, '.py,b.py') AS paths FROM benchmark")
def patch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("a"), _text("item_id"), F.lit(".py"))
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: "), own, F.lit("\n@@\n-x\n *** Add File: no.py\n*** Add File: b.py\n+z\n*** Delete File: "), own)
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.patch_paths(patch), ",").alias("paths"))


@query("x31_digests", """SELECT o_orderkey, sha256(concat('{"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}')) AS digest FROM orders""")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", rows_out.digest("o_custkey", "o_orderstatus").alias("digest"))


@query("x32_line_delta", """WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n FROM documents WHERE text <> '')
SELECT doc_id, n // 5 AS added, n // 7 AS removed FROM w""")  # fmt: skip
def line_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a document as lines with their places, without every seventh and with a new line after every fifth."""
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string")))
    kept = F.flatten(F.transform(placed, lambda w, i: F.concat(F.when(i % 7 == 6, F.array().cast("array<string>")).otherwise(F.array(w)), F.when(i % 5 == 4, F.array(F.concat(F.lit("new"), w))).otherwise(F.array().cast("array<string>")))))
    docs = _table(spark, sf_dir, "documents").where("text <> ''")
    delta = T.line_delta(F.array_join(placed, "\n"), F.array_join(kept, "\n"))
    return docs.select("doc_id", delta.alias("d")).select("doc_id", "d.added", "d.removed")


@query("w16_external_deltas", """WITH e AS (SELECT doc_id AS call_id, source AS session_id, 'f' || (doc_id % 10) AS file_path, n_chars % 60 + 5 AS n, doc_id % 11 = 3 AS blind FROM documents WHERE doc_id % 9 <> 4),
x AS (SELECT *, lead(n) OVER w AS m FROM e WINDOW w AS (PARTITION BY session_id, file_path ORDER BY call_id))
SELECT session_id, file_path, call_id, CASE WHEN m IS NULL THEN 1 ELSE greatest(m - n, 0) END AS added, CASE WHEN m IS NULL THEN 0 ELSE 2 + greatest(n - m, 0) END AS removed FROM x WHERE NOT blind AND (m IS NOT NULL OR file_path <> 'f7')""")  # fmt: skip
def external_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first two lines are gone at the next edit, some edits rejected and some with an unknown outcome; the last state has a line more."""
    i = F.col("doc_id")
    lines = lambda a, n: F.array_join(F.transform(F.sequence(F.lit(a), n), lambda k: F.concat(F.lit("L"), k.cast("string"))), "\n")
    n = (F.col("n_chars") % 60 + 5).cast("int")
    path = F.concat(F.lit("f"), _text(i % 10))
    edits = _table(spark, sf_dir, "documents").select(
        F.col("source").alias("session_id"), path.alias("file_path"), i.alias("call_id"), i.alias("at"), (i % 9 != 4).alias("applied"), lines(3, n).alias("pre"), F.when(i % 11 != 3, lines(1, n)).alias("post"), lines(1, n + 1).alias("left")
    )
    last = edits.where("applied").groupBy("session_id", "file_path").agg(F.max_by("left", "call_id").alias("text"))
    return sequences.external_deltas(edits, last.where("file_path <> 'f7'"))


_GRAMS = "unnest(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)))"


@query("x04_survival", f"""WITH d AS (SELECT item_id AS id, text AS l, substr(text, 20) || ' tail' AS r FROM benchmark), a AS (SELECT id, {_GRAMS.format('l')} AS g FROM d), b AS (SELECT id, {_GRAMS.format('r')} AS g FROM d),
n AS (SELECT coalesce(x.id, y.id) AS id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT id, g, count(*) AS n FROM a GROUP BY ALL) x FULL JOIN (SELECT id, g, count(*) AS m FROM b GROUP BY ALL) y ON x.id = y.id AND x.g = y.g)
SELECT id, (sum(n + m) - sum(abs(n - m))) / sum(n + m) AS survival FROM n GROUP BY id""")  # fmt: skip
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.survival(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("left"), F.concat(F.substring("text", 20, 1 << 30), F.lit(" tail")).alias("right")))


@query("d08_merge_retention", """WITH e AS (SELECT item_id, text FROM benchmark WHERE length(text) >= 4), f AS (SELECT item_id, substr(text, 1, length(text) // 2) AS m FROM e WHERE length(text) // 2 >= 4),
g AS (SELECT item_id, unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS g FROM e), h AS (SELECT item_id, unnest(list_transform(range(1, length(m) - 2), lambda i: substr(m, i, 4))) AS g FROM f),
s AS (SELECT item_id, sum(least(n, k)) AS shared FROM (SELECT item_id, g, count(*) AS n FROM g GROUP BY ALL) JOIN (SELECT item_id, g, count(*) AS k FROM h GROUP BY ALL) USING (item_id, g) GROUP BY item_id)
SELECT item_id AS applied_id, 1e0 AS at_head, coalesce(shared, 0) / (length(text) - 3) AS at_merge FROM e LEFT JOIN s USING (item_id)""")  # fmt: skip
def merge_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").where("char_length(text) >= 4")
    path = F.concat(F.lit("f"), _text("item_id"))
    edits = items.select(F.col("item_id").alias("applied_id"), F.col("text").alias("applied"), path.alias("path"), F.lit(1).alias("merge_id"))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))
    blobs = items.select(F.lit("h").alias("commit_sha"), path.alias("path"), F.col("text").alias("file")).unionAll(items.select(F.lit("m"), path, half))
    merges = spark.createDataFrame([(1, "h", "m")], "merge_id int, head_sha string, merge_commit_sha string")
    return derivations.merge_retention(edits, blobs, merges).select("applied_id", "at_head", "at_merge")


# --- statistics -----------------------------------------------------------------

_RATES = "WITH r AS (SELECT event_type AS model, count(*)::double AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::double AS s FROM events GROUP BY 1), p AS (SELECT *, s / n AS p FROM r)"
_ZB, _Z90 = NORMAL.inv_cdf(0.8), NORMAL.inv_cdf(0.95)


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("s"))
    return rates.withColumn("p", F.col("s") / F.col("n"))


@query("x13_required_trials", _RATES + f""", q AS (SELECT *, p + 0.05::double AS q, (2 * p + 0.05::double) / 2 AS m FROM p), t AS (SELECT *, {Z95!r}::double * sqrt(2 * m * (1 - m)) + {_ZB!r}::double * sqrt(p * (1 - p) + q * (1 - q)) AS t FROM q WHERE p > 0 AND q < 1)
SELECT model, ceil(t * t / (0.05::double * 0.05::double))::bigint AS trials, ({Z95!r}::double + {_ZB!r}::double) * sqrt(2 * p * (1 - p) / n) AS detectable, ceil(ceil(t * t / (0.05::double * 0.05::double)) / (n / 30))::bigint AS days FROM t""")  # fmt: skip
def required_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir).withColumn("trials", stats.required_trials(F.col("p"), F.lit(0.05))).where("trials is not null")
    return rates.select("model", "trials", stats.detectable_effect(F.col("p"), F.col("n")).alias("detectable"), stats.required_days(F.col("trials"), F.col("n") / 30).alias("days"))


#: Two-sided p of a z by Simpson's rule over the density between -|z| and |z|.
_P = "1 - abs({z}) / 1500.0::double * list_sum(list_transform(range(0, 501), lambda i: CASE WHEN i = 0 OR i = 500 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs({z}) * i / 500.0::double, 2) / 2))) * 2 / sqrt(2 * pi())"


@query("x14_sequential_bounds", ctes("calls") + f""", d AS (SELECT model, date_trunc('week', observed_at) AS week, count(*) AS n FROM calls GROUP BY ALL), s AS (SELECT model, week, sum(n) OVER (PARTITION BY model ORDER BY week)::double / sum(n) OVER (PARTITION BY model) AS share FROM d),
b AS (SELECT *, {Z95!r}::double / sqrt(share) AS bound FROM s) SELECT model, epoch_us(week::timestamp) AS week_us, share, bound, CASE WHEN bound < 5 THEN round({_P.format(z='bound')}, 7) END AS spent FROM b""")  # fmt: skip
def sequential_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look at the end of each week may conclude about a model, by the share of its calls that are in by then."""
    from pyspark.sql import Window

    weeks = facts(spark, sf_dir, "calls").groupBy("model", F.date_trunc("week", "observed_at").alias("week")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("model")  # a row for a week
    share = F.sum("n").over(own.orderBy("week")) / F.sum("n").over(own)
    bound, spent = stats.sequential_bounds(F.col("share"))
    found = weeks.withColumn("share", share).select("model", F.unix_micros(F.col("week").cast("timestamp")).alias("week_us"), "share", bound.alias("bound"), spent.alias("spent"))
    return found.withColumn("spent", F.when(F.col("bound") < 5, F.round("spent", 7)))  # the compared rule has no digits beyond


@query("x15_non_inferiority", _RATES + f""" SELECT a.model AS "left", b.model AS "right", a.p - b.p - {_Z90!r}::double * sqrt(a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n) > -0.02::double AS non_inferior FROM p a JOIN p b ON a.model <> b.model""")
def non_inferiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir)
    a, b = (rates.select(F.col("model").alias(m), F.col("n").alias(f"n{m}"), F.col("p").alias(f"p{m}")) for m in ("left", "right"))
    both = a.join(b, F.col("left") != F.col("right"))
    error = F.sqrt(F.col("pleft") * (1 - F.col("pleft")) / F.col("nleft") + F.col("pright") * (1 - F.col("pright")) / F.col("nright"))
    return both.select("left", "right", derivations.non_inferiority(F.col("pleft") - F.col("pright"), error, 0.02).alias("non_inferior"))


@query("d21_compared_models", _RATES + f""", c AS (SELECT a.model AS "left", b.model AS "right", a.p - b.p AS difference, 2 * asin(sqrt(a.p)) - 2 * asin(sqrt(b.p)) AS h, (a.s + b.s) / (a.n + b.n) AS m, a.n AS an, b.n AS bn, a.p AS ap FROM p a JOIN p b ON a.model < b.model),
z AS (SELECT *, difference / sqrt(m * (1 - m) * (1 / an + 1 / bn)) AS z FROM c), p2 AS (SELECT *, CASE WHEN least(an, bn) >= 30 THEN {_P.format(z='z')} END AS pv FROM z), k AS (SELECT *, row_number() OVER (ORDER BY pv, "left", "right") AS i, count(pv) OVER () AS t FROM p2),
e AS (SELECT *, max(CASE WHEN pv <= i / t * 0.05::double THEN i ELSE 0 END) OVER () AS last, ap - difference AS q, (2 * ap - difference) / 2 AS mean FROM k)
SELECT "left", "right", difference, h, z, pv AS p, i <= last AS significant, CASE WHEN ap > 0 AND ap < 1 AND q > 0 AND q < 1 AND difference <> 0 THEN ceil(pow({Z95!r}::double * sqrt(2 * mean * (1 - mean)) + {_ZB!r}::double * sqrt(ap * (1 - ap) + q * (1 - q)), 2) / (difference * difference))::bigint END AS needed FROM e""")  # fmt: skip
def compared_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivations.compare_models(_rates(spark, sf_dir).withColumnRenamed("s", "successes"), "model")


@query("x09_older_confidence", """WITH d AS (SELECT l_orderkey AS call_id, max(l_discount) * 9 AS ret, bool_or(l_linestatus = 'F') AS pass FROM lineitem GROUP BY l_orderkey)
SELECT call_id, least(1e0, greatest(0e0, 0.6::double * (0.9::double + (1.1::double - 0.9::double) * least(1e0, greatest(0e0, ret))) * CASE WHEN pass THEN 1.1::double ELSE 0.7::double END)) AS confidence FROM d""")  # fmt: skip
def older_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg((F.max("l_discount") * 9).alias("ret"), F.max(F.col("l_linestatus") == "F").alias("any_pass"))
    return calls.select("call_id", unreliable_confidence(F.lit("implicit_accept"), F.col("ret"), F.col("any_pass"), F.lit(None).cast("double")).alias("confidence"))


@query("w15_overlapping_prices", """WITH p AS (SELECT p_type AS model, TIMESTAMP '1992-01-01' + to_months(p_size) AS valid_from, TIMESTAMP '1992-01-01' + to_months(p_size + 1 + p_partkey::integer % 3) AS valid_until, p_partkey FROM part),
o AS (SELECT *, lag(valid_until) OVER w AS b, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY model ORDER BY valid_from, valid_until, p_partkey)) SELECT model, count(*) AS overlaps FROM o WHERE i > 1 AND valid_from < b GROUP BY model""")  # fmt: skip
def overlapping_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestamp'1992-01-01' + make_interval(0, p_size)")
    prices = _table(spark, sf_dir, "part").select(F.col("p_type").alias("model"), start.alias("valid_from"), F.expr("timestamp'1992-01-01' + make_interval(0, p_size + 1 + cast(p_partkey as int) % 3)").alias("valid_until"))
    return attachment.overlapping_prices(prices).groupBy("model").agg(F.count("*").alias("overlaps"))


@query("d24_relation_faults", """WITH again AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0 UNION ALL SELECT o_orderkey + 1000000 FROM orders WHERE o_orderkey % 70 = 0)
SELECT 'written' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT o_orderkey FROM again) UNION ALL SELECT 'derived', o_orderkey FROM (SELECT o_orderkey FROM again EXCEPT ALL SELECT o_orderkey FROM orders)""")  # fmt: skip
def relation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    again = orders.where("o_orderkey % 50 <> 0").unionAll(orders.where("o_orderkey % 70 = 0").select(F.col("o_orderkey") + 1_000_000))
    return rows_out.relation_faults(orders, again)


@query("k06_preference_consumer", """SELECT a.conv_id, concat('[{"role":"user","content":"', a.turn, '"}]') AS prompt FROM conversations a WHERE role = 'user'""")
def preference_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = facts(spark, sf_dir, "turns").where("role = 'user'").select("session_id", _text("turn").alias("prompt"), F.lit("yes").alias("chosen_text"), F.lit("no").alias("rejected_text"))
    return rows_out.preference_consumer(turns, ["session_id"]).select(F.col("session_id").alias("conv_id"), F.to_json("prompt").alias("prompt"))
