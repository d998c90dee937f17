"""Captured payloads (JSON texts) as fact rows: gateway calls, OTLP log records, forge webhooks, commit notes.

A payload that can't be read gives no row; the partition functions count those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOOL = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
_MESSAGE = f"struct<role:string,content:string,tool_calls:{_TOOL}>"
_GATEWAY = (
    f"model string, litellm_call_id string, messages array<{_MESSAGE}>, response struct<id:string,output_text:string,choices:array<struct<text:string,finish_reason:string,message:{_MESSAGE}>>,"
    "output:array<struct<type:string,role:string,call_id:string,name:string,arguments:string,content:array<struct<type:string,text:string>>,summary:array<struct<text:string>>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint>, prompt_tokens bigint, completion_tokens bigint, "
    "response_time_ms double, response_time double, metadata struct<session_id:string,user_id:string>, end_user string"
)


def _parts(m: Column) -> Column:
    """Parts of a chat message: its text, then its tool calls."""
    empty = F.lit(None).cast("string")
    text = F.struct(F.lit("text").alias("type"), m["content"].alias("content"), empty.alias("id"), empty.alias("name"), empty.alias("arguments"), empty.alias("result"))
    tool = lambda t: F.struct(F.lit("tool_call").alias("type"), empty.alias("content"), t["id"].alias("id"), t["function"]["name"].alias("name"), t["function"]["arguments"].alias("arguments"), empty.alias("result"))
    said = F.when(m["content"].isNotNull() & (m["content"] != ""), F.array(text)).otherwise(F.array().cast("array<struct<type:string,content:string,id:string,name:string,arguments:string,result:string>>"))
    return F.concat(said, F.coalesce(F.transform(m["tool_calls"], tool), F.array().cast("array<struct<type:string,content:string,id:string,name:string,arguments:string,result:string>>")))


def _message(m: Column, finish: Column) -> Column:
    return F.struct(m["role"].alias("role"), finish.alias("finish_reason"), _parts(m).alias("parts"))


_NO_PARTS = "array<struct<type:string,content:string,id:string,name:string,arguments:string,result:string>>"


def _output_items(items: Column) -> Column:
    """Parts of a response's output items: texts of messages, reasoning summaries, function calls, in their order."""
    empty = F.lit(None).cast("string")
    said = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"), empty.alias("id"), empty.alias("name"), empty.alias("arguments"), empty.alias("result"))
    call = lambda i: F.struct(F.lit("tool_call").alias("type"), empty.alias("content"), i["call_id"].alias("id"), i["name"].alias("name"), i["arguments"].alias("arguments"), empty.alias("result"))
    texts = lambda kind, parts: F.transform(F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != ""), lambda p: said(kind, p["text"]))
    none = F.array().cast(_NO_PARTS)
    each = lambda i: F.coalesce(F.when(i["type"] == "message", texts("text", i["content"])).when(i["type"] == "reasoning", texts("reasoning", i["summary"])).when(i["type"] == "function_call", F.array(call(i))), none)
    return F.flatten(F.transform(items, each))


def session_identity(metadata: Column, identity: Column, header: Column) -> Column:
    """First non-empty of: the metadata's session, a JSON identity's session_id, a trailing session_<uuid> of the identity, a header."""
    trailing = F.regexp_extract(identity, r"session_([0-9a-f]{8}-[0-9a-f-]{27})$", 1)
    found = [metadata, F.get_json_object(identity, "$.session_id"), trailing, header]
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in found))


def gateway_calls(raw: DataFrame, payload: str = "payload", observed_at: str = "observed_at", header: str | None = None) -> DataFrame:
    """Inference calls of gateway payloads; a payload without a session gives none. ``header``: a column with the session that the harness sent beside it.

    Output: the first choice's message, else its text, else the response's output items, else its text. Tokens: usage, else the response's usage, else the top level. Latency: milliseconds, else
    seconds times 1000. Key: the gateway's call id, else the response's id.
    """
    p = raw.select("*", F.explode(F.array(F.from_json(payload, _GATEWAY))).alias("_p"))  # in a generator: parsed once, whatever filters on its fields follow
    choice = F.get(F.col("_p.response.choices"), 0)
    none = F.lit(None).cast("string")
    output = F.when(choice["message"].isNotNull(), F.array(_message(choice["message"], choice["finish_reason"]))).when(
        choice["text"].isNotNull(), F.array(_message(F.struct(F.lit("assistant").alias("role"), choice["text"].alias("content"), F.lit(None).cast(_TOOL).alias("tool_calls")), choice["finish_reason"]))
    )
    items = F.col("_p.response.output")
    output = output.when(items.isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), none.alias("finish_reason"), _output_items(items).alias("parts")))).when(
        F.col("_p.response.output_text").isNotNull(),
        F.array(_message(F.struct(F.lit("assistant").alias("role"), F.col("_p.response.output_text").alias("content"), F.lit(None).cast(_TOOL).alias("tool_calls")), none)),
    )
    tokens = lambda k: F.coalesce(F.col(f"_p.usage.{k}"), F.col(f"_p.response.usage.{k}"), F.col(f"_p.{k}"))
    session = session_identity(F.col("_p.metadata.session_id"), F.coalesce("_p.metadata.user_id", "_p.end_user"), F.col(header) if header else none)
    milliseconds = F.coalesce("_p.response_time_ms", F.col("_p.response_time") * 1000)
    out = p.select(
        session.alias("session_id"), F.regexp_replace(F.coalesce("_p.metadata.user_id", "_p.end_user"), r"_?session_[0-9a-f-]{36}$", "").alias("user_id"), F.col("_p.model").alias("model"),
        F.transform("_p.messages", lambda m: _message(m, none)).alias("input_messages"), output.alias("output_messages"), tokens("prompt_tokens").alias("input_tokens"), tokens("completion_tokens").alias("output_tokens"),
        F.when(milliseconds.between(0, 9.2e18), F.round(milliseconds).cast("long")).alias("duration_ms"), F.coalesce("_p.litellm_call_id", "_p.response.id").alias("model_call_id"), F.col(observed_at).alias("observed_at"), F.col(payload).alias("raw"),
    )
    return out.where("session_id is not null")


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_OTLP = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,body:{_VALUE},attributes:{_ATTRIBUTES}>>>>>>"
)


def _unwrapped(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _map(attributes: Column) -> Column:
    """Attributes as a map; the last value of a key counts, a null key names nothing.

    Entries are told apart by one sort at most, and not at all where all keys differ. The lambdas over one-element arrays name a value that is used several times:
    Spark computes an expression inside a lambda again for each use.
    """
    own = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull())
    entries = F.transform(own, lambda a: F.struct(a["key"].alias("key"), _unwrapped(a["value"]).alias("text")))
    keys = lambda es: F.transform(es, lambda e: e["key"])
    ordered = lambda es: F.array_sort(F.transform(es, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["text"].alias("text"))))
    last = lambda es: F.transform(F.array(ordered(es)), lambda o: F.map_from_entries(F.transform(F.filter(o, lambda e, i: F.coalesce(F.get(o, i + 1)["key"] != e["key"], F.lit(True))), lambda e: F.struct(e["key"], e["text"]))))[0]
    return F.transform(F.array(entries), lambda es: F.when(F.size(F.array_distinct(keys(es))) == F.size(es), F.map_from_entries(es)).otherwise(last(es)))[0]


def _event(record: Column) -> Column:
    """A record's event: its body, else its own attribute of that name."""
    named = F.filter(record["attributes"], lambda a: a["key"] == "event.name")
    return F.coalesce(_unwrapped(record["body"]), _unwrapped(F.try_element_at(named, F.lit(-1))["value"]))


def otlp_records(raw: DataFrame, batch: str = "batch_id", payload: str = "payload") -> DataFrame:
    """(batch, position, event, attributes, occurred_at): the log records of OTLP batches, resource attributes under the record's own. No event time: null.

    Payloads are parsed and attributes mapped inside the generators, so a filter on a record or several uses of its attributes don't compute them again.
    """
    logs = raw.select(batch, F.explode(F.from_json(payload, _OTLP)["resourceLogs"]).alias("r"))
    scopes = logs.select(batch, F.coalesce(F.col("r.resource.attributes"), F.array().cast(_ATTRIBUTES)).alias("res"), F.explode("r.scopeLogs").alias("s"))

    def record(r: Column) -> Column:
        nanos = r["timeUnixNano"].cast("long")
        merged = _map(F.concat(F.col("res"), F.coalesce(r["attributes"], F.array().cast(_ATTRIBUTES))))
        return F.struct(_event(r).alias("event"), merged.alias("attributes"), F.when(nanos > 0, F.timestamp_micros(F.floor(nanos / 1000).cast("long"))).alias("occurred_at"))

    records = scopes.select(batch, F.posexplode(F.transform("s.logRecords", record)).alias("position", "l"))
    return records.select(batch, "position", "l.event", "l.attributes", "l.occurred_at")


EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "apply_patch", "edit", "write")


def otlp_decisions(records: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Developer decisions of ``*tool_decision`` records; the path is joined from the last ``*tool_result`` of the same call in the batch.

    Not an edit tool, an unknown verdict, no session or no event time: no row. A missing path is '' and never drops the row. A patch's decision gives a row for each of its files.
    """
    from ..functions.text import patch_paths

    a = F.col("attributes")
    tool, call = F.coalesce(a["tool_name"], a["tool"]), F.coalesce(a["tool_use_id"], a["call_id"])
    verdict = F.lower(a["decision"])
    is_result = F.col("event").endswith("tool_result")
    is_decision = F.col("event").endswith("tool_decision") & tool.isin(*EDIT_TOOLS) & verdict.isin("accept", "accepted", "reject", "rejected", "approved", "denied") & a["session.id"].isNotNull() & F.col("occurred_at").isNotNull()
    result = F.struct("position", F.coalesce(a["file_path"], F.get_json_object(a["tool_parameters"], "$.file_path")).alias("path"), a["arguments"].alias("patch"))
    decision = F.struct(
        a["session.id"].alias("session_id"), F.coalesce(a["agent"], a["service.name"]).alias("agent_harness"), verdict.isin("accept", "accepted", "approved").alias("accepted"),
        F.coalesce(a["explicit"].cast("boolean"), F.lower(a["source"]).isin("user", "user_permanent", "user_temporary", "user_reject"), F.lit(False)).alias("explicit"), a["file_path"].alias("own_path"), "occurred_at",
    )
    # one pass over the records: a call's decisions in a batch are no more than the batch's payload holds
    marked = records.where(is_result | is_decision).select(batch, call.alias("call_id"), F.when(is_result, result).alias("r"), F.when(is_decision, decision).alias("d"))
    calls = marked.groupBy(batch, "call_id").agg(F.max("r").alias("r"), F.collect_list("d").alias("d"))
    joined = calls.select("call_id", F.when(F.col("call_id").isNotNull(), F.col("r")).alias("r"), F.explode("d").alias("d")).select("call_id", "r", "d.*")
    paths = F.coalesce(F.filter(patch_paths(F.col("r.patch")), lambda p: p != ""), F.array().cast("array<string>"))
    fanned = F.when(F.size(paths) > 0, paths).otherwise(F.array(F.coalesce("own_path", "r.path", F.lit(""))))
    return joined.select("session_id", "agent_harness", "call_id", "accepted", "explicit", F.explode(fanned).alias("file_path"), "occurred_at")


def otlp_partition(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: translated, untranslated and malformed batches and records. Each payload is parsed once; one without records keeps a row without a place."""
    logs = raw.select(F.explode_outer(F.array(F.from_json(payload, _OTLP)["resourceLogs"])).alias("logs"))
    scopes = logs.select(F.col("logs").isNull().alias("bad"), F.explode_outer("logs").alias("r")).select("bad", F.explode_outer("r.scopeLogs").alias("s"))
    records = scopes.select("bad", F.posexplode_outer(F.transform("s.logRecords", _event)).alias("position", "event"))
    known, real = F.coalesce(F.col("event").endswith("tool_decision") | F.col("event").endswith("tool_result"), F.lit(False)), F.col("position").isNotNull()
    return records.agg(F.count_if(known & real).alias("translated"), F.count_if(~known & real).alias("untranslated"), F.count_if("bad").alias("malformed"))


def _edit_records(records: DataFrame, event: str, texts: list[str]) -> DataFrame:
    """Records of one kind of edit event with its texts (of any length, which may be empty); without a session, call, path, agent or event time there is no row."""
    a = F.col("attributes")
    own = records.where(F.col("event").endswith(event)).select(
        F.coalesce(F.nullif(a["session.id"], F.lit("")), a["session_id"]).alias("session_id"), a["agent"].alias("agent_harness"), F.coalesce(a["tool_use_id"], a["call_id"]).alias("call_id"), F.nullif(a["file_path"], F.lit("")).alias("file_path"),
        *(a[t].alias(t) for t in texts), a["external_lines_added"].cast("long").alias("external_lines_added"), a["external_lines_removed"].cast("long").alias("external_lines_removed"), "occurred_at",
    )
    known = F.lit(True)
    for c in ("session_id", "agent_harness", "call_id", "file_path", "occurred_at", *texts):
        known &= F.col(c).isNotNull()
    return own.where(known)


def edit_observations(records: DataFrame) -> DataFrame:
    """Pairs of an applied text and the file as it was found later, with the lines changed outside (null where they aren't counts)."""
    found = _edit_records(records, "edit_observation", ["applied_text", "observed_file_text"])
    count = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return found.select(*(c for c in found.columns if not c.startswith("external")), count("external_lines_added"), count("external_lines_removed"))


def rejected_edits(records: DataFrame) -> DataFrame:
    """Edits that the developer refused, with the text proposed."""
    return _edit_records(records, "rejected_edit", ["proposed"]).drop("external_lines_added", "external_lines_removed")


def retry_linkages(records: DataFrame) -> DataFrame:
    """(session_id, agent_harness, file_path, tool_name, rejected_call_id, accepted_call_id, occurred_at, reason): linked retries, or why a record is none (the first reason in order)."""
    a = F.col("attributes")
    own = records.where(F.col("event").endswith("retry_linkage")).select(
        F.nullif(F.coalesce(a["session.id"], a["session_id"]), F.lit("")).alias("session_id"), F.nullif(a["agent"], F.lit("")).alias("agent_harness"), F.nullif(a["file_path"], F.lit("")).alias("file_path"), F.nullif(a["tool_name"], F.lit("")).alias("tool_name"),
        F.nullif(a["rejected_call_id"], F.lit("")).alias("rejected_call_id"), F.nullif(a["accepted_call_id"], F.lit("")).alias("accepted_call_id"), "occurred_at",
    )
    reason = F.lit(None).cast("string")
    for column, name in reversed([("session_id", "missing_session"), ("agent_harness", "missing_agent_harness"), ("file_path", "missing_file_path"), ("tool_name", "missing_tool_name"), ("rejected_call_id", "missing_rejected_call_id"), ("accepted_call_id", "missing_accepted_call_id"), ("occurred_at", "missing_event_time")]):
        reason = F.when(F.col(column).isNull(), name).otherwise(reason)
    bad = F.when(~F.col("agent_harness").isin(*HARNESSES), "invalid_agent_harness").when(~F.col("tool_name").isin("Edit", "Write"), "invalid_tool_name")
    return own.withColumn("reason", F.coalesce(reason, bad))


#: The agent harnesses that facts name.
HARNESSES = ("claude-code", "copilot", "codex", "cursor", "pi")

_WORKFLOW = (
    "action string, workflow_run struct<id:bigint,name:string,path:string,workflow_id:bigint,head_branch:string,head_sha:string,run_attempt:bigint,conclusion:string,html_url:string,"
    "pull_requests:array<struct<number:bigint>>>, repository struct<id:bigint,full_name:string>"
)
#: The forge's conclusions and the results they stand for; others are unknown and kept as the provider's result.
CONCLUSIONS = {"success": "passed", "failure": "failed", "cancelled": "cancelled", "timed_out": "timed_out", "skipped": "skipped", "neutral": "neutral"}


def workflow_outcomes(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """CI outcomes of completed workflow_run webhooks; without a commit, branch or run there is none."""
    p = raw.select(F.from_json(payload, _WORKFLOW).alias("p"), captured_at).where("p.action = 'completed'")
    result = F.lit("unknown")
    for conclusion, name in CONCLUSIONS.items():
        result = F.when(F.col("p.workflow_run.conclusion") == conclusion, name).otherwise(result)
    w = "p.workflow_run"
    out = p.select(
        F.col(f"{w}.id").cast("string").alias("run_id"), F.col(f"{w}.run_attempt").alias("run_attempt"), F.lower("p.repository.full_name").alias("repo"), F.lower(f"{w}.head_sha").alias("commit_sha"), F.col(f"{w}.head_branch").alias("branch"),
        result.alias("result"), F.col(f"{w}.name").alias("workflow_name"), F.col(f"{w}.workflow_id").cast("string").alias("workflow_id"), F.col(f"{w}.path").alias("workflow_path"), F.col(f"{w}.html_url").alias("run_url"), F.col(f"{w}.conclusion").alias("provider_result"),
        F.when(F.size(f"{w}.pull_requests") == 1, F.get(F.col(f"{w}.pull_requests"), 0)["number"]).alias("pr_number"), F.col("p.repository.id").cast("string").alias("repository_id"), captured_at,
    )
    return out.where(F.col("commit_sha").rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$") & F.col("branch").isNotNull() & F.col("run_id").isNotNull())


def push_facts(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """Pushes of push webhooks."""
    schema = "ref string, before string, after string, forced boolean, repository struct<id:bigint,full_name:string,clone_url:string>"
    p = raw.select(F.from_json(payload, schema).alias("p"), captured_at)
    out = p.select(F.lower("p.repository.full_name").alias("repo"), F.col("p.repository.clone_url").alias("clone_url"), F.col("p.ref").alias("ref"), F.lower("p.before").alias("before_sha"), F.lower("p.after").alias("after_sha"), F.coalesce("p.forced", F.lit(False)).alias("forced"), F.col("p.repository.id").cast("string").alias("repository_id"), captured_at)
    sha = "^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
    return out.where(F.col("repo").isNotNull() & F.col("ref").isNotNull() & F.col("before_sha").rlike(sha) & F.col("after_sha").rlike(sha))


def noted_sessions(notes: DataFrame, note: str = "note") -> DataFrame:
    """(commit_sha, tool, session_id) of commit notes: one or more JSON payloads, a line each; the first of a (tool, session) counts."""
    lines = notes.select("commit_sha", F.posexplode(F.split(note, "\n")).alias("line", "text"))
    sessions = lines.select("commit_sha", "line", F.from_json("text", "version int, sessions array<struct<tool:string,session_id:string>>").alias("p")).where("p.version = 1")
    each = sessions.select("commit_sha", "line", F.explode("p.sessions").alias("s")).where("trim(s.session_id) <> ''")
    return each.select("commit_sha", "s.tool", "s.session_id").distinct()


def unquoted(path: Column) -> Column:
    """A path as Git quotes it in C style: escapes of bytes in octal and of some letters, read as UTF-8. A path without a backslash is as it is."""
    token = F.regexp_extract_all(path, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    letters = F.create_map(*(F.lit(x) for pair in (("a", "07"), ("b", "08"), ("t", "09"), ("n", "0A"), ("v", "0B"), ("f", "0C"), ("r", "0D")) for x in pair))
    bytes_of = lambda t: F.when(t.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 2, "0")).when(
        t.startswith("\\"), F.coalesce(F.try_element_at(letters, F.substring(t, 2, 1)), F.hex(F.encode(F.substring(t, 2, 9), "UTF-8")))
    ).otherwise(F.hex(F.encode(t, "UTF-8")))
    return F.when(F.contains(path, F.lit("\\")), F.decode(F.unhex(F.array_join(F.transform(token, bytes_of), "")), "UTF-8")).otherwise(path)


def hunks_fit(body: Column) -> Column:
    """Whether the hunks of a section (its text from the first ``@@``) hold as many old and new lines as their headers say, and nothing else."""
    state = lambda old, new, bad: F.struct(old.cast("int").alias("old"), new.cast("int").alias("new"), bad.alias("bad"))
    head = r"^@@ -[0-9]+(?:,([0-9]+))? [+][0-9]+(?:,([0-9]+))? @@(?: .*)?$"
    count = lambda line, k: F.coalesce(F.nullif(F.regexp_extract(line, head, k), F.lit("")), F.lit("1")).cast("int")
    inside = lambda a: (a["old"] > 0) | (a["new"] > 0)
    step = lambda a, line: (
        F.when(line.startswith("@@"), state(count(line, 1), count(line, 2), a["bad"] | inside(a) | ~line.rlike(head)))
        .when(line.startswith("\\ "), a).when(~inside(a), state(a["old"], a["new"], a["bad"] | (line != "")))
        .when(line.startswith("+"), state(a["old"], a["new"] - 1, a["bad"])).when(line.startswith("-"), state(a["old"] - 1, a["new"], a["bad"]))
        .otherwise(state(a["old"] - 1, a["new"] - 1, a["bad"] | ~(line.startswith(" ") | (line == ""))))
    )
    return F.aggregate(F.split(body, "\n", -1), state(F.lit(0), F.lit(0), F.lit(False)), step, lambda a: ~a["bad"] & (a["old"] == 0) & (a["new"] == 0))


def diff_sections(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """(other columns, position, path, patch, added, reason): the file sections of unified diffs; added: text of added lines. A deleted file keeps its old path.

    reason: ``malformed_diff_section`` where hunks don't fit their headers or no path is told, ``unsupported_diff_section`` for combined diffs; null for a section to use.
    """
    keep = [c for c in diffs.columns if c != diff]
    parts = diffs.select(*keep, F.posexplode(F.filter(F.split(diff, r"(?m)^(?=diff --(?:git|cc|combined) )"), lambda s: s.startswith("diff --"))).alias("position", "patch"))
    told = lambda mark, side: F.coalesce(F.nullif(unquoted(F.regexp_extract("patch", rf'(?m)^{mark} "{side}/((?:[^"\\]|\\.)*)"\t?$', 1)), F.lit("")), F.regexp_extract("patch", rf"(?m)^{mark} {side}/(.*?)\t?$", 1))
    new, old = told(r"\+\+\+", "b"), told("---", "a")
    named = F.regexp_extract("patch", r'^diff --git "?a/.*? "?b/(.*?)"?(?:\n|$)', 1)
    body = F.when(F.contains("patch", F.lit("\n@@")), F.regexp_replace("patch", r"(?s)^.*?\n(?=@@)", "")).otherwise(F.lit(""))
    added = F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^\+(.*)$"), F.lit(1)), "\n")
    path = F.when(new != "", new).when(old != "", old).otherwise(named)
    reason = F.when(~F.startswith("patch", F.lit("diff --git ")), "unsupported_diff_section").when((path == "") | ~hunks_fit(body), "malformed_diff_section")
    return parts.select(*keep, "position", path.alias("path"), "patch", added.alias("added"), reason.alias("reason"))


_SHA = "^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
_END = "struct<ref:string,sha:string,repo:struct<id:bigint,full_name:string>>"
_REQUEST = f"action string, number bigint, before string, after string, repository struct<id:bigint,full_name:string>, pull_request struct<number:bigint,merged:boolean,merged_at:string,merge_commit_sha:string,head:{_END},base:{_END}>"


def _boundary(raw: DataFrame, payload: str, captured_at: str) -> DataFrame:
    """The two ends of pull-request webhooks; ``complete`` tells whether every part of the boundary is there and well formed."""
    p = raw.select(F.from_json(payload, _REQUEST).alias("p"), captured_at)
    r = "p.pull_request"
    sha = lambda c: F.lower(c)
    out = p.select(
        F.col("p.action").alias("action"), F.lower("p.repository.full_name").alias("repo"), F.col("p.repository.id").cast("string").alias("repository_id"), F.col(f"{r}.number").alias("pr_number"), F.lower(f"{r}.head.repo.full_name").alias("head_repo"),
        F.col(f"{r}.head.ref").alias("head_ref"), sha(f"{r}.head.sha").alias("head_sha"), F.col(f"{r}.base.ref").alias("base_ref"), sha(f"{r}.base.sha").alias("base_sha"), sha(f"{r}.merge_commit_sha").alias("merge_commit_sha"),
        F.col(f"{r}.merged").alias("merged"), F.when(F.col(f"{r}.merged_at").rlike("(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(f"{r}.merged_at")).alias("merged_at"), sha("p.before").alias("before"), sha("p.after").alias("after"), captured_at,
    )
    named = (F.col("repo") != "") & (F.col("head_repo") != "") & (F.col("pr_number") > 0) & (F.col("head_ref") != "") & (F.col("base_ref") != "")
    return out.withColumn("complete", F.coalesce(named & F.col("head_sha").rlike(_SHA) & F.col("base_sha").rlike(_SHA), F.lit(False)))


def pull_request_merges(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """Merges of closed pull requests that were merged; an incomplete boundary, or a moment without a zone, gives none."""
    ends = _boundary(raw, payload, captured_at).where("action = 'closed' and merged and complete")
    return ends.where(F.col("merge_commit_sha").rlike(_SHA) & F.col("merged_at").isNotNull()).drop("action", "merged", "before", "after", "complete")


def pull_request_revisions(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """Heads of opened and synchronized pull requests with ``previous_head_sha``, and ``reason`` where a payload is none: unsupported_action, head_repository_deleted, invalid_boundary, synchronize_head_mismatch."""
    ends = _boundary(raw, payload, captured_at)
    pushed = F.col("action") == "synchronize"
    chain = F.coalesce(F.col("before").rlike(_SHA) & F.col("after").rlike(_SHA), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("action").isin("opened", "synchronize"), F.lit(False)), "unsupported_action").when(F.col("head_repo").isNull(), "head_repository_deleted")
        .when(pushed & chain & (F.col("after") != F.col("head_sha")), "synchronize_head_mismatch").when(~F.col("complete") | (pushed & ~chain), "invalid_boundary")
    )
    return ends.select("repo", "repository_id", "pr_number", "head_repo", "head_ref", "head_sha", "base_ref", "base_sha", F.when(pushed, F.col("before")).alias("previous_head_sha"), captured_at, reason.alias("reason"))


def repository_renames(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """(repository_id, old_repo, new_repo, captured_at) of rename webhooks that change the name."""
    schema = "action string, changes struct<repository:struct<name:struct<`from`:string>>>, repository struct<id:bigint,full_name:string>"
    p = raw.select(F.from_json(payload, schema).alias("p"), captured_at).where("p.action = 'renamed'")
    new = F.lower("p.repository.full_name")
    old = F.concat(F.split_part(new, F.lit("/"), F.lit(1)), F.lit("/"), F.lower(F.col("p.changes.repository.name.from")))
    return p.select(F.col("p.repository.id").cast("string").alias("repository_id"), old.alias("old_repo"), new.alias("new_repo"), captured_at).where("repository_id is not null and old_repo <> new_repo and new_repo like '%/%'")


def vendor_outcomes(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """CI outcomes that a pipeline posts itself, with ``reason`` where one is refused: malformed, missing_repo, invalid_commit, partial_identity, unknown_result."""
    schema = "provider string, run_id string, run_attempt bigint, repo string, repository_provider string, repository_host string, repository_id string, commit_sha string, branch string, result string, workflow_name string, workflow_id string, workflow_path string"
    p = raw.select(F.from_json(payload, schema).alias("p"), captured_at).select("p.*", captured_at)
    identity = F.size(F.array_compact(F.array("repository_provider", "repository_host", "repository_id")))
    reason = (
        F.when(F.col("run_id").isNull() | F.col("branch").isNull(), "malformed").when(F.coalesce("repo", F.lit("")) == "", "missing_repo").when(~F.coalesce(F.lower("commit_sha").rlike(_SHA), F.lit(False)), "invalid_commit")
        .when(identity.isin(1, 2), "partial_identity").when(~F.coalesce(F.col("result").isin("passed", "failed", "error", "timed_out", "cancelled", "skipped", "neutral", "unknown"), F.lit(False)), "unknown_result")
    )
    return p.withColumns({"repo": F.lower("repo"), "commit_sha": F.lower("commit_sha"), "reason": reason})


def compute_allocations(raw: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """(session_id, allocation_source, cpu_millicores, memory_bytes, occurred_at, captured_at) of posted allocations; one without a session, a source or a moment gives none, nor does one with a negative size."""
    schema = "session_id string, allocation_source string, cpu_millicores bigint, memory_bytes bigint, occurred_at string"
    p = raw.select(F.from_json(payload, schema).alias("p"), captured_at).select("p.session_id", "p.allocation_source", "p.cpu_millicores", "p.memory_bytes", F.try_to_timestamp("p.occurred_at").alias("occurred_at"), captured_at)
    sized = (F.coalesce("cpu_millicores", F.lit(0)) >= 0) & (F.coalesce("memory_bytes", F.lit(0)) >= 0)
    return p.where(sized & F.col("session_id").isNotNull() & F.col("allocation_source").isNotNull() & F.col("occurred_at").isNotNull())
