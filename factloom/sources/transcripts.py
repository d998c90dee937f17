"""Agent transcripts (JSON lines) as edits, rejections and user texts with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTRY = "sessionId string, type string, timestamp string, message struct<role:string,content:string>"
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:struct<file_path:string,old_string:string,new_string:string,content:string>,tool_use_id:string,is_error:boolean,content:string>>"
EDIT_TOOLS = ("Edit", "Write", "MultiEdit")


def events(lines: DataFrame) -> DataFrame:
    """(session_id, position, kind, tool_name, call_id, file_path, text, is_error) of (line, entry) rows: a row for each content block, in order. Broken lines give none."""
    p = lines.select("line", F.from_json("entry", _ENTRY).alias("e")).where("e.sessionId is not null and e.type in ('user', 'assistant')")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("e.message.content").alias("text"))), _BLOCKS.removeprefix("array<").removesuffix(">")))
    content = F.when(F.ltrim("e.message.content").startswith("["), F.from_json("e.message.content", _BLOCKS)).otherwise(plain)
    blocks = p.select("line", "e", F.posexplode(content).alias("block", "b"))
    kind = F.when(F.col("b.type") == "text", F.concat("e.type", F.lit("_text"))).otherwise(F.col("b.type"))
    return blocks.select(
        F.col("e.sessionId").alias("session_id"), (F.shiftleft(F.col("line").cast("long"), 24) + F.col("block")).alias("position"), kind.alias("kind"), F.col("b.name").alias("tool_name"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"),
        F.col("b.input.file_path").alias("file_path"), F.coalesce("b.text", "b.input.new_string", "b.input.content", "b.content").alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"),
    )


def edits(found: DataFrame) -> DataFrame:
    """(session_id, position, id, tool_name, file_path, text, accepted) of edit calls that have a result: an error result is a rejection."""
    used = found.where((F.col("kind") == "tool_use") & F.col("tool_name").isin(*EDIT_TOOLS))
    results = found.where("kind = 'tool_result'").groupBy("session_id", "call_id").agg(F.max_by("is_error", "position").alias("bad"))
    joined = used.join(results, ["session_id", "call_id"])
    return joined.select("session_id", "position", F.col("call_id").alias("id"), "tool_name", "file_path", "text", (~F.col("bad")).alias("accepted"))


def said(found: DataFrame) -> DataFrame:
    """(session_id, position) of user texts that are not empty."""
    return found.where("kind = 'user_text' and trim(text) <> ''").select("session_id", "position")


# --- two more harnesses: their entries as edits of the same columns -----------------------

_EDIT_COLUMNS = ["session_id", "line", "id", "tool_name", "file_path", "text", "reason"]


def normal_path(path: Column, cwd: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` steps: a relative one stands in ``cwd``; null if that isn't absolute."""
    whole = F.when(path.startswith("/"), path).when(cwd.startswith("/"), F.concat(cwd, F.lit("/"), path))
    steps = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


_MESSAGE_ENTRY = "type string, id string, cwd string, message struct<role:string,timestamp:bigint,content:string,toolCallId:string,isError:boolean>"
_CALLS = "array<struct<type:string,id:string,name:string,arguments:struct<path:string,content:string,edits:array<struct<newText:string>>>>>"


def message_edits(lines: DataFrame) -> DataFrame:
    """(session_id, line, id, tool_name, file_path, text, reason) of (session_id, line, entry) rows: ``edit`` and ``write`` calls of message transcripts whose result is no error.

    A write's text is its content, an edit's the new texts of its spans, joined by newlines. The header's directory holds relative paths. Reasons: session_mismatch (the
    header names another session, so nothing of the file counts), unsupported_path, execution_directory_invalid; a row with a reason is no edit.
    """
    e = lines.select("session_id", "line", F.from_json("entry", _MESSAGE_ENTRY).alias("e")).where("e.type is not null")
    heads = e.where("e.type = 'session'").groupBy("session_id").agg(F.max(F.col("e.id") != F.col("session_id")).alias("other"), F.count("*").alias("heads"), F.max("e.cwd").alias("cwd"))
    said = e.where("e.type = 'message' and e.message.role = 'assistant' and e.message.timestamp is not null")
    calls = said.select("session_id", "line", F.explode(F.from_json("e.message.content", _CALLS)).alias("c")).where("c.type = 'toolCall' and c.name in ('edit', 'write') and c.id <> ''")
    spans = F.transform("c.arguments.edits", lambda x: x["newText"])
    text = F.when(F.col("c.name") == "write", F.col("c.arguments.content")).otherwise(F.when((F.size(spans) > 0) & ~F.exists(spans, lambda t: t.isNull()), F.array_join(spans, "\n")))
    good = e.where("e.message.role = 'toolResult' and not coalesce(e.message.isError, false)").select("session_id", F.col("e.message.toolCallId").alias("id")).distinct()
    found = calls.select("session_id", "line", F.col("c.id").alias("id"), F.col("c.name").alias("tool_name"), F.col("c.arguments.path").alias("path"), text.alias("text")).where("text is not null and path <> ''")
    joined = found.join(good, ["session_id", "id"]).join(heads, "session_id", "left")
    odd = F.col("path").rlike(r"^(?:~|@|file://)|[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]")
    own = normal_path(F.col("path"), F.when(F.col("heads") == 1, F.col("cwd")))
    reason = F.when(F.col("other"), "session_mismatch").when(odd, "unsupported_path").when(own.isNull(), "execution_directory_invalid")
    return joined.withColumns({"reason": reason, "file_path": F.when(reason.isNull(), own)}).select(*_EDIT_COLUMNS)


_EVENT_ENTRY = "type string, timestamp string, payload string"
_CHANGES = "map<string,struct<type:string,content:string,unified_diff:string,move_path:string>>"
_PAYLOAD = f"id string, session_id string, cwd string, type string, call_id string, success boolean, changes {_CHANGES}, thread_id string, item struct<type:string,id:string,status:string,changes:{_CHANGES}>"


def added_text(diff: Column) -> Column:
    """The added lines of a unified diff's hunks, joined by newlines; null unless every hunk holds as many lines of both sides as its header says."""
    lines = F.split(F.regexp_replace(diff, "\n$", ""), "\n")
    header = r"^@@ -\d{1,9}(?:,(\d{1,9}))? \+\d{1,9}(?:,(\d{1,9}))? @@(?: .*)?$"
    count = lambda x, g: F.coalesce(F.nullif(F.regexp_extract(x, header, g), F.lit("")).cast("long"), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("old"), F.lit(0).cast("long").alias("new"), F.lit(False).alias("hunk"), F.lit(False).alias("bad"), F.array().cast("array<string>").alias("added"))

    def step(a: Column, x: Column) -> Column:
        is_head, mark = x.rlike(header), F.substring(x, 1, 1)
        old, new = F.when(mark.isin("-", " "), 1).when(x == "", 1).otherwise(0), F.when(mark.isin("+", " "), 1).when(x == "", 1).otherwise(0)
        skipped = (~a["hunk"] & x.rlike(r"^(?:diff --git |index |--- |\+\+\+ )")) | (x == "\\ No newline at end of file")
        left_old, left_new = a["old"] - old, a["new"] - new
        wrong = F.when(is_head, (a["old"] > 0) | (a["new"] > 0)).when(skipped, False).otherwise(~a["hunk"] | (left_old < 0) | (left_new < 0) | ~((x == "") | mark.isin("+", "-", " ")))
        return F.struct(
            F.when(is_head, count(x, 1)).when(skipped, a["old"]).otherwise(left_old).alias("old"), F.when(is_head, count(x, 2)).when(skipped, a["new"]).otherwise(left_new).alias("new"),
            (a["hunk"] | is_head).alias("hunk"), (a["bad"] | wrong).alias("bad"), F.when(~is_head & ~skipped & (mark == "+"), F.concat(a["added"], F.array(F.substring(x, 2, 1 << 30)))).otherwise(a["added"]).alias("added"),
        )

    return F.aggregate(lines, start, step, lambda a: F.when(a["hunk"] & ~a["bad"] & (a["old"] == 0) & (a["new"] == 0), F.array_join(a["added"], "\n")))


def event_edits(lines: DataFrame) -> DataFrame:
    """(session_id, line, id, tool_name, file_path, text, reason) of (session_id, line, entry) rows: single-file changes that event transcripts report as applied.

    A change comes as ``patch_apply_end`` with success, or as a completed ``FileChange`` item of the session's own thread. An added file's text is its content, an updated
    one's the added lines of its diff, under the new path if it moved. Reasons: session_mismatch, execution_failed, execution_status_unknown, unsupported_patch_kind (several
    files, or neither added nor updated), malformed_patch, execution_directory_invalid; a row with a reason is no edit.
    """
    e = lines.select("session_id", "line", F.from_json("entry", _EVENT_ENTRY).alias("e")).where("e.type is not null and e.timestamp is not null")
    p = e.select("session_id", "line", F.col("e.type").alias("kind"), F.from_json("e.payload", _PAYLOAD).alias("p"))
    heads = p.where("kind = 'session_meta'").groupBy("session_id").agg(F.min_by(F.struct(F.coalesce("p.id", "p.session_id").alias("own"), F.col("p.cwd").alias("cwd")), "line").alias("head"))
    item = (F.col("p.type") == "item_completed") & (F.col("p.item.type") == "FileChange")
    done = p.where("kind = 'event_msg'").where(item | ((F.col("p.type") == "patch_apply_end") & F.coalesce("p.success", F.lit(False)))).withColumn("item", item)
    changes = F.map_entries(F.when(F.col("item"), F.col("p.item.changes")).otherwise(F.col("p.changes")))
    each = done.withColumns({"id": F.when(F.col("item"), F.col("p.item.id")).otherwise(F.col("p.call_id")), "changes": changes}).join(heads, "session_id", "left")
    change = F.get("changes", F.lit(0))
    body, kind = change["value"], change["value"]["type"]
    text = F.when(kind == "add", body["content"]).when(kind == "update", added_text(body["unified_diff"]))
    path = F.when((kind == "update") & body["move_path"].isNotNull(), body["move_path"]).otherwise(change["key"])
    own, thread, status = F.col("head.own"), F.col("p.thread_id"), F.col("p.item.status")
    place = F.when(path.startswith("/"), path).otherwise(normal_path(path, F.col("head.cwd")))
    reason = (
        F.when(own.isNull() | (own != F.col("session_id")), "session_mismatch").when(F.col("item") & (F.coalesce(thread, F.lit("")) != own), "malformed_patch").when(F.coalesce(F.trim("id"), F.lit("")) == "", "malformed_patch")
        .when(F.col("item") & F.coalesce(status.isin("failed", "declined"), F.lit(False)), "execution_failed").when(F.col("item") & (F.coalesce(status, F.lit("")) != "completed"), "execution_status_unknown")
        .when(F.col("changes").isNull() | (F.size("changes") == 0), "malformed_patch").when(F.size("changes") > 1, "unsupported_patch_kind").when(~F.coalesce(kind.isin("add", "update"), F.lit(False)), "unsupported_patch_kind")
        .when(text.isNull() | (path == ""), "malformed_patch").when(place.isNull(), "execution_directory_invalid")
    )
    out = each.withColumns({"reason": reason, "tool_name": F.lit("apply_patch"), "file_path": F.when(reason.isNull(), place), "text": F.when(reason.isNull(), text)})
    return out.select(*_EDIT_COLUMNS)
