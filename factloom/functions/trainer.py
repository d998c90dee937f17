"""Messages of a call as a trainer's conversation, or the one reason why they can't be told there without changing their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_trainable

_CALL = "struct<id:string,name:string,arguments:string>"
_MESSAGE = f"struct<role:string,content:string,thinking:string,tool_calls:array<{_CALL}>,name:string,tool_call_id:string>"
_NAMES = "array<struct<id:string,name:string>>"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _is(p: Column, *kinds: str) -> Column:
    return p["type"].isin(*kinds)


def _message(role: Column, **fields: Column) -> Column:
    kinds = {"content": "string", "thinking": "string", "tool_calls": f"array<{_CALL}>", "name": "string", "tool_call_id": "string"}
    return F.struct(role.alias("role"), *(fields.get(k, _null(t)).alias(k) for k, t in kinds.items())).cast(_MESSAGE)


def _joined(parts: Column, kind: str) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: _is(p, kind)), lambda p: F.coalesce(p["content"], F.lit(""))), "")


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), 0)


def _named(names: Column, id_: Column) -> Column:
    return F.get(F.filter(names, lambda n: n["id"] == id_), 0)["name"]


def _reason(m: Column, names: Column, completion: Column) -> Column:
    """Why a message can't be told, in the order in which its parts are looked at."""
    role, parts = m["role"], m["parts"]
    answers = F.exists(parts, lambda p: _is(p, "tool_call_response"))
    answered = F.transform(
        parts,
        lambda p: F.when(_is(p, "text") & (role == "user"), _null()).when(~_is(p, "tool_call_response"), "unrepresentable_part_order").when(_named(names, p["id"]).isNull(), "unresolved_tool_call"),
    )
    phase = lambda p: F.when(_is(p, "reasoning"), 0).when(_is(p, "text"), 1).when(_is(p, "tool_call"), 2)
    before = lambda i: F.slice(parts, 1, i)
    said = F.transform(
        parts,
        lambda p, i: F.when(phase(p).isNull(), "unsupported_role_part")
        .when(_is(p, "tool_call") & (_named(names, p["id"]).isNotNull() | F.exists(before(i), lambda q: _is(q, "tool_call") & (q["id"] == p["id"]))), "duplicate_tool_call_id")
        .when((i > 0) & (phase(p) < phase(F.get(parts, i - 1))), "unrepresentable_part_order"),
    )
    return (
        F.when(F.size(parts) == 0, "empty_message").when(completion & (role != "assistant"), "unsupported_completion_role").when(answers & ~role.isin("tool", "user"), "unsupported_role_part").when(answers, _first(answered))
        .when(~role.isin("developer", "system", "user", "assistant"), "unsupported_message_role").when((role != "assistant") & F.exists(parts, lambda p: ~_is(p, "text")), "unsupported_role_part").when(role == "assistant", _first(said))
    )


def _mapped(m: Column, names: Column) -> Column:
    """The trainer's messages of one message: several where tool results and a user's texts take turns."""
    role, parts = m["role"], m["parts"]
    answers = F.exists(parts, lambda p: _is(p, "tool_call_response"))

    def run(i: Column) -> Column:
        """The texts from a place to the next tool result, joined."""
        start = F.struct(F.lit("").alias("s"), F.lit(True).alias("open"))
        step = lambda a, p: F.struct(F.when(a["open"] & _is(p, "text"), F.concat(a["s"], F.coalesce(p["content"], F.lit("")))).otherwise(a["s"]).alias("s"), (a["open"] & _is(p, "text")).alias("open"))
        return F.aggregate(F.slice(parts, i + 1, F.size(parts)), start, step, lambda a: a["s"])

    turns = F.transform(
        parts,
        lambda p, i: F.when(_is(p, "tool_call_response"), _message(F.lit("tool"), name=_named(names, p["id"]), tool_call_id=p["id"], content=p["result"]))
        .when((i == 0) | _is(F.get(parts, i - 1), "tool_call_response"), _message(F.lit("user"), content=run(i))),
    )
    has = lambda kind: F.exists(parts, lambda p: _is(p, kind))
    calls = F.transform(F.filter(parts, lambda p: _is(p, "tool_call")), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["arguments"].alias("arguments")))
    own = _message(role, content=F.when(has("text") | (role != "assistant"), _joined(parts, "text")), thinking=F.when(has("reasoning"), _joined(parts, "reasoning")), tool_calls=F.when(has("tool_call"), calls))
    return F.when(answers, F.filter(turns, lambda t: t.isNotNull())).otherwise(F.array(own)).cast(f"array<{_MESSAGE}>")


def conversation(input_messages: Column, output_messages: Column) -> Column:
    """(prompt, completion, reason) of a call's messages: thinking, content and tool calls of a turn in this order, tool results under the name of their call.

    The reason is the first in message order: empty_message, unsupported_completion_role, unsupported_role_part, unrepresentable_part_order, unresolved_tool_call,
    unsupported_message_role, duplicate_tool_call_id; then completionless, and unrepresentable where a text or number can't be written. With a reason the rest is null.
    """
    names, messages = F.array().cast(_NAMES), F.array().cast(f"array<{_MESSAGE}>")

    def fold(given: Column, completion: bool, start: Column) -> Column:
        step = lambda a, m: F.struct(
            F.concat(a["names"], F.transform(F.filter(m["parts"], lambda p: _is(p, "tool_call")), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name")))).cast(_NAMES).alias("names"),
            F.concat(a["messages"], _mapped(m, a["names"])).alias("messages"), F.coalesce(a["reason"], _reason(m, a["names"], F.lit(completion))).alias("reason"),
        )
        return F.aggregate(F.coalesce(given, F.array().cast("array<struct<role:string,finish_reason:string,parts:array<struct<type:string,content:string,id:string,name:string,arguments:string,result:string>>>>")), start, step)

    prompt = fold(input_messages, False, F.struct(names.alias("names"), messages.alias("messages"), _null().alias("reason")))
    completion = fold(output_messages, True, F.struct(prompt["names"].alias("names"), messages.alias("messages"), prompt["reason"].alias("reason")))
    whole = F.struct(prompt["messages"].alias("prompt"), completion["messages"].alias("completion"), completion["reason"].alias("reason"))
    plain = is_trainable(F.concat(input_messages, output_messages))
    return F.transform(
        F.array(whole),
        lambda w: F.transform(
            F.array(F.coalesce(w["reason"], F.when(F.size(w["completion"]) == 0, "completionless"), F.when(~plain, "unrepresentable"))),
            lambda r: F.struct(F.when(r.isNull(), w["prompt"]).alias("prompt"), F.when(r.isNull(), w["completion"]).alias("completion"), r.alias("reason")),
        )[0],
    )[0]
