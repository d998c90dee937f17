"""Message trees: manifests of calls and exact parts by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(calls: DataFrame) -> DataFrame:
    """(inference_call_id, session_id, side, message, part, role, type, text): every message part of the calls (input_messages, output_messages), both sides in one pass."""
    text = lambda p: F.coalesce(F.when(p["type"] == "tool_call", F.concat_ws(" ", p["name"], p["arguments"])), p["content"], p["result"])
    own = lambda m: F.struct(m["role"].alias("role"), F.transform(m["parts"], lambda p: F.struct(p["type"].alias("type"), text(p).alias("text"))).alias("parts"))
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.transform(f"{side}_messages", own).alias("messages")) for side in ("input", "output")))
    each = calls.select("inference_call_id", "session_id", F.explode(sides).alias("s"))
    messages = each.select("inference_call_id", "session_id", F.col("s.side").alias("side"), F.posexplode("s.messages").alias("message", "m"))
    found = messages.select("inference_call_id", "session_id", "side", "message", F.col("m.role").alias("role"), F.posexplode("m.parts").alias("part", "p"))
    return found.select("inference_call_id", "session_id", "side", "message", "part", "role", F.col("p.type").alias("type"), F.col("p.text").alias("text"))


def manifest(calls: DataFrame) -> DataFrame:
    """(inference_call_id, messages, parts, bytes) of each call."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return parts(calls).groupBy("inference_call_id").agg(F.count_distinct("side", "message").alias("messages"), F.count("*").alias("parts"), F.sum(size).alias("bytes"))


def referenced(calls: DataFrame, references: DataFrame) -> DataFrame:
    """The parts that references (inference_call_id, side, message, part) name; a reference to nothing gives no row."""
    return parts(calls).join(references, ["inference_call_id", "side", "message", "part"])


def prompt_key(messages: str) -> Column:
    """Hash of the canonical JSON of messages: equal prompts, whatever the order of absent fields."""
    return F.sha2(F.to_json(messages, {"ignoreNullFields": "true"}), 256)
