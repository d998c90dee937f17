"""Context for a question: of granted sessions the parts that share most of its words, packed into a response, and the sessions worth asking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOP_WORDS, ascii_bytes, tokens
from ..sources.shared import Workspace
from .attribution import packed

#: Items of a response, bytes of its envelope and of a response by default, state of a scan in bytes and what an entry of it takes besides.
ITEMS, ENVELOPE_BYTES, RESPONSE_BYTES = 8, 2048, 16384
STATE_BYTES, ENTRY_BYTES = 32 * 1024 * 1024, 512
REFERENCE = ["inference_call_id", "side", "message", "part"]


def scored_parts(parts: DataFrame, query: list[str]) -> DataFrame:
    """parts (session_id, inference_call_id, observed_at, side, message, part, role, type, text, and where known finish_reason and finite) with ``score``, the query's distinct words in the text, and ``reason`` where a part is out.

    Reasons: reasoning_part, non_finite_number (``finite`` is false: its arguments or result hold such a number), no_match.
    """
    wanted = F.array(*map(F.lit, sorted(set(query) - set(QUERY_STOP_WORDS)))).cast("array<string>")
    score = F.size(F.array_intersect(tokens(F.col("text")), wanted))
    finite = F.coalesce("finite", F.lit(True)) if "finite" in parts.columns else F.lit(True)
    reason = F.when(F.col("type") == "reasoning", "reasoning_part").when(~finite, "non_finite_number").when(score == 0, "no_match")
    return parts.withColumns({"score": score, "reason": reason})


def rank() -> list[Column]:
    """The order of parts: most words, newest, then the part's reference; what was asked stands before what was answered."""
    return [F.desc("score"), F.desc("observed_at"), F.col("inference_call_id"), (F.col("side") != "input").cast("int"), F.col("message"), F.col("part")]


def _whole(parts: DataFrame) -> tuple[Column, Column]:
    """(finish reason, part) as they stand in JSON."""
    finish = F.col("finish_reason") if "finish_reason" in parts.columns else F.lit(None).cast("string")
    return finish.alias("finish_reason"), F.struct("type", F.col("text").alias("content")).alias("part")


def content_key(parts: DataFrame) -> Column:
    """What tells a part's content: role, finish reason and the whole part, as a hash of their JSON."""
    finish, part = _whole(parts)
    return F.sha2(F.to_json(F.struct(finish, part, "role"), {"ignoreNullFields": "false"}), 256)


def encoded_bytes(parts: DataFrame) -> Column:
    """The bytes that a scored part takes in a response: its strict ASCII JSON with score, reference, time, role, finish reason and part."""
    finish, part = _whole(parts)
    reference = F.struct("inference_call_id", "side", F.col("message").alias("message_index"), F.col("part").alias("part_index")).alias("reference")
    at = F.date_format(F.col("observed_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at")
    return ascii_bytes(F.to_json(F.struct("score", F.struct(reference, at, "role", finish, part).alias("evidence")), {"ignoreNullFields": "false"}))


def retrieve(parts: DataFrame, query: list[str], max_bytes: int = RESPONSE_BYTES, items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """(items, summary) of a question to each session.

    items: session_id, rank, score, the reference, bytes. Of parts with equal content in a session the best one stands for all; the best ones are taken in order
    while their encoding and the commas between them fit into ``max_bytes`` less the envelope; one that doesn't fit is passed over. summary: session_id,
    scanned_parts, status (matched, budget_exhausted, no_match), selected and how many parts were left out for each of the six reasons.
    """
    space = Workspace(parts.sparkSession, "context")
    told = scored_parts(parts, query)
    found = told.where("reason is null")
    found = found.select("session_id", content_key(found).alias("content"), "score", "observed_at", *REFERENCE, encoded_bytes(found).alias("bytes"))
    newest = -F.unix_micros(F.col("observed_at").cast("timestamp"))
    place = F.struct((-F.col("score")).alias("score"), newest.alias("at"), "inference_call_id", (F.col("side") != "input").cast("int").alias("answered"), "message", "part")
    best = found.groupBy("session_id", "content").agg(F.min(F.struct(place.alias("place"), "bytes")).alias("m"), F.count("*").alias("copies"))
    ranked = space.save(best.select("session_id", "m.place", "m.bytes", "copies"), "ranked")
    taken = space.save(packed(ranked, "session_id", "place", "bytes", items, max_bytes - ENVELOPE_BYTES, 1), "taken")
    ends = taken.groupBy("session_id").agg(F.count("*").alias("selected"), F.max("place").alias("last"))
    after = F.coalesce((F.col("selected") == items) & (F.col("place") > F.col("last")), F.lit(False))
    left = ranked.join(ends, "session_id", "left").groupBy("session_id").agg(
        F.count("*").alias("groups"), F.sum(F.col("copies") - 1).alias("repeated_content"), F.coalesce(F.max("selected"), F.lit(0)).alias("selected"), F.count_if(after).alias("item_limit")
    )
    out = lambda name: F.count_if(F.col("reason") == name).alias(name)
    scanned = told.groupBy("session_id").agg(F.count("*").alias("scanned_parts"), out("reasoning_part"), out("non_finite_number"), out("no_match"))
    both = scanned.join(left, "session_id", "left").na.fill(0, ["groups", "repeated_content", "selected", "item_limit"])
    status = F.when(F.col("selected") > 0, "matched").when(F.col("groups") > 0, "budget_exhausted").otherwise("no_match")
    summary = both.select("session_id", "scanned_parts", status.alias("status"), "selected", "reasoning_part", "non_finite_number", "no_match", "repeated_content", "item_limit", (F.col("groups") - F.col("selected") - F.col("item_limit")).alias("response_budget"))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("place"))
    side = F.when(F.col("place.answered") == 1, "output").otherwise("input")
    shown = taken.select("session_id", order.alias("rank"), (-F.col("place.score")).alias("score"), F.col("place.inference_call_id").alias("inference_call_id"), side.alias("side"), F.col("place.message").alias("message"), F.col("place.part").alias("part"), "bytes")
    return shown, summary


_CANDIDATES = "session_id string, content string, score int, at long, inference_call_id long, answered int, message int, part int, bytes long, state_bytes long, refused boolean"
_STATE = "contents array<string>, reserved array<long>, ranks array<string>, bytes long, refused boolean"


def running_candidates(found: DataFrame, limit: int = STATE_BYTES) -> DataFrame:
    """The best candidate of each content of a session, as parts of a stream come in: a row for each candidate that is new or better than what the state has.

    ``found``: session_id, content, score, at, inference_call_id, answered, message, part, bytes, and a column of a watermark or none. An entry reserves its key, the
    largest encoding that was seen and ``ENTRY_BYTES``; reservations only grow, so their sum does not depend on the order of arrival. A session whose sum passes
    ``limit`` is refused: its state is given up and a last row says so. ``state_bytes`` is the sum after the row's batch.
    """
    keys = ["score", "at", "inference_call_id", "answered", "message", "part"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        contents, reserved, ranks, total, refused = state.get if state.exists else ([], [], [], 0, False)
        at = {c: (r, tuple(map(int, k.split("|")))) for c, r, k in zip(contents, reserved, ranks, strict=True)}
        better: dict[str, tuple] = {}
        for rows in batches:
            for content, size, *own in zip(rows["content"], rows["bytes"], *(rows[k] for k in keys), strict=True):
                if refused:
                    break
                own = tuple(map(int, (-own[0], -own[1], *own[2:])))
                held = at.get(content)
                total += len(content) + size + ENTRY_BYTES if held is None else max(0, size - held[0])
                refused = total > limit
                if held is None or own < held[1]:
                    better[content] = (size, own)
                at[content] = (max(size, held[0] if held else 0), min(own, held[1]) if held else own)
        if refused:
            state.update(([], [], [], int(total), True))
            yield pd.DataFrame([(*key, None, *[None] * 6, None, None, True)], columns=[c.split()[0] for c in _CANDIDATES.split(", ")])
            return
        state.update((list(at), [int(r) for r, _ in at.values()], ["|".join(map(str, k)) for _, k in at.values()], int(total), False))
        made = [(*key, c, -k[0], -k[1], *k[2:], size, int(total), False) for c, (size, k) in better.items()]
        yield pd.DataFrame(made, columns=[c.split()[0] for c in _CANDIDATES.split(", ")])

    return found.groupBy("session_id").applyInPandasWithState(update, _CANDIDATES, _STATE, "update", "NoTimeout")


def settled_candidates(rows: DataFrame) -> DataFrame:
    """(session_id, contents, state_bytes, refused, best: the smallest rank as an array) of what ``running_candidates`` gave so far."""
    refused = F.max("refused")
    best = rows.groupBy("session_id", "content").agg(F.max("score").alias("score"), F.max("state_bytes").alias("state_bytes"), F.max("refused").alias("refused"))
    return best.groupBy("session_id").agg(F.when(~refused, F.count("content")).otherwise(0).alias("contents"), F.when(~refused, F.max("state_bytes")).alias("state_bytes"), F.when(~refused, F.sum("score")).alias("scores"), refused.alias("refused"))


def discover(parts: DataFrame, sessions: DataFrame, query: list[str], items: int = ITEMS) -> DataFrame:
    """(session_id, commit_match, score, matched, best_call): the sessions to ask first: those that a commit witnesses, then by the score of their best part.

    ``sessions`` (session_id, commit_match: null without a witness) are the granted ones; one without a match and without a witness is left out.
    """
    found = scored_parts(parts, query).where("reason is null").join(sessions.select("session_id"), "session_id", "left_semi")
    newest = F.unix_micros(F.col("observed_at").cast("timestamp"))
    key = F.struct(F.col("score"), newest.alias("at"), (-F.col("inference_call_id")).alias("call"), (F.col("side") == "input").alias("asked"), (-F.col("message")).alias("m"), (-F.col("part")).alias("p"))
    best = found.groupBy("session_id").agg(F.count("*").alias("matched"), F.max(key).alias("best"))
    out = sessions.join(best, "session_id", "left").where("commit_match is not null or best is not null")
    shown = out.select("session_id", "commit_match", F.coalesce("best.score", F.lit(0)).alias("score"), F.coalesce("matched", F.lit(0)).alias("matched"), (-F.col("best.call")).alias("best_call"))
    return shown.orderBy(F.col("commit_match").isNull(), F.desc("score"), "session_id").limit(items)
