"""Which facts are visible, first-write-wins storage, sessions and bounded reads."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarantined(log: DataFrame) -> DataFrame:
    """(fact_id): facts whose latest action, by revision, is ``quarantine``. One pass with map-side combine."""
    return log.groupBy("fact_id").agg(F.max_by("action", "quarantine_revision").alias("action")).where("action = 'quarantine'").select("fact_id")


def visible(facts: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Facts that are not quarantined."""
    return facts.join(quarantined(log).withColumnRenamed("fact_id", key), key, "left_anti")


def first_written(facts: DataFrame, natural_key: list[str], order: list[str]) -> DataFrame:
    """One fact for each natural key, the earliest in ``order``: redelivered facts collapse."""
    smallest = F.min(F.struct(*order, *(c for c in facts.columns if c not in order and c not in natural_key)))
    kept = facts.groupBy(*natural_key).agg(smallest.alias("first"))
    return kept.select(*natural_key, "first.*").select(*facts.columns)


def session_upsert(events: DataFrame, session: str, user: str, at: str) -> DataFrame:
    """(session, user, conflict, first, last): bounds of a session's events; contradicting users give none and a flag."""
    grouped = events.groupBy(session).agg(F.min(user).alias("low"), F.max(user).alias("high"), F.min(at).alias("first_observed_at"), F.max(at).alias("last_observed_at"))
    return grouped.select(
        session, F.when(F.col("low") == F.col("high"), F.col("low")).alias("user"), (F.col("low") != F.col("high")).alias("user_conflict"), "first_observed_at", "last_observed_at"
    )


def keyset_page(facts: DataFrame, at: str, key: str, limit: int, before: tuple | None = None) -> DataFrame:
    """The newest ``limit`` + 1 facts before a cursor (at, key); the extra row tells whether a next page exists."""
    if before is not None:
        facts = facts.where((F.col(at) < before[0]) | ((F.col(at) == before[0]) & (F.col(key) < before[1])))
    return facts.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)


def page(facts: DataFrame, at: str, key: str, limit: int, asked: dict, revision: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(the newest ``limit`` facts after a cursor, the cursor of the next page or None). A page's rows are held by the driver.

    A cursor is bound to what was asked and to the quarantine revision: with another question, or after a quarantine, it is refused.
    """
    bound = hashlib.sha256(json.dumps([asked, revision], sort_keys=True).encode()).hexdigest()[:16]
    before = None
    if cursor is not None:
        told, moment, last = json.loads(base64.urlsafe_b64decode(cursor))
        if told != bound:
            raise ValueError("the cursor is of another question or revision")
        before = (F.lit(moment).cast("timestamp"), last)
    rows = keyset_page(facts, at, key, limit, before).collect()
    schema = facts.schema
    following = None
    if len(rows) > limit:
        end = rows[limit - 1]
        following = base64.urlsafe_b64encode(json.dumps([bound, str(end[at]), end[key]]).encode()).decode()
    return facts.sparkSession.createDataFrame(rows[:limit], schema), following


def within(facts: DataFrame, limit: int) -> DataFrame:
    """facts, or an error if there are more than ``limit``: a bounded read refuses and never truncates."""
    if facts.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return facts


def lookback(at: Column, pushed: Column, minutes: int, grace: int = 0) -> Column:
    """Both ends inclusive."""
    return at.between(pushed - F.expr(f"interval {minutes} minutes"), pushed + F.expr(f"interval {grace} minutes"))


def dossier(tables: dict[str, tuple[DataFrame, str, str]], session: str) -> DataFrame:
    """(session, at, fact_table, fact_id): the timeline of all (facts, time, key) tables, to be ordered by (at, fact_id)."""
    out = None
    for name, (df, at, key) in tables.items():
        own = df.select(session, F.col(at).alias("at"), F.lit(name).alias("fact_table"), F.col(key).cast("string").alias("fact_id"))
        out = own if out is None else out.unionByName(own)
    return out


def coverage(facts: DataFrame, log: DataFrame, key: str, session: str) -> DataFrame:
    """(session, total, visible, quarantined)."""
    marked = facts.join(quarantined(log).select(F.col("fact_id").alias(key), F.lit(True).alias("out")), key, "left")
    return marked.groupBy(session).agg(F.count("*").alias("total"), F.count_if(F.col("out").isNull()).alias("visible"), F.count_if(F.col("out")).alias("quarantined"))


def latest_pushes(pushes: DataFrame, repo: str, at: str, now: str, days: int = 90) -> DataFrame:
    """Repositories whose last push is older than ``days`` before ``now``: candidates for collection."""
    last = pushes.groupBy(repo).agg(F.max(at).alias("last_push"))
    return last.where(F.col("last_push") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
