"""Operator 10: secrets, found by a trigram inverted index and verified by regular expressions.

Each rule's regex is turned into a Boolean trigram query: an AND over its mandatory literal runs of an OR over the run's
alternatives of an AND of trigrams (lower case). The index has a posting (trigram, row) for the trigrams that a query names.
Postings are intersected by counting: a row is a candidate of a rule if every run has an alternative all of whose trigrams
were posted. A rule without a mandatory trigram is tried on every text. Candidates are joined with their texts and verified.
Everything is a DataFrame operation; nothing is broadcast but the rules' terms, whose number the rules fix.

Spans are code points, end exclusive; a private key is one span from its first line to its last, or, if it is cut off, to the end of its
lines. Null text is the empty text: no spans. Texts may be of any length. Rows with equal key and text (repeated rows, null keys) share
their result, and each gives a row. Spans of several kinds may overlap; at one start the kinds come in the order of the rules. An empty
table gives an empty table; only key and text are read, whatever the names of the other columns.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, table
from .spans import row_key, spans


class Rule(NamedTuple):
    """``least``: characters that group ``group`` of a match must have, or the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The first three are the base; a run of hexadecimal digits or an access key that is long enough is the same with its length in the regex.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{40,}+)*+)"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{82,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("url_password", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@]++:([^\s:/@]++)@", 1),
)
BASE = ("assign", "access", "hex")
_MOST = 64  # alternatives of a run

Query = list[list[frozenset[str]]]  # AND of OR of AND


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query of a regex; empty if it has no mandatory trigram."""
    query: Query = []

    def close(run: set[str]) -> None:
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            query.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    def joined(a: set[str], b: set[str] | None) -> set[str]:
        """The run a followed by the strings b; a run that can't go on is closed and a new one begun."""
        if b is None or len(a) * len(b) > _MOST:
            close(a)
            return b or {""}
        return {x + y for x in a for y in b}

    def strings(op, value) -> set[str] | None:
        """All strings an element matches, if they are few."""
        if op is sre.LITERAL:
            return {chr(value).lower()}
        if op is sre.IN:
            if any(o is not sre.LITERAL for o, _ in value) or len(value) > 8:
                return None
            return {chr(v).lower() for _, v in value}
        if op is sre.SUBPATTERN:
            return sequence(value[3])
        if op is sre.BRANCH:
            parts = [sequence(p) for p in value[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and value[1] == 1:
            inner = sequence(value[2])
            return None if inner is None else inner | ({""} if value[0] == 0 else set())
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for op, value in items:
            own = strings(op, value)
            if own is None or len(out) * len(own) > _MOST:
                return None
            out = {x + y for x in out for y in own}
        return out

    def walk(items, run: set[str]) -> set[str]:
        for op, value in items:
            own = strings(op, value)
            if own is None and op is sre.SUBPATTERN:
                run = walk(value[3], run)
            elif own is None and op is sre.MAX_REPEAT and value[0] >= 1:
                close(walk(value[2], joined(run, None)))
                run = {""}
            else:
                run = joined(run, own)
        return run

    close(walk(sre_parse.parse(regex), {""}))
    return query


def postings(docs: DataFrame, grams: list[str], row: str = "row", text: str = "text") -> DataFrame:
    """The inverted index of the named trigrams over the lower-cased texts: (gram, row)."""
    low = docs.select(row, F.lower(text).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select(F.explode(present).alias("gram"), row)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, row: str = "row", text: str = "text") -> DataFrame:
    """(row, id): the rules, by their place in ``rules``, that a row's text has to be tried with."""
    spark = docs.sparkSession
    terms, runs = [], []
    scanned = []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.regex)
        runs.append((i, len(query)))
        for r, run in enumerate(query):
            for a, alternative in enumerate(run):
                terms += [(g, i, r, a, len(alternative)) for g in sorted(alternative)]
        if not query:
            scanned.append(F.when(F.col(text).rlike(rule.regex), F.lit(i)))
    found = None
    if terms:
        listed = spark.createDataFrame(terms, "gram string, id int, run int, alternative int, grams int")
        index = postings(docs, sorted({t[0] for t in terms}), row, text)
        met = index.join(F.broadcast(listed), "gram").groupBy(row, "id", "run", "alternative", "grams").agg(F.count_distinct("gram").alias("n")).where("n = grams")
        need = F.broadcast(spark.createDataFrame(runs, "id int, runs int"))
        found = met.groupBy(row, "id").agg(F.count_distinct("run").alias("n")).join(need, "id").where("n = runs").select(row, "id")
    if scanned:
        full = docs.select(row, F.explode(F.array_compact(F.array(*scanned))).alias("id")).distinct()
        found = full if found is None else found.unionAll(full)
    return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each secret: row, kind, rank (of the kind), start, end, found. ``row`` is ``row_key`` of the document."""
    spark = docs.sparkSession
    keyed = docs.select(row_key(key, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = spark.createDataFrame([(i, i, r.kind, r.regex, r.group, r.least) for i, r in enumerate(rules)], "id int, rank int, kind string, regex string, group int, least int")
    tried = candidates(keyed, rules).join(F.broadcast(listed), "id").groupBy("row").agg(F.collect_set(F.struct("id", "rank", "kind", "regex", "group", "least")).alias("rules"))
    texts = keyed.join(tried, "row").dropDuplicates(["row"])
    found = spans(texts, "row", "text", "rules", {"char": F.char_length}, ["rank", "kind", "least"]).where(F.char_length("captured") >= F.col("least"))
    return found.select("row", "kind", "rank", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "found")


def _listed(where: Column) -> Column:
    spans_of = F.array_sort(F.collect_list(F.when(where, F.struct("start", "rank", "end", "kind"))))
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, counts and spans of its secrets."""
    base = F.col("kind").isin(*BASE)
    found = scan(docs, rules, key, text).groupBy("row").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE), _listed(base).alias("base"), _listed(F.lit(True)).alias("spans"))
    out = docs.select(key, row_key(key, text).alias("row")).join(found, "row", "left")
    return out.select(key, *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each secret's characters replaced by a mark (overlapping spans by one); every document stays."""
    row, cuts = fresh_name(docs, "row"), fresh_name(docs, "cuts")
    found = scan(docs, rules, key, text).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    empty = F.expr("named_struct('cuts', cast(array() as array<struct<start:bigint,end:bigint>>), 'start', -1L, 'end', -1L)")
    merged = F.aggregate(
        "spans", empty,
        lambda a, s: F.when(s["start"] <= a["end"], F.struct(a["cuts"].alias("cuts"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end")))
        .otherwise(F.struct(F.concat(a["cuts"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))).alias("cuts"), s["start"].alias("start"), s["end"].alias("end"))),
        lambda a: F.concat(a["cuts"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))),
    )
    cut = found.select(F.col("row").alias(row), merged.alias(cuts))  # the first cut is the place before the text
    joined = docs.withColumn(row, row_key(key, text)).join(cut, row, "left")
    c, n = F.col(cuts), F.size(cuts)
    last = lambda i: F.when(i + 1 < n, F.get(c, i + 1)["start"]).otherwise(F.char_length(text))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), (F.greatest(F.get(c, i)["end"], F.lit(0)) + 1).cast("int"), (last(i) - F.greatest(F.get(c, i)["end"], F.lit(0))).cast("int")))
    clean = F.when(c.isNull(), F.col(text)).otherwise(F.array_join(pieces, mark))
    return joined.select(*(clean.alias(x) if x == text else F.col(f"`{x}`") for x in docs.columns))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
