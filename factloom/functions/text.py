"""Text functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of code files, and parts of paths that are generated or locked.
CODE_SUFFIXES = (".py", ".ts", ".js", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".scala", ".rb", ".php", ".cs", ".cpp", ".c", ".h", ".tf", ".hcl", ".sql", ".sh", ".bash")
SKIPPED_PATHS = ("package-lock.json", "yarn.lock", "poetry.lock", "uv.lock", ".min.js", ".min.css")

TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+"


def tokens(text: Column) -> Column:
    """Distinct lower-case identifiers and numbers of a text, sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)))


QUERY_BYTES = 2048
#: Words of a question that say nothing about what it asks for.
QUERY_STOP_WORDS = "a an and are as at be by did do does for from how i in is it of on or that the this to was were what when where which who why with".split()


def query_tokens(text: Column) -> Column:
    """(tokens, reason) of a context query: its tokens without ``QUERY_STOP_WORDS``; ``too_long`` beyond ``QUERY_BYTES``, ``no_token`` if none is left."""
    found = F.array_except(tokens(text), F.array(*map(F.lit, QUERY_STOP_WORDS)).cast("array<string>"))
    reason = F.when(F.octet_length(text) > QUERY_BYTES, "too_long").when(F.size(found) == 0, "no_token")
    return F.struct(found.alias("tokens"), reason.alias("reason"))


def ascii_bytes(json: Column) -> Column:
    """The bytes of a JSON text whose other characters are written as ``\\uXXXX`` escapes, two of them beyond the basic plane."""
    rest = F.char_length(F.regexp_replace(json, r"[\x00-\x7F]", ""))
    high = F.char_length(F.regexp_replace(json, r"[^\x{10000}-\x{10FFFF}]", ""))
    return (F.char_length(json) + 5 * rest + 6 * high).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays over their union; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_code_file(path: Column) -> Column:
    """Whether a path has the suffix of a code file and none of the skipped parts; case counts."""
    skipped, code = F.lit(False), F.lit(False)
    for part in SKIPPED_PATHS:
        skipped |= F.contains(path, F.lit(part))
    for suffix in CODE_SUFFIXES:
        code |= F.endswith(path, F.lit(suffix))
    return code & ~skipped


def four_grams(text: Column) -> Column:
    """All character 4-grams, by four shifted matches."""
    shifted = [F.regexp_extract_all(F.substring(text, k, 2147483647), F.lit("(?s).{4}"), F.lit(0)) for k in (1, 2, 3, 4)]
    return F.concat(*shifted)


#: Grams of applied texts up to which each task gets them all; beyond that they meet by shuffles.
BROADCAST_GRAMS = 1_000_000
TASK_PAIRS = 200_000  # pairs that a task makes on average at most


def gram_counts(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, gram, n): the multiset of 4-grams of each text."""
    return df.select(*key, F.explode(four_grams(F.col(text))).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("n"))


def containment(applied: DataFrame, files: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(applied_id, file_id, containment): the share of an applied text's 4-grams, with multiplicity, that a file holds.

    ``applied`` (applied_id, applied), ``files`` (file_id, file); with ``pairs`` only the named (applied_id, file_id) are
    compared, without it all that share a gram, which are many. Pairs without a shared gram are left out. Texts under four characters are settled by ``short_containment``.
    """
    applied, files = applied.where(F.char_length("applied") >= 4), files.where(F.char_length("file") >= 4)
    if pairs is None:
        a = gram_counts(applied, ["applied_id"], "applied")
        size, texts = applied.agg(F.coalesce(F.sum(F.char_length("applied")), F.lit(0)), F.count("*")).first()
        if size <= BROADCAST_GRAMS:  # a file's grams, what they meet and its pairs stay in one task: no row for a gram of a pair is shuffled
            wanted = -(-files.count() * texts // TASK_PAIRS)
            a, files = F.broadcast(a), files.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted), "file_id")
        both = a.join(gram_counts(files, ["file_id"], "file").withColumnRenamed("n", "m"), "gram")
    else:  # only the grams of named pairs meet, each pair's under its own key
        named = pairs.select("applied_id", "file_id").distinct()
        a = gram_counts(applied.join(named, "applied_id"), ["applied_id", "file_id"], "applied")
        f = gram_counts(files.join(named, "file_id"), ["applied_id", "file_id"], "file").withColumnRenamed("n", "m")
        both = a.join(f, ["applied_id", "file_id", "gram"])
    shared = both.groupBy("applied_id", "file_id").agg(F.sum(F.least("n", "m")).alias("shared"))
    total = applied.select("applied_id", (F.char_length("applied") - 3).alias("total"))
    return shared.join(total, "applied_id").select("applied_id", "file_id", (F.col("shared") / F.col("total")).alias("containment"))


def short_containment(applied: Column, file: Column) -> Column:
    """Containment where no 4-grams are: 1 for an empty applied text, 0 in an empty or shorter file, else whether the file holds the text. Null if 4-grams decide."""
    return (
        F.when(F.char_length(applied) == 0, F.lit(1.0)).when(F.char_length(file) == 0, F.lit(0.0))
        .when(F.char_length(applied) < 4, F.contains(file, applied).cast("double")).when(F.char_length(file) < 4, F.lit(0.0))
    )


def survival(pairs: DataFrame) -> DataFrame:
    """(id, survival) of (id, left, right): 1 - |difference| / total of the two 4-gram multisets; equality if either is short."""
    long = pairs.where((F.char_length("left") >= 4) & (F.char_length("right") >= 4))
    a = gram_counts(long, ["id"], "left")
    b = gram_counts(long, ["id"], "right").withColumnRenamed("n", "m")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    scored = a.join(b, ["id", "gram"], "full_outer").groupBy("id").agg(((F.sum(n + m) - F.sum(F.abs(n - m))) / F.sum(n + m)).alias("survival"))
    short = pairs.where((F.char_length("left") < 4) | (F.char_length("right") < 4)).select("id", (F.col("left") == F.col("right")).cast("double").alias("survival"))
    return scored.unionByName(short)


#: What stands for a credential; the reasons in the order in which they are applied, with the pattern of each.
REDACTION_MARKER = "[REDACTED_CREDENTIAL]"
_CREDENTIAL = r"[A-Za-z0-9\-._~+/]{16,}=*"
_CREDENTIAL_KEY = r"(?i:authorization|proxy[_-]authorization|x[_-]api[_-]key|apikey|(?:[^'\"]*[_-])?api[_-]key)"
REDACTIONS = (
    ("authorization_header", rf"(?i)(\bAuthorization\s*[:=]\s*Bearer[ \t]+){_CREDENTIAL}", "$1"),
    ("structured_credential", rf"(?s)((['\"]){_CREDENTIAL_KEY}\2\s*:\s*(['\"]))(?!\[REDACTED_CREDENTIAL\](?:\3|\n|\z))(?:\\[^\n]?|(?!\3)[^\\\n])++(?=\3|\n|\z)", "$1"),
    (
        "api_key_assignment",
        r"(?i)(?<![A-Za-z0-9_-])((['\"]?)(?:[A-Za-z0-9_-]*[_-])?api[_ -]?key\2\s*[:=]\s*(?=['\"A-Za-z0-9\-._~+/])(?:['\"](?=[^'\"\s]{8,}))?)(?!\[REDACTED_CREDENTIAL\])"
        r"(?:(?<=['\"])(?:(?<=')[^'\"\s]{8,}(?='|\z)|(?<=\")[^'\"\s]{8,}(?=\"|\z))|(?<!['\"])[A-Za-z0-9\-._~+/]{16,}=*)",
        "$1",
    ),
    ("bearer_token", rf"(?i)(\bBearer[ \t]+){_CREDENTIAL}", "$1"),
    ("provider_key", r"(?<![A-Za-z0-9_-])sk-[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])", ""),
)


def redact(text: Column) -> Column:
    """The text with its credentials replaced by the marker."""
    for _, pattern, before in REDACTIONS:
        text = F.regexp_replace(text, pattern, before + REDACTION_MARKER)
    return text


def redaction_counts(text: Column) -> dict[str, Column]:
    """Matches of each reason in the text that earlier reasons leave."""
    out = {}
    for reason, pattern, before in REDACTIONS:
        out[reason] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, before + REDACTION_MARKER)
    return out


def is_credential_key(key: Column) -> Column:
    """Whether a key of structured data names a credential."""
    name = F.translate(F.lower(key), "-", "_")
    return name.isin("authorization", "proxy_authorization", "x_api_key", "api_key", "apikey") | F.endswith(name, F.lit("_api_key"))


def known_credentials(entries: Column) -> Column:
    """Credentials of structured data given as an array of (key, value): values of credential keys, a bearer's without its word; longest first."""
    found = F.transform(F.filter(entries, lambda e: is_credential_key(e["key"]) & e["value"].isNotNull()), lambda e: F.regexp_replace(e["value"], rf"^(?i:Bearer[ \t]+)(?={_CREDENTIAL}$)", ""))
    real = F.array_distinct(F.filter(found, lambda v: (v != "") & ~v.isin(REDACTION_MARKER, f"Bearer {REDACTION_MARKER}")))
    return F.transform(F.array_sort(F.transform(real, lambda v: F.struct((-F.char_length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])


def propagate(text: Column, credentials: Column) -> Column:
    """The text with those of its lines that are a known credential replaced by the marker."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(F.array_contains(credentials, line), REDACTION_MARKER).otherwise(line)), "\n")


def patch_paths(patch: Column) -> Column:
    """Paths of a V4A patch's file markers at line starts, in order, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"), F.lit(1)), F.trim))


def changed_lines(patch: Column) -> Column:
    """Added and removed lines inside the hunks of a unified diff."""
    lines = F.split(patch, "\n")
    fold = F.aggregate(
        lines, F.struct(F.lit(False).alias("hunk"), F.lit(0).alias("n")),
        lambda a, line: F.struct(
            F.when(line.startswith("@@"), True).when(line.startswith("diff --git "), False).otherwise(a["hunk"]).alias("hunk"),
            (a["n"] + (a["hunk"] & (line.startswith("+") | line.startswith("-"))).cast("int")).alias("n"),
        ),
        lambda a: a["n"],
    )
    return fold


def string_leaves(json: Column) -> Column:
    """The strings of a JSON text, keys left out, objects in the order of their keys; none of a text that is no JSON."""
    ordered = F.to_json(F.try_parse_json(json))  # a variant's objects are in key order
    strings = F.regexp_extract_all(ordered, F.lit(r'"(?:[^"\\]|\\.)*+":?'), F.lit(0))
    values = F.filter(strings, lambda t: ~F.endswith(t, F.lit('":')))
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"), F.array().cast("array<string>"))


def scoring_text(messages: Column) -> Column:
    """Text parts and string leaves of tool arguments of output messages, in order, joined by newlines; reasoning, tool results and empty texts left out."""
    parts = F.flatten(F.transform(messages, lambda m: m["parts"]))
    said = F.transform(parts, lambda p: F.when(p["type"] == "text", F.array(p["content"])).when(p["type"] == "tool_call", string_leaves(p["arguments"])).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.filter(F.flatten(said), lambda t: F.length(t) > 0), "\n")


def is_trainable(messages: Column) -> Column:
    """Whether a trainer can hold messages as they are: no lone surrogate and no number that isn't finite in any text or JSON of their parts."""
    parts = F.flatten(F.transform(messages, lambda m: m["parts"]))
    half = r"(?<!\\)(?:\\\\)*\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})(?<!\\)(?:\\\\)*\\u[dD][c-fC-F][0-9a-fA-F]{2}"  # in JSON: an escape of one half of a pair
    bad = lambda c: F.coalesce(c.rlike(half), F.lit(False))
    number = lambda c: F.coalesce(c.rlike(r"(?:^|[\[:,\s])-?(?:NaN|Infinity)(?=$|[\],}\s])"), F.lit(False))
    return ~F.exists(parts, lambda p: F.coalesce(p["content"].rlike(r"[\x{D800}-\x{DFFF}]"), F.lit(False)) | bad(p["arguments"]) | bad(p["result"]) | number(p["arguments"]) | number(p["result"]))


def evidence_json(value: Column, most: int) -> Column:
    """The JSON of a value, null where it has more than ``most`` bytes or a number that isn't finite."""
    text = F.to_json(value)
    return F.when((F.octet_length(text) <= most) & ~text.rlike(r'"(?:NaN|-?Infinity)"'), text)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest run of codes that stands in both; the first of equal ones in a, then in b."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b, a, "left", sorter=order), np.searchsorted(b, a, "right", sorter=order)
    if (high - low).max(initial=0) == 0:
        return 0, 0, 0
    if (high - low).max() == 1:  # a line of a has one place in b: runs are where places go on by one
        place = np.where(high > low, order[np.minimum(low, len(b) - 1)], -2)
        new = np.ones(len(a), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (place[1:] < 0)
        run = np.cumsum(new) - 1
        lengths = np.bincount(run, weights=place >= 0)
        i = int(np.flatnonzero(new)[lengths.argmax()])
        return i, int(place[i]), int(lengths.max())
    best = (0, 0, 0)
    ending, last = np.zeros(len(b) + 1, np.int64), order[:0]
    for i in range(len(a)):  # lines with several places: lengths of the runs that end at each of them
        here = order[low[i] : high[i]]
        values = ending[here] + 1
        ending[last + 1] = 0
        ending[here + 1] = values
        last = here
        if len(here) and values.max() > best[2]:
            k = int(values.argmax())
            size = int(values[k])
            best = (i - size + 1, int(here[k]) - size + 1, size)
    return best


def _in_order(a: np.ndarray, b: np.ndarray) -> int | None:
    """How many codes of a stand in b, if each has one place there and the places ascend; else None. Blocks then never cross, so all of these codes are in some block."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b, a, "left", sorter=order), np.searchsorted(b, a, "right", sorter=order)
    if (high - low).max(initial=0) > 1:
        return None
    places = order[low[high > low]]
    return len(places) if (np.diff(places) > 0).all() else None


def _delta(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(added, removed) codes outside the longest matching blocks, taken again and again on both sides of the longest one; ranges whose codes are in order are counted at once."""
    same, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        ordered = _in_order(a[alo:ahi], b[blo:bhi])
        if ordered is not None:
            same += ordered
            continue
        i, j, size = _longest(a[alo:ahi], b[blo:bhi])
        if size:
            same += size
            open_ += [(alo, alo + i, blo, blo + j), (alo + i + size, ahi, blo + j + size, bhi)]
    return len(b) - same, len(a) - same


def line_delta(before: Column, after: Column) -> Column:
    """(added, removed): lines that differ between two texts, by longest matching blocks; null where one text is.

    Lines of a batch are coded as numbers first, and blocks are found by arrays of them; Spark has no line diff of its own.
    """

    @F.pandas_udf("added long, removed long")
    def lines(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known = a.notna() & b.notna()
        split = [x.splitlines() for side in (a[known], b[known]) for x in side]
        sizes = [len(x) for x in split]
        codes = pa.array([x for own in split for x in own], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        parts = np.split(codes, np.cumsum(sizes)[:-1]) if sizes else []
        n = len(parts) // 2
        out = pd.DataFrame({"added": pd.array([None] * len(a), "Int64"), "removed": pd.array([None] * len(a), "Int64")})
        if n:
            out.loc[known.to_numpy(), ["added", "removed"]] = [_delta(parts[k], parts[n + k]) for k in range(n)]
        return out

    return lines(before, after)


def aliases(messages: Column, model_call_id: Column) -> Column:
    """Distinct ids by which a call is known: those of its tool calls and its own."""
    parts = F.flatten(F.transform(messages, lambda m: m["parts"]))
    ids = F.transform(F.filter(parts, lambda p: p["type"] == "tool_call"), lambda p: p["id"])
    return F.array_sort(F.array_compact(F.array_distinct(F.concat(F.coalesce(ids, F.array().cast("array<string>")), F.array(model_call_id)))))
