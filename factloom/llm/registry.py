"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, filter_audit, html_text, license_scan, minhash, ngram_lm, resampling, secret_scan, token_files, toxicity, vector_dedup, window_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": ngram_lm.op1_lm,
        "op2_licenses": license_scan.op2_licenses,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_files": token_files.op5_token_files,
        "op6_vectors": vector_dedup.op6_vectors,
        "op7_html_text": html_text.op7_html_text,
        "op8_bpe": bpe.op8_bpe,
        "op9_minhash": minhash.op9_minhash,
        "op10_secrets": secret_scan.op10_secrets,
        "op11_resample": resampling.op11_resample,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_substrings": window_dedup.op13_substrings,
    }


_COMPONENTS = """r AS (SELECT id, id AS other FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)"""

#: All pairs of valid vectors.
_VECTORS = f"""WITH RECURSIVE d AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings),
v AS (SELECT * FROM d WHERE v IS NOT NULL AND len(v) > 0 AND NOT list_contains(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)), false) AND list_contains(list_transform(v, lambda x: x <> 0), true)),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95::double), {_COMPONENTS},
n AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n USING (id)"""

#: All pairs of documents that share a shingle.
_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT id, len(s) AS n, unnest(s) AS s FROM d), p AS (SELECT a.id AS a, b.id AS b, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.id <> b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (n + m - k)), {_COMPONENTS}
SELECT id AS doc_id, len(s) AS n_shingles, component_id, id = component_id AS kept FROM d JOIN c USING (id)"""

_BYTES = "list_transform(range(0, strlen(f)), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::bigint)"

#: CRC-32 bit by bit for the table of bytes, then byte by byte over every distinct feature.
_RESAMPLE = f"""WITH RECURSIVE z AS (SELECT i AS b, i::bigint AS x, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM z WHERE k < 8),
tab AS (SELECT list(x ORDER BY b) AS tab FROM z WHERE k = 8),
d AS (SELECT true AS own, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT false, item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT own, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
f AS (SELECT own, row, f, count(*) AS n FROM (SELECT own, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w) GROUP BY ALL),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM f), tab),
m AS (SELECT own, row, bucket, sum(n) AS n FROM f JOIN c USING (f) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::double AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::double AS t FROM m GROUP BY bucket),
o AS (SELECT coalesce(sum(s), 0) AS total_s, coalesce(sum(t), 0) AS total_t FROM g),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * (total_s + 10000) / ((s + 1) * (total_t + 10000))))::bigint AS gain FROM g, o),
x AS (SELECT row, sum(n * gain)::bigint AS weight FROM m JOIN v USING (bucket) WHERE own GROUP BY row),
r AS (SELECT doc_id, len(w) AS words, greatest(3 * len(w) - 3, len(w)) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM w LEFT JOIN x USING (row) WHERE own),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS of FROM q)
SELECT doc_id, n_features::bigint AS n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * of // 100 THEN place END AS rank FROM p"""

_FAIL = {"a": "len(w) < 50", "b": "100 * len(list_distinct(w)) < 65 * len(w)", "c": "100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x)", "d": "regexp_matches(x, '[#$%&*|]')", "e": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)"}

#: Each order of the letters applied step by step to every class of documents.
_AUDIT = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, {', '.join(f"CASE WHEN {c} THEN '{k.upper()}' ELSE '' END AS {k}" for k, c in _FAIL.items())}, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
k AS (SELECT part, a || b || c || d || e AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
p AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(filter_order, letter)),
s AS (SELECT filter_order, step::int AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM p, range(1, 6) t(step) WHERE length(filter_order) = 5),
c AS (SELECT *, contains(fails, own) AS hit, length(before) > 0 AND regexp_matches(fails, '[' || before || '.]') AS gone FROM k, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::bigint AS removed,
  sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::bigint AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::bigint AS toxic_lost
  FROM c GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::bigint AS shapley FROM r"""

#: Every window as a digest of its words; a word goes if one of the 20 windows that cover it starts earlier too.
_SUBSTRINGS = f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, hash(text)) AS row, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT row, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
y AS (SELECT row, k, word, CASE WHEN lead(word, 19) OVER o IS NOT NULL THEN md5(concat_ws(' ', word, {', '.join(f'lead(word, {i}) OVER o' for i in range(1, 20))})) END AS own FROM x WINDOW o AS (PARTITION BY row ORDER BY k)),
z AS (SELECT row, k, word, own IS NOT NULL AND row_number() OVER (PARTITION BY own ORDER BY row, k) > 1 AS late FROM y),
g AS (SELECT row, k, word, bool_or(late) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM z),
s AS (SELECT row, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS text FROM g GROUP BY row)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN s USING (row)"""


def oracle_sql() -> dict[str, str]:
    """Operators whose rows DuckDB can compute in reasonable time on whole tables; those on pairs by all pairs."""
    return {"op6_vectors": _VECTORS, "op9_minhash": _NEAR, "op11_resample": _RESAMPLE, "op12_filter_audit": _AUDIT, "op13_substrings": _SUBSTRINGS}
