"""Plain versions of the operators' results, for tables that fit in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UP, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, DOWN)
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE_WORD.findall((text or "").translate(LOWER))


def crc(key) -> int:
    return zlib.crc32(str(key).encode())


def language_model(docs, order):
    """doc_id -> (n_tokens, n_known, N, base, score) by dictionaries: interpolated modified Kneser-Ney."""
    end, begin = object(), object()
    grams = lambda t: list(zip(*([*[begin] * (order - 1), *words(t), end][k:] for k in range(order))))
    counts = {order: Counter(g for d, t in docs if d is None or crc(d) % 7 != 2 for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    uni = Counter()
    for g, c in counts[order].items():
        uni[g[-1]] += c
    total, v = sum(uni.values()), len(uni)
    off, totals, rests = {}, {}, {}
    for n, own in counts.items():
        k = Counter(own.values())
        off[n] = [0.0, 0.5, 1.0, 1.5]
        if min(k[i] for i in (1, 2, 3, 4)) > 0:
            y = k[1] / (k[1] + 2 * k[2])
            d = [i - (i + 1) * y * k[i + 1] / k[i] for i in (1, 2, 3)]
            if all(0 < x < i for i, x in enumerate(d, 1)):
                off[n] = [0.0, *d]
        totals[n], rests[n] = Counter(), Counter()
        for g, c in own.items():
            totals[n][g[:-1]] += c
            rests[n][g[:-1]] += off[n][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (v + 1)
        n, lower = len(g), p(g[1:])
        if not totals[n][g[:-1]]:
            return lower
        c = counts[n].get(g, 0)
        return (max(c - off[n][min(c, 3)], 0) + rests[n][g[:-1]] * lower) / totals[n][g[:-1]]

    return {
        d: (len(w), sum(uni[x] > 0 for x in w), total, sum(math.log10((uni[x] + 1) / (total + v + 1)) for x in w), sum(math.log10(p(g)) for g in grams(t)))
        for d, t in docs for w in [[*words(t), end]]
    }


def licences(text):
    """(n_words, n_base, first, last, labels)."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


SECRETS = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secrets(text):
    """(counts of each kind, sha256 of the list)."""
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(SECRETS) for m in rx.finditer(text or "") if ok(m)]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    return *(sum(x[3] == kind for x in found) for kind, _, _ in SECRETS), hashlib.sha256(listed.encode()).hexdigest()


def shingle_set(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_duplicates(docs, size, percent=80):
    """doc_id -> (set size, component)."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def best_windows(docs, items, size=5):
    """(doc_id, item_id) -> the best similarity of an item-sized window's shingle multiset with the item's, over all windows."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1)))
    out = {}
    for d, t in docs:
        words = split(t)
        for i, x in items:
            item = split(x)
            want, n = bag(item), len(item)
            for k in range(max(len(words) - n, 0) + 1):
                got = bag(words[k : k + n])
                common = sum((got & want).values())
                out[d, i] = max(out.get((d, i), 0), common / (sum(got.values()) + sum(want.values()) - common))
    return out


def repeated_words(docs, size):
    """doc (place in the order of ids) -> (words, kept words)."""
    split = [SPACE_WORD.findall(t or "") for _, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for k, w in enumerate(split):
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[k].update(range(i, i + size))
            seen.add(key)
    return [(w, [x for i, x in enumerate(w) if i not in gone[k]]) for k, w in enumerate(split)]


def resampled(docs, target, percent, least, buckets=10_000, seed=42):
    """doc_id -> (features, weight, score, rank)."""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def counted(t):
        w = rx.findall((t or "").translate(LOWER))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))

    rows = {d: counted(t) for d, t in docs}
    s, t = (sum((c for _, c in x), Counter()) for x in (rows.values(), [counted(x) for x in target]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = {}
    for d, (n, c) in rows.items():
        weight = sum(k * gain[b] for b, k in c.items())
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = (n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    may = sorted((d for d, r in out.items() if r[0] >= least), key=lambda d: (-out[d][3], d))
    rank = {d: k + 1 for k, d in enumerate(may[: percent * len(may) // 100])}
    return {d: (n, w, s, rank.get(d)) for d, (_, n, w, s) in out.items()}


def audited(rows, letters):
    """(part, order, step) -> (kept, removed, redundant, unique, shapley) of (part, the letters it fails) rows, filter by filter."""
    from itertools import permutations

    out = {}
    for part in {p for p, _ in rows}:
        own = [f for p, f in rows if p == part]
        total = Counter()
        for order in permutations(letters):
            left = own
            for k, x in enumerate(order):
                removed = [f for f in left if x in f]
                left = [f for f in left if x not in f]
                total[x] += len(removed)
                out[part, "".join(order), k + 1] = (len(left), len(removed), sum(x in f for f in own) - len(removed), sum(set(f) == {x} for f in own))
        for (p, order, k), v in list(out.items()):
            if p == part:
                out[p, order, k] = (*v[:4], total[order[k - 1]])
    return out
