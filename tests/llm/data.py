"""Documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, id string, rest int, kept string"

PASSAGE = " ".join(f"shared{i} Über{i}" for i in range(40))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "A one TWO three four"), (6, "a One two three four"),
        (7, PASSAGE), (8, f"start {PASSAGE}\nend"), (9, PASSAGE), (9, PASSAGE), (10, long), (11, long + " tail"),
        (None, PASSAGE), (None, "lonely words of nobody at all"), (12, "ab" * 300), (13, "日本語 é ß 🙂 " * 30),
        (14, "x" * 400), (15, long[100:]), (15, long[100:]), (16, "\n".join(["same line here"] * 12)),
    ]
    rows = [(i, t, "en" if n % 3 else None, None, n, n % 2, "z", 1, "no") for n, (i, t) in enumerate(texts)]
    return rows


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def brute_substring(rows, size=50):
    """(id, text) to (id, words, removed, digest)."""
    split = [(i, words(t)) for i, t in rows]
    first: dict = {}
    for i, w in split:
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < order(i):
                keep[p : p + size] = [False] * size
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def brute_bytes(rows, size=100):
    """(id, text) to (id, bytes, removed, spans, digest)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first: dict = {}
    for i, x in raw:
        for p in range(len(x) - size + 1):
            key, at = x[p : p + size], (order(i), p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, x in raw:
        gone = [False] * len(x)
        for p in range(len(x) - size + 1):
            if first[x[p : p + size]] < (order(i), p):
                gone[p : p + size] = [True] * size
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def shingles(text, size=5):
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = [x.translate(table) for x in words(text)]
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[p : p + size]) for p in range(len(w) - size + 1))


def brute_near(rows, percent=85):
    """(id, text) to (id, shingles, component, kept)."""
    sets = [(i, shingles(t)) for i, t in rows]
    above = {i: i for i, _ in sets if i is not None}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    holders = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        both = Counter(m for g in s for m in holders[g])
        for m, common in both.items():
            j, t = sets[m]
            if 100 * common >= percent * (len(s) + len(t) - common):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(n)
    return sorted(
        ((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets),
        key=lambda r: (order(r[0]), r[1]),
    )


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (order(r[0]), r[1:] if None not in r else ()))
