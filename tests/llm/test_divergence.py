"""The divergence audit against brute force."""

import re
from collections import Counter, defaultdict

from layerscan.llm import divergence
from pyspark.sql import functions as F

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute(rows, least_docs, top):
    """(lang, source, text) to sorted result rows."""
    found, holders, groups = defaultdict(Counter), defaultdict(set), set()
    for n, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in TERM.findall((text or "").encode()):
            term = term.translate(LOWER)
            found[lang, source][term] += 1
            holders[lang, term].add(n)
    kept = defaultdict(list)
    for (lang, term), who in holders.items():
        if len(who) >= least_docs:
            kept[lang].append(term)

    def shares(lang, counts):
        total, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept[lang]}

    p = {g: shares(g[0], found[g]) for g in groups}
    out = []
    for lang, source in groups:
        q = shares(lang, sum((found[g] for g in groups if g[0] == lang), Counter()))
        own = p[lang, source]
        pairs = [
            (-sum(abs(own[t] - p[g][t]) for t in own), g[1].encode()) for g in groups if g[0] == lang and g[1] != source
        ]
        terms = [(q[t] - own[t], t) for t in own if found[lang, source][t] and own[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(out)


def check(docs, least_docs, top=50):
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    got = sorted(map(tuple, divergence.audit(docs, least_docs, top).collect()))
    assert got == brute(rows, least_docs, top)
    return got


def test_documents(documents):
    got = check(documents, 12, 20)
    assert {r[2] for r in got} == {"pair", "term"}


def test_odd_rows(odd, none):
    assert check(odd, 1) == []  # one source only
    several = odd.withColumn("source", F.when(F.col("n_chars") % 3 > 0, F.concat(F.lit("s"), F.col("n_chars") % 3)))
    assert check(several, 2)
    assert {r[4] for r in check(several, 100)} == {0}
    assert check(none, 1) == []


def test_tiles_blocks_and_pieces(documents, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 6)
    monkeypatch.setattr(divergence, "TERMS", 40)
    monkeypatch.setattr(divergence, "PIECE", 20_000)
    monkeypatch.setattr(divergence, "STRETCH", 100)
    check(documents, 8)


def test_prefixes_are_counted_by_document(spark):
    """Two terms of one document share a prefix; it counts once, and long terms need more levels."""
    rows = [(i, f"abcde{'x' * (i % 3)} abcdf ß{'y' * 40}", "en", "s") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.term for r in divergence.kept_terms(divergence.local_terms(docs), 4).collect()}
    assert kept == {"abcdf", "ß" + "y" * 40}
