"""Resampling against brute force; the radix sort against a plain sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import data
import pytest
from layerscan.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def found(text, run):
    words = WORD.findall((text or "").encode().translate(LOWER))
    grams = [b" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g) % 10000 for g in grams]


def brute(rows, target, run=1, percent=10):
    own = [(i, *found(t, run)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, buckets in own:
        s.update(buckets)
    for text in target:
        t.update(found(text, run)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, n, buckets in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        out.append((i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    usable = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], data.order(r[0]), r[2]))
    drawn = usable[: len(usable) * percent // 100]
    rest = usable[len(drawn) :] + [r for r in out if r[1] < 20]
    return sorted([(*r, n + 1) for n, r in enumerate(drawn)] + [(*r, None) for r in rest], key=repr)


def check(docs, target, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, resampling.resample(docs, target, **options).collect()), key=repr)
    names = {k: v for k, v in options.items() if k in ("run", "percent")}
    assert got == brute(rows, [r.text for r in target.select("text").collect()], **names)
    return got


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{data.SMALL}/benchmark.parquet")


def test_documents(documents, target):
    got = check(documents, target)
    assert 10 < sum(r[5] is not None for r in got) < 21


def test_odd_rows(odd, none, target, spark):
    check(odd, target, percent=60)
    check(odd, none, percent=100)
    assert check(none, target) == []


def test_runs_of_words_in_stretches(documents, target, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 50)
    monkeypatch.setattr(resampling, "MEMORY", 100)
    check(documents, target, run=3)


def test_radix_ranks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 16)
    monkeypatch.setattr(resampling, "DIGIT", 5)
    rnd = random.Random(3)
    rows = [(rnd.choice([None, rnd.randrange(-500, 500), -(1 << 40)]), rnd.choice([None, rnd.randrange(9)]), i) for i in range(700)]
    out = resampling.radix_ranks(
        spark.createDataFrame(rows, "a long, b long, c long").repartition(5), [("a", True), ("b", False), ("c", True)]
    )
    got = [tuple(r)[:3] for r in sorted(out.collect(), key=lambda r: r.rank)]
    last = lambda x: (x is None, x or 0)
    assert got == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), last(r[1]), -r[2]))
    assert sorted(r.rank for r in out.collect()) == list(range(1, 701))
