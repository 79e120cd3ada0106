"""The PartEnum join against brute force."""

import random
import tracemalloc

import data
import numpy as np
import pyarrow as pa
from layerscan.llm import partenum, words

PAIRS = "doc_id long, text string"


def joined(docs, percent=80):
    out = partenum.jaccard_join(docs, percent=percent).collect()
    return sorted(map(tuple, out), key=lambda r: (data.order(r[0]), r[1]))


def brute(docs, percent=80):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    return [r[:3] for r in data.brute_near(rows, percent)]


def test_odd_rows(odd, none):
    assert joined(odd) == brute(odd)
    assert joined(none) == []


def test_a_task_holds_few_sets_at_once():
    rnd, names = random.Random(7), [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(names, k=300)) for _ in range(6000)]
    batch = pa.record_batch([pa.array(range(6000), pa.int64()), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in partenum._described(80, 3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 46 MB; 86 MB with the pieces of before.
    assert rows == 6000 and peak < 64 << 20


def test_large_groups_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "trim", lambda: calls.append(1))
    run = words.trimmed_group(lambda table: table.slice(0, 1))
    for n, trims in ((10, 0), (words.LARGE_GROUP, 1)):
        assert run(pa.table({"x": pa.array(np.zeros(n, np.int64))})).num_rows == 1 and len(calls) == trims


def test_documents(documents):
    assert joined(documents) == brute(documents)


def test_chains_and_short_texts(spark, monkeypatch):
    """Signatures of several components, and sets of a few features."""
    monkeypatch.setattr(partenum, "BLOCK", 8)
    monkeypatch.setattr(partenum, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(partenum, "STAR", 500)
    monkeypatch.setattr(partenum, "PIECE", 20_000)
    monkeypatch.setattr(partenum, "SMALL", 5)
    rnd, rows = random.Random(5), []
    for base in range(3):
        text = [f"t{base}w{n}" for n in range(120)]
        for _ in range(40):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rnd.randint(1, 6)):
                text[rnd.randrange(120)] = f"e{rnd.random()}"
    for _ in range(150):
        words = [rnd.choice("abc") for _ in range(rnd.randint(1, 40))]
        for _ in range(3):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rnd.randrange(len(words))] = rnd.choice("abcd")
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, PAIRS).repartition(4)
    for percent in (80, 60):
        got = joined(docs, percent)
        assert got == brute(docs, percent)
        assert 1 < len({r[2] for r in got}) < len(rows)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    tried = 0
    for n in [*range(1, 60)] * 10 + [int(x) for x in np.exp(rng.uniform(np.log(60), np.log(3000), 300))]:
        new = lambda k: rng.integers(0, 1 << 62, k).astype(np.uint64)
        left, both = new(n), int(n * rng.uniform(0.8, 1))
        right = np.r_[left[:both], new(int(rng.integers(0, n // 4 + 1)))]
        if 100 * both < 80 * (n + len(right) - both) or both == n == len(right):
            continue
        sign, owner = partenum.signatures(np.r_[left, right], np.array([0, n, n + len(right)]), 80)
        assert set(sign[owner == 0].tolist()) & set(sign[owner == 1].tolist())
        tried += 1
    assert tried > 200


def test_bands_hold_all_similar_sizes():
    bands = partenum.bands(2000, 80)
    for a in range(4, 1500):
        assert any(low <= a and a * 100 // 80 <= high for _, low, high, _ in bands)
