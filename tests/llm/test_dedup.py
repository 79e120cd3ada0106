import random

import data
import numpy as np
from layerscan.llm import anchors, minhash, suffixes
from layerscan.llm.components import components
from layerscan.llm.words import Words, mix, text_bytes
import pyarrow as pa


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def random_texts(spark, count, vocabulary, low, high, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(low, high)))
        if i and rnd.random() < 0.6:
            old = rows[rnd.randrange(i)][1]
            a = rnd.randrange(len(old) // 2)
            text = f"{text} {old[a : a + rnd.randint(50, 900)]} {text[:30]}"
        rows.append((i * 7 % 101, text))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_words_as_defined():
    texts = ["", None, " a  bc\t", "é\x0b日本\n", "no-break space", "x" * 3, "  "]
    data_, bounds = text_bytes(pa.array(texts))
    found = Words(data_, bounds)
    got = [
        [found.data[s:e].tobytes() for s, e in zip(found.starts[a:b], found.ends[a:b])]
        for a, b in zip(found.first[:-1], found.first[1:])
    ]
    assert got == [data.words(t) for t in texts]
    hashes = Words(*text_bytes(pa.array(["ab cd", "cd ab ab"]))).hashes()
    assert hashes[0] == hashes[3] == hashes[4] != hashes[1] == hashes[2]


def test_substring_dedup_odd_rows(odd, none):
    assert sorted(map(tuple, anchors.dedup_report(odd).collect()), key=lambda r: (data.order(r[0]), r[1:])) == data.brute_substring(pairs(odd))
    assert anchors.dedup_report(none).collect() == []


def test_substring_dedup_random(spark):
    docs = random_texts(spark, 60, ["a", "b", "cc", "Dd"], 5, 150, 1)
    got = sorted(map(tuple, anchors.dedup_report(docs).collect()), key=lambda r: (data.order(r[0]), r[1:]))
    assert got == data.brute_substring(pairs(docs))
    assert sum(r[2] for r in got) > 0


def test_substring_dedup_as_it_is(odd):
    out = anchors.substring_dedup(odd, carry=("lang", "rest"), rejoin=False).where("n_removed = 0 and id = 3").collect()
    assert out[0].kept_text == " \t\n " and out[0].rest.rest == 1


def test_suffix_array_sorts():
    rng = np.random.default_rng(3)
    for buckets in (1024, 2):
        suffixes.BUCKETS = buckets
        for _ in range(120):
            s = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(1, 150)), 0].astype(np.int16)
            expected = sorted(range(len(s)), key=lambda i: s[i:].tolist())
            assert suffixes.suffix_array(s, 1 << 20).tolist() == expected
    suffixes.BUCKETS = 1024


def test_suffix_dedup_odd_rows(odd, none):
    got = sorted(map(tuple, suffixes.suffix_report(odd).collect()), key=lambda r: (data.order(r[0]), r[1:]))
    assert got == data.brute_bytes(pairs(odd))
    assert suffixes.suffix_report(none).collect() == []


def test_suffix_dedup_random(spark):
    docs = random_texts(spark, 40, ["a", "bé", "cc"], 30, 200, 2)
    got = sorted(map(tuple, suffixes.suffix_report(docs).collect()), key=lambda r: (data.order(r[0]), r[1:]))
    assert got == data.brute_bytes(pairs(docs))
    assert sum(r[2] for r in got) > 0


def test_suffix_dedup_of_hot_hashes(odd, spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 0)
    for docs in (odd, random_texts(spark, 40, ["a", "bé", "cc"], 30, 200, 2)):
        got = sorted(map(tuple, suffixes.suffix_report(docs).collect()), key=lambda r: (data.order(r[0]), r[1:]))
        assert got == data.brute_bytes(pairs(docs))


def test_suffix_dedup_deals_a_common_phrase(spark):
    rnd = random.Random(5)
    own = lambda: "".join(rnd.choice("bcdefgh") for _ in range(120))
    rows = [(i, f"{own()} a phrase that a third of all documents hold, word for word {own() if i % 5 else 'z' * 120}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffixes.suffix_report(docs).collect()))
    assert got == data.brute_bytes(rows) and sum(r[2] for r in got) > 0
    n = suffixes.X.sides(docs, "text", 2000)
    sent = suffixes._sharded(suffixes.X.chunked(docs, "doc_id", "text", (), n), n, 100).groupBy("bucket")
    sizes = [r[1] for r in sent.agg(suffixes.F.sum(suffixes.F.expr("octet_length(keys) + octet_length(extra)"))).collect()]
    assert max(sizes) < 3 * sum(sizes) / n


def near(docs, **options):
    out = minhash.near_duplicates(docs, **options).collect()
    return sorted(map(tuple, out), key=lambda r: (data.order(r[0]), r[1]))


def test_near_duplicates_odd_rows(odd, none):
    assert near(odd) == data.brute_near(pairs(odd))
    assert near(none) == []


def test_near_duplicates_documents(documents):
    assert near(documents, percent=80) == data.brute_near(pairs(documents), 80)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains of edits, so that buckets hold several components at first."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(5)
    rows, i = [], 0
    for base in range(3):
        text = [f"t{base}w{n}" for n in range(120)]
        for _ in range(40):
            rows.append((i, " ".join(text)))
            text = list(text)
            for _ in range(rnd.randint(1, 4)):
                text[rnd.randrange(120)] = f"e{rnd.random()}"
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(docs) == data.brute_near(rows)


def test_posterior_bounds():
    for n, least in minhash.least_matches(85):
        assert 0 < least < 0.85 * n
    sets = [mix(np.arange(i, i + 400, dtype=np.uint64)) for i in (1, 16, 300)]
    signs = np.array([minhash.signature(s) for s in sets])
    assert minhash.plausible(signs[:1], signs[1:], minhash.least_matches(85)).tolist() == [0]


def test_components_of_random_graphs(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    edges += [(500, i) for i in range(501, 560)] + [(600, 600), (None, 1)]
    above = {}

    def top(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges[:-1]:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: top(x) for x in above}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_window_hashes_do_not_depend_on_slices(monkeypatch):
    from layerscan.llm import words

    hashes = mix(np.arange(5000, dtype=np.uint64))
    first = np.array([0, 1700, 1703, 5000])
    whole = words.window_hashes(hashes, first, 50)
    monkeypatch.setattr(words, "SLICE", 64)
    cut = words.window_hashes(hashes, first, 50)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and len(whole[0]) == 5000 - 3 - 49 * 2


def test_a_process_keeps_one_model():
    from layerscan.llm.words import kept_model

    made = []
    make = lambda name: lambda: made.append(name) or name
    source = object()
    assert kept_model("a", source, make("a")) == kept_model("a", source, make("a")) == "a" and made == ["a"]
    assert kept_model("b", source, make("b")) == "b" and kept_model("a", source, make("a2")) == "a2"
    assert made == ["a", "b", "a2"]
