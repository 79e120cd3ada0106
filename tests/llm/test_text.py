import random
from collections import Counter

import data
import numpy as np
import pyarrow as pa
import pytest
from layerscan.llm import benchmarks, language, pieces, quality, wordpiece
from layerscan.llm.vocabulary import PIECE_MODEL, read_pieces, read_wordpieces


def brute_counts(text):
    text = text or ""
    words = [w.decode() for w in data.words(text)]
    grams = Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4))
    again = [False] * len(words)
    for p in range(len(words) - 4):
        if grams[tuple(words[p : p + 5])] > 1:
            again[p : p + 5] = [True] * 5
    lines = [x for x in text.split("\n") if data.words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * sum(again) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(again), failed


def check_counts(docs, model):
    rows = quality.judge(docs, model, ("text",)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == brute_counts(r.rest.text)
        assert r.kept == (not r.base_failed and (r.p_good is None or r.p_good >= quality.THRESHOLD))


def test_base_counts(odd, none, documents):
    check_counts(odd, None)
    check_counts(documents, None)
    assert quality.judge(none, None).collect() == []


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    check_counts(docs.limit(50), model)
    judged = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = [r.kept == (r.quality == 1) for r in judged]
    assert np.mean(right) > 0.95 and len(right) > 100
    # A probability of good means what it says, in the large.
    assert abs(np.mean([r.p_good for r in judged]) - np.mean([r.quality for r in judged])) < 0.08


def test_quality_without_two_classes(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (6, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, labels) is None


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_pieces_like_the_library(library):
    encoder = pieces.Encoder(read_pieces(PIECE_MODEL))
    rnd = random.Random(1)
    parts = [*"abcdethesnrionxyz", " ", " ", " ", "\n", "\t", "é", "日", "▁", "🙂", "  ", "\x00", "ing", "1", "----", "=" * 20, " " * 37]
    for n in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        ids = np.frombuffer(encoder.encode(pieces._marked(text)), np.int32).tolist()
        assert ids == library.encode(text)
        assert encoder.decode(ids) == library.decode(ids)


def test_max_plus_chunks_like_the_library(library):
    encoder = pieces.Encoder(read_pieces(PIECE_MODEL))
    rnd, margin = random.Random(2), 2 * encoder.longest
    parts = [*"abcdethesnrion", "the", "日", "=", " ", "\n"]
    for n in range(120):
        text = "".join(rnd.choice(parts[: 16 if n % 2 else 18]) for _ in range(rnd.randint(80, 300)))
        marked, size, cut = pieces._marked(text), rnd.choice([20, 33, 90]), []
        for a in range(0, len(marked), size):
            b = min(a + size, len(marked))
            low = max(0, a - margin)
            cut.append((marked[low : b + margin], a - low, b - low))
        made = [encoder.matrix(*c) for c in cut]
        table = pa.table({"uid": [1] * len(cut), "chunk": range(len(cut)), "n": [len(m) for m in made], "matrix": [m.tobytes() for m in made]})
        chosen = pieces._choose(table)
        states = zip(cut, chosen["enter"].to_pylist(), chosen["leave"].to_pylist())
        ids = np.frombuffer(b"".join(encoder.trace(*c, i, j) for c, i, j in states), np.int32).tolist()
        assert ids == library.encode(text)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.5, -np.inf, 0.0) for s in ((3, 4), (4, 5), (5, 2)))
    assert (pieces.times(pieces.times(a, b), c) == pieces.times(a, pieces.times(b, c))).all()


def test_neighbours_are_judged_without_merging_each_pair(monkeypatch):
    merged, calls = pieces.Encoder.merged, []
    monkeypatch.setattr(pieces.Encoder, "merged", lambda self, text, *rest: calls.append(text) or merged(self, text, *rest))
    encoder, rnd = pieces.Encoder(read_pieces(PIECE_MODEL)), random.Random(3)
    some = [p for p in encoder.pieces if len(p) < 5][:60]
    found = {(x, y): encoder.may_follow(x, y) for x in some for y in some}
    assert len(calls) <= len(some)
    assert all(ok == (merged(encoder, x + y) == [x, y]) for (x, y), ok in found.items())
    # Vocabularies with ties, scores that rise, and pieces that merging does not make.
    for n in range(300):
        names = ["a", "b", *{"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 5))) for _ in range(8)}]
        scored = {p: (i, -float(rnd.randint(1, 7))) for i, p in enumerate(names)}
        small = pieces.Encoder({"pieces": scored, "bytes": {}, "unknown": 0})
        assert all(small.may_follow(x, y) == (merged(small, x + y) == [x, y]) for x in names for y in names)


def test_plain_spaces_like_marked_ones(monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 50)
    monkeypatch.setattr(pieces, "HEADS", 20)
    encoder, rnd = pieces.Encoder(read_pieces(PIECE_MODEL)), random.Random(4)
    plain = pieces.Encoder(read_pieces(PIECE_MODEL))
    for n in range(200):
        text = "".join(rnd.choice([*"abcdethesnrion日🙂", " ", " ", "\n", "▁", "the", "\x00"]) for _ in range(rnd.randint(1, 60)))
        assert encoder.encode(pieces._marked(text)) == plain.encode(" " + text)
        assert encoder.n_follows <= 50


def test_encode_rows(odd, none, library):
    got = pieces.encode(odd, carry=("text", "rest"), chunk=500).collect()
    assert len(got) == odd.count()
    for r in got:
        text = r.rest.text
        assert r.ids == (None if text is None else library.encode(text)) and r.decoded == text
    back = pieces.decode(pieces.encode(odd.where("doc_id in (1, 2, 13)"))).collect()
    assert {r.id: r.decoded for r in back} == {r.doc_id: r.text for r in odd.where("doc_id in (1, 2, 13)").collect()}
    assert pieces.encode(none).collect() == []


def brute_pieces(word, first, rest):
    at = count = 0
    while at < len(word):
        allowed = rest if at else first
        end = next((j for j in range(len(word), at, -1) if word[at:j] in allowed), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


def test_longest_match_automaton():
    rnd = random.Random(4)
    for _ in range(60):
        first = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(8)}
        rest = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(8)}
        automaton = wordpiece.Automaton(sorted(first), sorted(rest))
        for _ in range(80):
            word = "".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randint(1, 14)))
            assert automaton.count(word) == brute_pieces(word, first, rest), (word, first, rest)


def test_token_counts(odd, none, documents):
    first, rest = map(set, read_wordpieces(PIECE_MODEL))
    for docs in (odd, documents):
        expected = Counter()
        for r in docs.collect():
            counts = [brute_pieces(w.decode(), first, rest) for w in data.words(r.text)]
            expected[r.doc_id, len(counts), sum(c or 1 for c in counts), counts.count(0)] += 1
        assert Counter(map(tuple, wordpiece.count_report(docs).collect())) == expected
    assert wordpiece.count_report(none).collect() == []


def test_listed_word_pieces(tmp_path):
    (tmp_path / "vocab.txt").write_text("un\n##aff\n##able\nrun\n##s\n")
    automaton = wordpiece.Automaton(*read_wordpieces(str(tmp_path / "vocab.txt")))
    assert [automaton.count(w) for w in ("unaffable", "runs", "able", "unx")] == [3, 2, 0, 0]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.language_report(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(told) and len(held) > 250
    assert np.mean([r.lang_pred == told[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, none):
    rows = {(r.doc_id, r.held_out): r for r in language.language_report(odd).collect()}
    by_id = {k[0]: r for k, r in rows.items()}
    assert {by_id[i].lang_pred for i in (1, 2, 3)} == {"und"} and by_id[1].score == 0
    assert by_id[7].lang_pred == "en" and not by_id[None].held_out
    assert language.language_report(none).collect() == []


def test_backoff_to_shorter_grams():
    model = language.Model(language.tables({"xx": Counter({"walking": 5, "talking": 5}), "yy": Counter({"gehen": 5, "sehen": 5})}))
    for word in ("stalking", "kin"):
        assert model.languages[int(model.score(word).argmax())] == "xx"
    assert model.languages[int(model.score("wehen").argmax())] == "yy"
    assert not model.score("qqq").any()


ITEM = "Alice sold 12 apples to Bob and then Alice gave 12 pears away"


def leaks(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {r.doc_id: r.item_ids for r in benchmarks.find_leaks(docs, bench).collect()}


def test_templates_and_slots(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "45")
    broken = ITEM.replace("then Alice", "then Erika").replace("gave 12", "gave 7")
    texts = [ITEM, f"x y {other} z", broken, ITEM.replace("apples", "plums").replace("pears", "figs"), "", None, ITEM.lower()]
    got = leaks(spark, texts)
    assert got[0] == got[1] == [1]
    assert got[2] == got[3] == got[4] == got[5] == []
    assert got[6] == [1]


def test_copies_of_any_case_and_of_many_slots(spark):
    dense = "Paris 1889 London 1851 Vienna 1873 Chicago 1893 Brussels 1910 Osaka 1970 Seville 1992 Hanover 2000 Milan 2015"
    items = [(1, ITEM), (2, dense), (3, "Die größte Straße in Köln Über Élan"), (4, "日本の首都はどこですか答えよ"), (5, "東京は")]
    texts = [
        ITEM.title(), ITEM.upper(), f"so {ITEM.lower()} it", dense, f"then {dense.lower()}.", dense.replace("1889", "1900").replace("1851", "1901"),
        "die grösste", "DIE GRÖSSTE STRASSE IN KÖLN ÜBER ÉLAN", "問題:日本の首都はどこですか答えよ。正解は東京", "日本の首都 x はどこですか答えよ", "東京は",
    ]
    got = leaks(spark, texts, items)
    assert [got[i] for i in range(len(texts))] == [[1], [1], [1], [2], [2], [2], [], [3], [4], [], []]


def test_words_without_spaces():
    text = "a日b本, 語:。x 𠀀 ，y".encode()
    words = benchmarks._Trimmed(np.frombuffer(text + text, np.uint8), np.array([0, len(text), 2 * len(text)]))
    found = [(text + text)[a:b].decode() for a, b in zip(words.starts, words.ends)]
    assert found == [*"a日b本語。x𠀀", "，y"] * 2 and words.first.tolist() == [0, 9, 18]


def test_short_items_and_ties(spark):
    items = [(1, "only six words stand in here"), (2, "too short"), (3, ITEM), (4, ITEM), (None, ITEM), (5, None)]
    got = leaks(spark, ["only six words stand in here today", "too short", ITEM], items)
    assert got == {0: [1], 1: [], 2: [3]}
    assert leaks(spark, [ITEM], [])[0] == []


def test_slices_of_the_benchmark(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{data.SMALL}/benchmark.parquet")
    whole = {r.doc_id: r.item_ids for r in benchmarks.find_leaks(documents, bench).collect()}
    monkeypatch.setattr(benchmarks, "SLICE_KEYS", 150)
    assert {r.doc_id: r.item_ids for r in benchmarks.find_leaks(documents, bench).collect()} == whole
    assert any(whole.values())


def test_leaks_by_brute_force(documents, spark):
    bench = spark.read.parquet(f"{data.SMALL}/benchmark.parquet")
    plain = lambda t: [w.decode().strip(".,;:!?\"'()").lower() for w in data.words(t)]
    windows = {}
    for r in bench.collect():
        w = plain(r.text)
        for p in range(len(w) - 12):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(r.item_id)
    for r in benchmarks.find_leaks(documents, bench).collect():
        w = plain(r.text)
        found = set().union(*(windows.get(tuple(w[p : p + 13]), ()) for p in range(len(w) - 12)))
        assert found <= set(r.item_ids)
        # Other numbers and names may add items, which share no plain window here.
        assert bool(found) == bool(r.item_ids)


def test_leaks_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, data.PASSAGE)], "item_id long, text string")
    rows = benchmarks.find_leaks(odd, bench, ("rest", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.item_ids == [1]) == (data.PASSAGE in (r.text or ""))
    assert benchmarks.find_leaks(none, bench).collect() == []
