"""Language identification: known words first, then shorter and shorter n-grams.

A word that the training texts know is scored by its log frequency in each
language. An unseen word is scored by its character n-grams of the greatest
length of which any is known. A text's language has the greatest sum, and its
score is the share of that language in the likelihood.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.words import kept_model

#: Bound on the training documents: those whose id hashes are least.
SAMPLE = 4096
GRAMS = (5, 4, 3, 2, 1)
#: Pseudo count of what a language has not shown.
FLOOR = 0.5
#: Words whose scores a Python worker remembers at once.
MEMORY = 200_000
UNKNOWN = "und"


def letters(word: str) -> str:
    """The word in lower case without its non-letters."""
    return "".join(c for c in word.lower() if c.isalpha())


def word_grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def tables(counts: dict[str, Counter]) -> dict:
    """Languages, and log frequencies in each of words and n-grams seen twice or more."""
    languages = sorted(counts)

    def table(parts) -> dict[str, np.ndarray]:
        seen: dict[str, list] = {}
        for i, language in enumerate(languages):
            for word, n in counts[language].items():
                for part in parts(word):
                    seen.setdefault(part, [0] * len(languages))[i] += n
        total = [sum(v[i] for v in seen.values()) + FLOOR * (len(seen) + 1) for i in range(len(languages))]
        return {
            part: np.array([math.log((n + FLOOR) / t) for n, t in zip(values, total)], np.float32)
            for part, values in seen.items()
            if sum(values) >= 2
        }

    grams = [table(lambda w, n=n: word_grams(w, n)) for n in GRAMS]
    return {"languages": languages, "words": table(lambda w: [w]), "grams": grams}


class Model(dict):
    """Scores of words by learned ``tables``; remembers words."""

    def __init__(self, learned: dict):
        super().__init__()
        self.languages, self.words, self.grams = learned["languages"], learned["words"], learned["grams"]
        self.rows: list[np.ndarray] = []

    def score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for n, table in zip(GRAMS, self.grams):
            found = [table[g] for g in word_grams(word, n) if g in table]
            if found:
                return np.sum(found, axis=0)
        return np.zeros(len(self.languages), np.float32)

    def __missing__(self, raw: bytes) -> int:
        """Row of a raw word's scores; row 0 is a word without letters."""
        if not self.rows:
            self.rows.append(np.zeros(len(self.languages), np.float32))
        word = letters(raw.decode())
        self[raw] = at = len(self.rows) if word else 0
        if word:
            self.rows.append(self.score(word))
        return at

    def forget(self) -> None:
        self.clear()
        self.rows.clear()


def _model(learned: dict | None) -> Model | None:
    """The worker's model of broadcast tables."""
    return None if learned is None else kept_model("language", learned, lambda: Model(learned))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Tables of at most ``sample`` documents with a language that are not held out."""
    usable = docs.where(~_held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = (
        usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.lang", "row.text")
    )

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen[lang].update(filter(None, map(letters, text.split())))
            for lang, words in seen.items():
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())}
                )

    counted = texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in counted.collect():
        counts[lang][word] = n
    return tables(counts) if counts else None


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, learned: dict | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. Equal sums go to the first language in order of name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            names, shares = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                if model is None or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                if len(model) > MEMORY:
                    model.forget()
                rows = list(map(model.__getitem__, text.encode().split()))
                used, times = np.unique(rows, return_counts=True)
                total = np.zeros(len(model.languages))
                for i in range(0, len(used), 4096):
                    total += times[i : i + 4096] @ np.array([model.rows[r] for r in used[i : i + 4096]], np.float64)
                best = int(total.argmax())
                names.append(model.languages[best])
                shares.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """``op9``: language of each document, learned from those not held out.

    A row without an id teaches nothing and is not held out.
    """
    found = identify(docs, train(docs))
    return found.select(
        "doc_id", (_held_out("doc_id") & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score"
    )
