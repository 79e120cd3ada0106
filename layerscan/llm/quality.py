"""Quality rules: base counts and a calibrated logistic regression.

The regression reads hashed n-grams of words (one and two words) and of bytes
(one to four), each kind as its share of the text, so length does not count.
It is trained on at most ``SAMPLE`` labelled rows, those whose id hashes are
least; three quarters fit the weights, the rest the calibration of the score to
a probability. Texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.words import Words, covered, mix, slices, text_bytes, trimmed, window_hashes

#: Bound on the labelled rows that the model is trained on.
SAMPLE = 2000
#: Least probability of good quality that is kept.
THRESHOLD = 0.5
BITS = 16
BYTE_GRAMS, WORD_GRAMS = (1, 2, 3, 4), (1, 2)
KINDS = len(BYTE_GRAMS) + len(WORD_GRAMS)
PIECE = 2 << 20

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


def base_counts(data: np.ndarray, bounds: np.ndarray, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    code_point = (data & 0xC0) != 0x80
    steps = np.zeros(len(data) + 1, np.int8)
    steps[words.starts] += 1
    np.subtract.at(steps, words.ends, 1)
    inside = np.cumsum(steps[:-1]) > 0
    at, keys = window_hashes(hashes, words.first, REPEAT_WINDOW)
    keys = mix(keys + mix(words.text_of()[at].astype(np.uint64))) if len(at) else keys
    order = np.argsort(keys)
    new = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(at) else np.empty(0, np.int64)
    again = np.repeat(np.diff(np.r_[new, len(at)]) > 1, np.diff(np.r_[new, len(at)]))
    repeated = covered(at[order][again], REPEAT_WINDOW, len(words))
    # A line with a word counts if an earlier line of the text equals it.
    raw, doubles = data.tobytes(), np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        lines = raw[a:b].split(b"\n")
        if len(set(lines)) < len(lines):
            worded = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            doubles[i] = len(worded) - len(set(worded))
    return {
        "n_words": words.counts,
        "word_chars": _per_text(code_point & inside, bounds),
        "n_symbols": _per_text(_IS_SYMBOL[data], bounds),
        "n_dup_lines": doubles,
        "n_repeat_words": _per_text(repeated, words.first),
    }


def grams(data: np.ndarray, bounds: np.ndarray, words: Words, hashes: np.ndarray):
    """For each kind of n-gram: slot of each gram, and the grams of each text as ranges."""
    for n in BYTE_GRAMS:
        code = np.zeros(max(0, len(data) - n + 1), np.uint32)
        for i in range(n):
            code = (code << np.uint32(8)) | data[i : i + len(code)]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        yield slot, np.minimum(bounds[:-1], len(code)), np.clip(bounds[1:] - n + 1, 0, len(code))
    for n in WORD_GRAMS:
        at, keys = window_hashes(hashes, words.first, n)
        yield keys >> np.uint64(64 - BITS), np.searchsorted(at, words.first[:-1]), np.searchsorted(at, words.first[1:])


def scores(weights: np.ndarray, parts) -> np.ndarray:
    """Sum over kinds of the mean weight of a text's grams."""
    total = 0.0
    for kind, (slot, low, high) in enumerate(parts):
        sums = np.r_[0.0, np.cumsum(weights[kind][slot], dtype=np.float64)]
        size = np.maximum(high - low, 0)
        total = total + np.where(size > 0, sums[np.maximum(high, low)] - sums[low], 0.0) / np.maximum(size, 1)
    return total


def _pieces(batch: pa.RecordBatch, name: str = "text"):
    data, bounds = text_bytes(batch.column(name))
    for a, b in slices(bounds, PIECE):
        part = data[bounds[a] : bounds[b]]
        own = bounds[a : b + 1] - bounds[a]
        words = Words(part, own)
        yield a, b, part, own, words, words.hashes()


def _featured(batches):
    for batch in batches:
        for a, b, *parts in _pieces(batch):
            slots, shares = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
            for kind, (slot, low, high) in enumerate(grams(*parts)):
                for i in range(b - a):
                    if high[i] > low[i]:
                        own, count = np.unique(slot[low[i] : high[i]], return_counts=True)
                        slots[i].append(own.astype(np.int32) + (kind << BITS))
                        shares[i].append((count / (high[i] - low[i])).astype(np.float32))
            join = lambda x, kind: [np.concatenate([np.empty(0, kind), *y]).astype(kind).tobytes() for y in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(a, b - a), pa.array(join(slots, np.int32), pa.binary()), pa.array(join(shares, np.float32), pa.binary())],
                names=["label", "slots", "shares"],
            )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(labels: np.ndarray, slots: list[np.ndarray], shares: list[np.ndarray], rounds: int = 250):
    """Weights by slot, and slope and offset of the calibration; None without both classes.

    Rows are gone through in blocks, so only the features themselves are held.
    """
    if len(labels) < 8 or labels.min() == labels.max():
        return None
    fold = np.arange(len(labels)) % 4 == 3
    if len(set(labels[fold])) < 2 or len(set(labels[~fold])) < 2:
        fold[:] = False
    use = np.flatnonzero(~fold)
    # Roots of shares keep rare grams from drowning among common ones.
    scale = np.zeros(KINDS << BITS)
    for i in use:
        scale[slots[i]] += shares[i]
    scale = 1 / np.sqrt(scale / len(use) + 1e-4)
    y = labels[use]
    cost = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(use)
    weights, offset, speed = np.zeros(KINDS << BITS), 0.0, np.full(KINDS << BITS, 1e-8)
    for _ in range(rounds):
        slope, shift = 1e-6 * weights, 0.0
        for k, i in enumerate(use):
            at = slots[i]
            value = shares[i] * scale[at]
            error = cost[k] * (_sigmoid(weights[at] @ value + offset) - y[k])
            slope[at] += error * value
            shift += error
        speed += slope**2
        weights -= 0.1 * slope / np.sqrt(speed)
        offset -= 0.5 * shift
    weights = weights * scale
    held = np.flatnonzero(fold) if fold.any() else use
    raw = np.array([weights[slots[i]] @ shares[i] for i in held]) + offset
    spread = max(raw.std(), 1e-9)
    a, b = 1.0, 0.0
    for _ in range(2000):
        error = _sigmoid(a * raw / spread + b) - labels[held]
        a -= 0.5 * ((error * raw / spread).mean() + 1e-3 * a)
        b -= 0.5 * error.mean()
    return weights.reshape(KINDS, -1).astype(np.float32), a / spread, b + a / spread * offset


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model trained on at most ``sample`` labelled rows."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    )
    rows = texts.select("doc_id", "text", "label").mapInArrow(trimmed(_with_id), "doc_id long, label double, slots binary, shares binary")
    table = rows.toArrow().sort_by("doc_id")
    packed = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[c]]
    return train(table["label"].to_numpy(), packed("slots", np.int32), packed("shares", np.float32))


def _with_id(batches):
    for batch in batches:
        at = 0
        for part in _featured(iter([batch])):
            ids = batch.column("doc_id").slice(at, part.num_rows)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["doc_id", *part.schema.names])


def judge(docs: DataFrame, model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, ``p_good`` and verdict of each row of ``docs``, with carried columns.

    ``p_good`` is null without a model (no labels of both classes); then the
    base rules alone decide. A null or empty text has no words and fails them.
    """
    kept = docs.select("doc_id", "text", *(F.struct(*carry).alias("rest") for _ in carry[:1]))
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, p_good double, kept boolean"
    ) + (f", rest {kept.schema['rest'].dataType.simpleString()}" if carry else "")

    def run(batches):
        for batch in batches:
            for a, b, *parts in _pieces(batch):
                counts = base_counts(*parts)
                n = counts["n_words"]
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * n)
                if model is None:
                    good, ok = pa.nulls(b - a, pa.float64()), ~failed
                else:
                    weights, slope, offset = model
                    p = _sigmoid(slope * scores(weights, grams(*parts)) + offset)
                    good, ok = pa.array(p), ~failed & (p >= THRESHOLD)
                columns = [batch.column("doc_id").slice(a, b - a), *(pa.array(x, pa.int64()) for x in counts.values())]
                columns += [pa.array(failed), good, pa.array(ok)]
                names = ["doc_id", *counts, "base_failed", "p_good", "kept"]
                if carry:
                    columns.append(batch.column("rest").slice(a, b - a))
                    names.append("rest")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(trimmed(run), schema)


def quality_report(spark, sf_dir: str) -> DataFrame:
    """``op1``: base counts, probability and verdict of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
