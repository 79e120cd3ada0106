"""Benchmark decontamination by template windows.

Words lose edge punctuation; those that begin with a digit, that begin with a
capital, or that name a unit become typed slots. Windows of ``SIZE`` words of
the templates are joined by hash with those of the benchmark, so a question
with other numbers and names is still found. Slot values must correspond one to
one: both windows must repeat values at the same places. An item of fewer words
is one window of its own length.

Windows that are mostly slots say too little as templates, and case decides what
is a name. So the case-folded words of every window are a key of their own, and
a copy is found whatever its case and however many of its words are slots. Each
Chinese or Japanese character is a word.

The benchmark's windows are broadcast in slices of at most ``SLICE_KEYS`` keys,
each in a pass of its own over the same rows, whatever the benchmark's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.words import Words, lower_ascii, mix, slices, text_bytes, trimmed, window_hashes
from layerscan.session import materialize

SIZE = 13
#: Items of fewer words than this say too little and match nothing; README names them.
LEAST = 5
#: Bound on the window keys of one broadcast.
SLICE_KEYS = 1_000_000
#: Slices after which rows are written, so that few Python workers run at once.
PASSES = 4
PIECE = 2 << 20

#: Words that count as units.
UNITS = (
    b"mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters mg g kg gram grams "
    b"kilogram kilograms ounce ounces lb lbs pound pounds ton tons ml l litre litres liter liters gallon gallons "
    b"second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar "
    b"dollars euro euros percent degree degrees watt watts volt volts joule joules mph kmh"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 22, 33))
#: Sets keys of folded words apart from those of templates.
FOLDED = np.uint64(1 << 32)


def _characters(data: np.ndarray) -> np.ndarray:
    """Sizes of the Chinese and Japanese characters that begin at each byte, else 0."""
    after = np.r_[data[1:], np.zeros(min(1, len(data)), np.uint8)]
    wide = (data == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
    return np.where((data >= 0xE3) & (data <= 0xE9), 3, np.where(wide, 4, 0))


class _Trimmed(Words):
    """Words without edge punctuation; those of punctuation alone are left out."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        super().__init__(data, bounds)
        sizes = _characters(data)
        if sizes.any():
            self._split(sizes)
        at = np.arange(len(data), dtype=np.int64)
        ahead = np.minimum.accumulate(np.where(_LETTER[data], at, len(data))[::-1])[::-1]
        behind = np.maximum.accumulate(np.where(_LETTER[data], at, -1))
        if len(self.starts):
            starts, ends = ahead[self.starts], behind[self.ends - 1] + 1
            use = starts < self.ends
            self.starts, self.ends = starts[use], ends[use]
            self.first = np.searchsorted(self.starts, bounds)

    def _split(self, sizes: np.ndarray) -> None:
        """Makes each character that ``sizes`` names a word."""
        alone = np.flatnonzero(sizes)
        inside = np.zeros(len(sizes) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        alone = alone[np.cumsum(inside[:-1])[alone] > 0]
        stops = alone + sizes[alone]
        starts = np.unique(np.concatenate([self.starts, alone, stops]))
        # A word ends where its next part begins; what begins at its end is none.
        word = np.searchsorted(self.starts, starts, "right") - 1
        use = starts < self.ends[word]
        starts, word = starts[use], word[use]
        self.starts, self.ends = starts, np.minimum(self.ends[word], np.r_[starts[1:], len(sizes)])


def _hash_of(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return Words(data, np.array([0, len(data)])).hashes()


_UNIT_HASHES = np.sort(_hash_of(list(UNITS)))


def folded_values(data: np.ndarray, bounds: np.ndarray, words: Words, values: np.ndarray) -> np.ndarray:
    """Hashes of the words without case, beyond ASCII too: folding moves no word's edge."""
    if not (data > 127).any():
        return values
    texts = [
        data[a:b].tobytes().decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
        for a, b in zip(bounds[:-1], bounds[1:])
    ]
    folded = _Trimmed(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
    assert len(folded) == len(words)
    return folded.hashes()


def templates(data: np.ndarray, bounds: np.ndarray):
    """Trimmed words of texts, their template codes, values, which are slots, and values without case."""
    low = lower_ascii(data)
    words = _Trimmed(low, bounds)
    values = words.hashes()
    head = data[words.starts]
    second = data[np.minimum(words.starts + 1, len(data) - 1)] if len(words) else head
    number = (head >= 48) & (head <= 57)
    # Capitals of ASCII and of the Latin-1 letters.
    name = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    unit = np.isin(values, _UNIT_HASHES) & ~name
    codes = np.select([number, name, unit], [NUMBER, NAME, UNIT], values)
    return words, codes, values, number | name | unit, folded_values(data, bounds, words, values)


def patterns(codes: np.ndarray, values: np.ndarray, slot: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of which slots of each window hold equal values of one type."""
    rows = at[:, None] + np.arange(size)
    kind = np.where(slot[rows], mix(values[rows] + codes[rows]), np.uint64(0))
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        same = (kind[:, : i + 1] == kind[:, i : i + 1]).argmax(axis=1)
        out = mix(out * np.uint64(31) + np.where(kind[:, i] > 0, same + 1, 0).astype(np.uint64))
    return out


def windows_of(parts, size: int):
    """First word, key and pattern of the folded windows, and of the windows of which at
    least half are plain words. A template without slots is left to the folded ones."""
    words, codes, values, slot, folded = parts
    at, keys = window_hashes(folded, words.first, size)
    yield at, mix(keys + np.uint64(size) + FOLDED), lambda at: np.zeros(len(at), np.uint64)
    slots = np.r_[0, np.cumsum(slot)]
    at, keys = window_hashes(codes, words.first, size)
    count = slots[at + size] - slots[at]
    use = (count > 0) & (2 * count <= size)
    yield at[use], mix(keys[use] + np.uint64(size)), lambda at: patterns(codes, values, slot, at, size)


def _items(batches):
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        ids = batch.column("item_id").to_numpy(zero_copy_only=False)
        parts = templates(data, bounds)
        words = parts[0]
        counts = words.counts
        sizes = {SIZE, *counts[(counts >= LEAST) & (counts < SIZE)].tolist()}
        for size, (at, keys, shape_of) in ((size, w) for size in sizes for w in windows_of(parts, size)):
            text = words.text_of()[at]
            whole = (counts[text] == size) | (size == SIZE)
            at, keys, text = at[whole], keys[whole], text[whole]
            shape = shape_of(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(shape.view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(ids[text], pa.int64())],
                names=["key", "pattern", "size", "item_id"],
            )


def _slices(benchmark: DataFrame) -> list[dict]:
    """Sorted keys, patterns, sizes and least items of the benchmark's windows, in bounded parts."""
    rows = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    windows = materialize(
        rows.mapInArrow(_items, "key long, pattern long, size int, item_id long")
        .groupBy("key", "pattern", "size").agg(F.min("item_id").alias("item_id")),
        "windows",
    )
    n = -(-windows.count() // SLICE_KEYS)
    out = []
    for i in range(n):
        part = windows.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toArrow()
        columns = {c: part[c].to_numpy() for c in part.column_names}
        columns["key"], columns["pattern"] = columns["key"].view(np.uint64), columns["pattern"].view(np.uint64)
        order = np.lexsort((columns["pattern"], columns["key"]))
        out.append({c: v[order] for c, v in columns.items()})
    return out


def _matches(known: dict, parts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts and items that share a window with equal patterns."""
    words, found = parts[0], []
    sizes = np.unique(known["size"]).tolist()
    for at, keys, shape_of in (w for size in sizes for w in windows_of(parts, size)):
        low = np.searchsorted(known["key"], keys)
        hit = np.flatnonzero(known["key"][np.minimum(low, len(known["key"]) - 1)] == keys)
        if not len(hit):
            continue
        at, keys, low = at[hit], keys[hit], low[hit]
        shape = shape_of(at)
        # One key may stand with several patterns, next to each other.
        while len(at):
            ok = known["pattern"][low] == shape
            found.append((words.text_of()[at[ok]], known["item_id"][low[ok]]))
            low = low + 1
            more = ~ok & (low < len(known["key"]))
            more[more] &= known["key"][low[more]] == keys[more]
            at, keys, low, shape = at[more], keys[more], low[more], shape[more]
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text``, the ``item_ids`` found in it, and carried columns as ``rest``.

    Items with equal windows are named by the least id. A null or empty text has
    none; items without id or text match nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", "text", F.array().cast("array<long>").alias("item_ids"), *(F.struct(*carry).alias("rest") for _ in carry[:1])
    )
    schema = "doc_id long, text string, item_ids array<long>" + (
        f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""
    )
    for i, known in enumerate(_slices(benchmark)):
        rows = rows.mapInArrow(trimmed(_pass(spark.sparkContext.broadcast(known))), schema)
        if i % PASSES == PASSES - 1:
            rows = materialize(rows, "leaks")
    return rows


def _pass(shared):
    def run(batches):
        known = shared.value
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for a, b in slices(bounds, PIECE):
                parts = templates(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                found += [(text + a, item) for text, item in _matches(known, parts)]
            text, item = (np.concatenate(x) for x in zip(*found))
            lists = batch.column("item_ids").to_pylist()
            for t in np.unique(text):
                lists[t] = sorted({*lists[t], *item[text == t].tolist()})
            at = batch.schema.get_field_index("item_ids")
            yield batch.set_column(at, "item_ids", pa.array(lists, pa.list_(pa.int64())))

    return run


def leak_report(spark, sf_dir: str) -> DataFrame:
    """``op8``: benchmark items found in each document, and the verdict."""
    found = find_leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    return found.select("doc_id", "item_ids", (F.size("item_ids") > 0).alias("contaminated"))
