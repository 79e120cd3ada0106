"""Words and window hashes of many texts at once, in numpy.

A word is a run of bytes other than space, tab and the line breaks 0x0A-0x0D.
Hashes are polynomials modulo 2^64, taken from prefix sums and then mixed.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15
WORD_BASE = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Bytes, and words, that are hashed at once.
SLICE = 1 << 18
#: Powers of a base that a process keeps.
KEPT_POWERS = 2 * SLICE
#: Bytes of a group after which a worker gives freed memory back.
LARGE_GROUP = 1 << 20
LAST_ID = np.iinfo(np.int64).max

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def process_cache() -> dict:
    """What a Python process keeps. Functions travel by value, so the globals of
    their modules would travel along, and would not outlive a task."""
    return vars(sys).setdefault("_layerscan_llm", {})


def trim() -> None:
    """Give freed memory back to the machine: idle workers keep what they have."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # Only the GNU library has it.


def trimmed(run: Callable) -> Callable:
    """A function over Arrow batches that trims its worker's memory at the end of a task."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def trimmed_group(run: Callable) -> Callable:
    """A function of the table of a group that trims its worker's memory after large groups."""

    def whole(table):
        out, size = run(table), table.nbytes
        del table
        if size >= LARGE_GROUP:
            trim()
        return out

    return whole


def kept_model(operator: str, source: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the process until another model is asked for.

    Workers outlive the jobs of an operator. One model at a time is kept, so the
    memory of a worker does not add up over the operators of a session.
    """
    cache = process_cache()
    held = cache.get("model")
    if held is None or held[0] != operator or held[1] is not source:
        cache["model"] = held = None
        trim()
        held = cache["model"] = (operator, source, make())
    return held[2]


def _make_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    ahead = np.full(size, base, np.uint64)
    back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of ``base`` and of its inverse modulo 2^64.

    A process keeps ``KEPT_POWERS`` of each base; more are made anew.
    """
    if size > KEPT_POWERS:
        return _make_powers(base, size)
    cache = process_cache().setdefault("powers", {})
    if base not in cache:
        cache[base] = _make_powers(base, KEPT_POWERS)
    return cache[base]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[bounds[0] : bounds[-1]], bounds - bounds[0]


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; null becomes the largest, so it never comes before another."""
    return column.cast(pa.int64()).fill_null(LAST_ID).to_numpy()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)


class Words:
    """Byte ranges of all words and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        inside = ~SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        return range_hashes(self.data, self.starts, self.ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each range of ``data``, for ranges in order of their starts.

    Works in slices, so memory stays small; ranges beyond SLICE are hashed alone.
    """
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > SLICE)
    stops = ends.copy()
    stops[long] = starts[long]
    ahead, back = powers(base, 2 * SLICE)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + SLICE, SLICE))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        low, high = starts[a], max(stops[a:b].max(), starts[b - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        part = data[low:high].astype(np.uint64)
        part += np.uint64(1)
        part *= ahead[: high - low]
        np.cumsum(part, out=sums[1:])
        s, e = starts[a:b] - low, stops[a:b] - low
        out[a:b] = (sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(base)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), base)
    return mix(out)


def window_hashes(
    hashes: np.ndarray, first: np.ndarray, size: int, which: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``size`` words within one text."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    base = WORD_BASE[which]
    ahead, back = powers(base, min(n, SLICE + size) + 1)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, n + SLICE, SLICE))
    for low, (a, b) in zip(range(0, n, SLICE), zip(cuts[:-1], cuts[1:])):
        part = hashes[low : low + SLICE + size]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * ahead[: len(part)], out=sums[1:])
        own = at[a:b] - low
        out[a:b] = (sums[own + size] - sums[own]) * back[own]
    return at, mix(out)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a window of ``size`` that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    steps[starts] += 1
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:n]) > 0


def slices(bounds: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each; a longer text stands alone."""
    out, a = [], 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        out.append((a, min(b, len(bounds) - 1)))
        a = out[-1][1]
    return out
