"""Suffix-array dedup over bytes, by induced sorting of shards.

Every window of ``size`` bytes belongs to the shard that its least 32-byte hash
names, so equal windows meet in one shard, wherever they stand. Windows whose
hash occurs once in the corpus are unique and stay at home; for the others the
stretch of windows with the same hash travels. A shard keeps one of each set of
equal stretches, sorts the suffixes of the rest (suffixes are classified, the
leftmost-smaller substrings are sorted and named, the names are sorted in turn,
and the shard's array is induced from them bucket by bucket), and compares each
suffix with the one before it, in the order of the text. Suffixes that share
``size`` bytes stand together; all but the earliest are repeats.

A hash that more than ``HOT`` of the chunks hold would bring a stretch of every
such document into one shard. Its windows are dealt by a hash of all their own
bytes instead: a chunk sends one entry of each window, with its least place, and
gets the least place of all back where the window occurs twice.

Nulls: a null text has no bytes; rows without an id come after all others. Rows
of one id count as one document, in which equal positions do not precede each
other. A stretch of one repeated byte costs a step per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm import exchange as X
from layerscan.llm.words import BASE, WORD_BASE, ids_of, mix, powers, range_hashes, text_bytes

GRAM = 32
MANY = np.uint32(1)
#: Share of the chunks; a hash in more of them is in more documents than there are chunks.
HOT = 0.75
#: Marks a hot hash in what a chunk is told.
HOT_BIT = 1 << 62
PIECE = 1 << 20
#: Alphabets above this are sorted by doubling instead of bucket by bucket.
BUCKETS = 1024


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    ahead, back = powers(BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[: len(data)], out=sums[1:])
    n = len(data) - GRAM + 1
    return mix((sums[GRAM:] - sums[:n]) * back[:n]) | np.uint64(1)


def least_grams(data: np.ndarray, bounds: np.ndarray, size: int):
    """Stretches of windows with one least hash, piece by piece of the bytes.

    Yields first window, last window and hash of the stretches, and the hashes
    of all places that are the least of some window. A stretch ends with its
    text or its piece.
    """
    width = size - GRAM + 1
    ok = np.zeros(len(data) + 1, bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        ok[a : max(a, b - size + 1)] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    for low in range(0, max(0, len(data) - size + 1), PIECE):
        high = min(low + PIECE, len(data) - size + 1)
        valid = ok[low:high]
        if not valid.any():
            continue
        grams = _grams(data[low : high + size - 1])
        least = _sliding(grams, width, np.minimum)
        least[~valid] = 0
        edge = np.zeros(width - 1, np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
        places = grams[(most == grams) & (most > 0)]
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]] | begins[low:high])
        last = np.r_[new[1:], len(least)] - 1
        use = least[new] > 0
        yield new[use] + low, last[use] + low, least[new][use], places


def _short(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys // np.uint64(n)).astype(np.uint32) << np.uint32(1)


def _whole(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys % np.uint64(n)).astype(np.int64) << 31 | (_short(keys, n) >> 1).astype(np.int64)


def _grams_of(n: int, size: int):
    def question(chunk: int, table: pa.Table):
        found = [places for *_, places in least_grams(*text_bytes(table["text"]), size)]
        if found:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield X.send(chunk, n, keys, _short(keys, n) | np.where(counts > 1, MANY, np.uint32(0)))

    return question


def _repeated(most: int):
    """Hashes that occur twice, and which of them more than ``most`` chunks hold."""

    def reply_to(table: pa.Table) -> pa.Table:
        entries, row = X.unpack(table["keys"], np.uint32)
        order = np.argsort(entries >> 1, kind="stable")
        keys = entries[order] >> 1
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[new, len(keys)])
        live = (sizes > 1) | ((np.bitwise_or.reduceat(entries[order], new) & MANY) > 0)
        told = (entries >> 1).astype(np.int64) | table["bucket"][0].as_py() << 31
        told[order[np.repeat(sizes > most, sizes)]] |= HOT_BIT
        found = np.sort(order[np.repeat(live, sizes)])
        return X.reply(table["chunk"].to_numpy(), row[found], told[found])

    return reply_to


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all items of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


STRETCH = np.dtype([("size", "<i8"), ("id", "<i8"), ("at", "<i8"), ("row", "<i8")])
#: A window of a hot hash: two hashes of its bytes, the lowest bit of the second for MANY, and its least place.
PLACE = np.dtype([("a", "<u8"), ("b", "<u4"), ("at", "<u4"), ("id", "<i8")])
#: Stands before the places in a reply; what is before it has no negative numbers.
PLACES = np.full(3, -1, np.int64).tobytes()
FILTER = np.uint64((1 << 20) - 1)


def _prints(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that begin at ``at``, the second with an even value."""
    second = range_hashes(data, at, at + size, WORD_BASE[0])
    return range_hashes(data, at, at + size), (second >> np.uint64(33)).astype(np.uint32) << np.uint32(1)


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """The first hash of ``_prints`` from each position on."""
    ahead, back = powers(BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[: len(data)], out=sums[1:])
    n = len(data) - size + 1
    return mix((sums[size:] - sums[:n]) * back[:n] + np.uint64(size * BASE % (1 << 64)))


def _by_window(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of places by window, id and position, the first of each window in it, and the counts."""
    order = np.lexsort((places["at"], places["id"], places["b"] >> 1, places["a"]))
    a, b = places["a"][order], places["b"][order] >> 1
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)])
    return order, new, np.diff(np.r_[new, len(order)])


def _merged(places: np.ndarray) -> np.ndarray:
    """The least place of each window, marked if there are others."""
    if not len(places):
        return places
    order, new, counts = _by_window(places)
    sorted_ = places[order]
    least = sorted_[new]
    head = np.repeat(least, counts)
    other = (sorted_["id"] != head["id"]) | (sorted_["at"] != head["at"]) | (sorted_["b"] & MANY > 0)
    least["b"] |= np.logical_or.reduceat(other, new).astype(np.uint32)
    return least


def _least_places(table: pa.Table) -> pa.Table:
    """The least place of each window, for the chunks that hold others."""
    places, row = X.unpack(table["keys"], PLACE)
    order, new, counts = _by_window(places)
    sorted_ = places[order]
    head = np.repeat(sorted_[new], counts)
    other = (sorted_["id"] != head["id"]) | (sorted_["at"] != head["at"]) | (sorted_["b"] & MANY > 0)
    head["b"] &= ~MANY
    row, head = row[order][other], head[other]
    by = np.argsort(row, kind="stable")
    return X.reply(table["chunk"].to_numpy(), row[by], head[by])


def _stretches(n: int, size: int):
    def question(chunk: int, table: pa.Table, got: pa.ChunkedArray):
        live = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in got.to_pylist())])
        if not len(live) or not table.num_rows:
            return
        hot, live = live[live >= HOT_BIT] - HOT_BIT, live[live < HOT_BIT]
        data, bounds = text_bytes(table["text"])
        ids = ids_of(table["id"])
        places = np.empty(0, PLACE)
        for first, last, keys, _ in least_grams(data, bounds, size):
            whole = _whole(keys, n)
            busy = np.isin(whole, hot)
            if busy.any():
                at = _ragged(first[busy], last[busy] - first[busy] + 1)
                here = np.empty(len(at), PLACE)
                low = int(at[0])
                here["a"], here["b"] = _prints(data[low : int(at[-1]) + size], at - low, size)
                row = np.searchsorted(bounds, at, "right") - 1
                here["at"], here["id"] = at - bounds[row], ids[row]
                places = np.concatenate([places, _merged(here)])
            known = np.isin(whole, live)
            first, last, keys = first[known], last[known], keys[known]
            if not len(first):
                continue
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, last, bucket = first[order], last[order], bucket[order]
            row = np.searchsorted(bounds, first, "right") - 1
            about = np.empty(len(first), STRETCH)
            about["size"], about["id"] = last - first + size, ids[row]
            about["at"], about["row"] = first - bounds[row], row
            raw = data[_ragged(first, about["size"])].tobytes()
            ends = np.r_[0, np.cumsum(about["size"])]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            yield pa.table(
                [
                    pa.array(bucket[cuts[:-1]]),
                    pa.array(np.full(len(cuts) - 1, chunk)),
                    pa.array([raw[ends[i] : ends[j]] for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    pa.array([about[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ],
                schema=X.ASK_ARROW,
            )
        places = _merged(places)
        if len(places):
            yield X.send(chunk, n, places["a"], places)

    return question


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one counts as such."""
    n = len(s)
    up = np.zeros(n, bool)
    up[:-1] = s[:-1] < s[1:]
    up[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    at = np.where(differs, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _deal(pending: list, s: np.ndarray, items: np.ndarray) -> None:
    """Appends items to the lists of their symbols, keeping their order."""
    symbol = s[items]
    order = np.argsort(symbol, kind="stable")
    symbol, items = symbol[order], items[order]
    cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]).tolist() + [len(items)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        pending[symbol[i]].append(items[i:j])


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the leftmost smaller suffixes, given in order, imply."""
    none = np.empty(0, np.int64)
    larger: list = [[] for _ in range(symbols)]
    ups: list = [[] for _ in range(symbols)]
    edges = np.searchsorted(s[seeds], np.arange(symbols + 1))
    for c in range(symbols):
        queue, done = np.concatenate(larger[c] or [none]), []
        while len(queue):
            done.append(queue)
            before = queue[queue > 0] - 1
            before = before[~smaller[before]]
            same = s[before] == c
            if not same.all():
                _deal(larger, s, before[~same])
            queue = before[same]
        larger[c] = np.concatenate(done or [none])
        own = seeds[edges[c] : edges[c + 1]]
        before = own[own > 0] - 1
        if len(before):
            _deal(larger, s, before)
    ups[s[-1]].append(np.array([len(s) - 1]))
    for c in range(symbols - 1, -1, -1):
        queue, done = np.concatenate(ups[c] or [none]), []
        while len(queue):
            done.append(queue)
            before = queue[queue > 0] - 1
            before = before[smaller[before]]
            same = s[before] == c
            if not same.all():
                _deal(ups, s, before[~same])
            queue = before[same]
        ups[c] = np.concatenate(done or [none])[::-1]
        own = larger[c][::-1]
        before = own[own > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(ups, s, before)
    return np.concatenate([x for c in range(symbols) for x in (larger[c], ups[c])])


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by ``depth`` names at least."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if new.all() or step >= depth or step >= n:
            return order


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``s`` by ``depth`` symbols at least.

    ``s`` ends with its only 0. Suffixes that agree further may be in any order.
    """
    symbols = int(s.max()) + 1
    smaller = smaller_types(s)
    left = np.zeros(len(s), bool)
    left[1:] = smaller[1:] & ~smaller[:-1]
    left[-1] = True
    seeds = np.flatnonzero(left)
    if len(seeds) == 1:
        return _induce(s, smaller, seeds, symbols)
    rough = _induce(s, smaller, seeds[np.argsort(s[seeds], kind="stable")], symbols)
    rough = rough[left[rough]]
    # Substrings between neighbouring seeds, named in order; equal ones share a name.
    place = np.empty(len(s), np.int64)
    place[seeds] = np.arange(len(seeds))
    print_ = range_hashes(s, seeds, np.r_[seeds[1:] + 1, len(s)])[place[rough]]
    names = np.empty(len(seeds), np.int64)
    names[place[rough]] = np.cumsum(np.r_[False, print_[1:] != print_[:-1]])
    count = int(names.max()) + 1
    if count == len(seeds):
        order = place[rough]
    elif count <= BUCKETS:
        order = suffix_array(names, depth)
    else:
        order = _doubled(names, depth)
    return _induce(s, smaller, seeds[order], symbols)


def _words_at(s: np.ndarray, size: int) -> list[np.ndarray]:
    """Eight bytes from each position on, for position classes modulo eight."""
    padded = np.concatenate([s, np.zeros(size + 16, np.uint8)])
    return np.lib.stride_tricks.as_strided(
        padded[: (len(padded) // 8) * 8].view(np.uint64), (len(s) + size,), (1,)
    )


def common_with_previous(s: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Permuted common prefixes: whether each position shares ``size`` bytes with
    the suffix that precedes it in ``order``."""
    previous = np.full(len(s), -1, np.int64)
    previous[order[1:]] = order[:-1]
    at = np.flatnonzero(previous >= 0)
    words = _words_at(s, size)
    for step in [*range(0, size - 7, 8), size - 8]:
        at = at[words[at + step] == words[previous[at] + step]]
    shared = np.zeros(len(s), bool)
    shared[at] = True
    return shared


def _shard(size: int):
    """Repeats among the stretches of a shard, as ranges of first bytes, and the least places of windows."""

    def reply_to(table: pa.Table) -> pa.Table:
        alone = pc.equal(pc.binary_length(table["extra"]), 0)
        told: dict = {}
        # One row for each chunk, however many it sent.
        for work, before, part in ((stretches, b"", table.filter(pc.invert(alone))), (_least_places, PLACES, table.filter(alone))):
            if part.num_rows:
                got, begun = work(part), set()
                for chunk, keys in zip(got["chunk"].to_pylist(), got["keys"].to_pylist()):
                    told.setdefault(chunk, []).append(keys if chunk in begun else before + keys)
                    begun.add(chunk)
        return pa.table([pa.array(list(told), pa.int64()), pa.array([b"".join(x) for x in told.values()], pa.binary())], schema=X.ANSWER_ARROW)

    def stretches(table: pa.Table) -> pa.Table:
        about = [np.frombuffer(x, STRETCH) for x in table["extra"].to_pylist()]
        row = np.repeat(np.arange(len(about)), [len(x) for x in about])
        about = np.concatenate(about)
        raw = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8)
        ends = np.cumsum(about["size"])
        begins = ends - about["size"]
        prints = [range_hashes(raw, begins, ends, base) for base in (BASE, WORD_BASE[0])]
        order = np.lexsort((about["at"], about["id"], *prints))
        sorted_ = about[order]
        new = np.r_[True, (prints[0][order][1:] != prints[0][order][:-1]) | (prints[1][order][1:] != prints[1][order][:-1])]
        leader_of = np.flatnonzero(new)[np.cumsum(new) - 1]
        leader = sorted_[leader_of]
        tied = (sorted_["id"] == leader["id"]) & (sorted_["at"] == leader["at"])
        parts = [np.stack([row[order], sorted_["row"], sorted_["at"], sorted_["at"] + sorted_["size"] - size], 1)[~tied]]

        heads = order[new]
        sizes = about["size"][heads]
        # One copy of each stretch, a 0 after each, and the symbols made dense.
        where = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.zeros(int(where[-1] + sizes[-1] + 1), np.uint8)
        inside = _ragged(where, sizes)
        used, dense = np.unique(raw[_ragged(begins[heads], sizes)], return_inverse=True)
        symbols = np.ones(len(text), np.int16)
        symbols[inside] = dense + 2
        symbols[-1] = 0
        text[inside] = raw[_ragged(begins[heads], sizes)]
        ranks = suffix_array(symbols, size)
        fits = np.zeros(len(text), bool)
        fits[_ragged(where, sizes - size + 1)] = True
        shared = common_with_previous(text, ranks, size) & fits
        mine = ranks[fits[ranks]]
        group = np.cumsum(~shared[mine])
        several = np.bincount(group, minlength=len(mine) + 2)[group] > 1
        mine, group = mine[several], group[several]
        if len(mine):
            head = np.searchsorted(where, mine, "right") - 1
            ids, at = about["id"][heads][head], about["at"][heads][head] + mine - where[head]
            by = np.lexsort((at, ids, group))
            begin = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
            span = np.diff(np.r_[begin, len(by)])
            later = (ids[by] != np.repeat(ids[by][begin], span)) | (at[by] != np.repeat(at[by][begin], span))
            hit = np.sort(mine[by][later])
            head = np.searchsorted(where, hit, "right") - 1
            begin = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (head[1:] != head[:-1])])
            final = np.r_[begin[1:], len(hit)] - 1
            low, high, head = hit[begin] - where[head[begin]], hit[final] - where[head[begin]], head[begin]
            # All stretches at the leader's own place share its repeats.
            group_of = np.cumsum(new) - 1
            same = np.flatnonzero(tied)
            left = np.searchsorted(group_of[same], head)
            many = np.searchsorted(group_of[same], head, "right") - left
            one = same[_ragged(left, many)]
            base = sorted_["at"][one]
            parts.append(
                np.stack([row[order][one], sorted_["row"][one], base + np.repeat(low, many), base + np.repeat(high, many)], 1)
            )
        found = np.concatenate(parts).astype(np.int64)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        return X.reply(table["chunk"].to_numpy(), found[:, 0], np.ascontiguousarray(found[:, 1:]))

    return reply_to


def _later(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """First bytes of all windows that stand in ``least`` with another place."""
    out = [np.empty(0, np.int64)]
    least = np.sort(least, order=("a", "b"))
    near = np.zeros(int(FILTER) + 1, bool)
    near[least["a"] & FILTER] = True
    for low in range(0, max(0, len(data) - size + 1) if len(least) else 0, PIECE):
        part = data[low : min(low + PIECE, len(data) - size + 1) + size - 1]
        a = _rolling(part, size)
        at = np.flatnonzero(near[a & FILTER])
        known = least[np.minimum(np.searchsorted(least["a"], a[at]), len(least) - 1)]
        at, known = at[same := known["a"] == a[at]], known[same]
        if not len(at):
            continue
        b = _prints(part, at, size)[1]
        row = np.searchsorted(bounds, at + low, "right") - 1
        from_ = at + low - bounds[row]
        hit = (known["b"] == b) & (at + low + size <= bounds[row + 1]) & ((known["id"] != ids[row]) | (known["at"] != from_))
        out.append(at[hit] + low)
    return np.concatenate(out)


def _cut(size: int):
    def work(table: pa.Table, got: pa.ChunkedArray) -> pa.Table:
        data, bounds = text_bytes(table["text"])
        told = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in got.to_pylist()]
        ends = [int((np.r_[x[:, 0], -1] == -1).argmax()) for x in told]
        ranges = np.concatenate([np.empty((0, 3), np.int64), *(x[:end] for x, end in zip(told, ends))])
        least = np.concatenate([np.empty(0, PLACE), *(x[end + 1 :].reshape(-1).view(PLACE) for x, end in zip(told, ends))])
        steps = np.zeros(len(data) + 1, np.int32)
        np.add.at(steps, bounds[ranges[:, 0]] + ranges[:, 1], 1)
        np.add.at(steps, bounds[ranges[:, 0]] + ranges[:, 2] + size, -1)
        later = _later(data, bounds, ids_of(table["id"]), least, size)
        steps[later] += 1
        steps[later + size] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        first[inner] = gone[inner]
        count = lambda x: np.diff(np.r_[0, np.cumsum(x)][bounds])
        removed = count(gone)
        kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(bounds[:-1], bounds[1:], removed)]
        return pa.table(
            {
                "id": table["id"],
                "n_bytes": pa.array(np.diff(bounds), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(count(first), pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return work


def _sharded(chunks: DataFrame, n: int, size: int) -> DataFrame:
    """What the chunks send the shards."""
    grams = X.answer(X.ask(chunks, _grams_of(n, size)), _repeated(int(HOT * n)))
    return X.ask_again(chunks, grams, _stretches(n, size))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """Removes the bytes of every ``size``-byte string that also starts earlier.

    Earlier is a smaller id, or the same id and a smaller position. Returns
    ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept``, the remaining bytes, which may cut a character.
    """
    if size < GRAM + 8:
        raise ValueError(f"strings have {GRAM + 8} bytes at least")
    n = X.sides(docs, text, 2000)
    chunks = X.chunked(docs, id_col, text, (), n)
    repeats = X.answer(_sharded(chunks, n, size), _shard(size))
    return X.finish(chunks, repeats, _cut(size), "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_report(docs: DataFrame) -> DataFrame:
    """``op7``: byte counts and the digest of what is kept."""
    out = suffix_dedup(docs)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
