"""Exact Jaccard join of n-gram sets by PartEnum signatures.

The sizes of sets are cut into overlapping bands, so that two sets similar
enough share a band. A band cuts the feature domain into parts and each part
into ``PIECES`` pieces. Similar sets differ in few features, so in some part at
most ``OFF`` pieces differ, and there the features of some choice of
``PIECES - OFF`` pieces are the same. A set's signatures are hashes of its
features in every such choice of the parts it needs; similar sets share one.

A choice without features says nothing, as many sets have it. To spoil every
choice with features of a part in which ``m`` pieces hold features, as many as
``min(m, OFF + 1)`` of them must differ. So a set signs its first parts until
these numbers exceed the most differences that a similar set can have: of two
similar sets, the one that stops first shares a choice with features. Only a
set whose parts all together do not suffice also signs choices without
features; two such sets share one of either kind. No link is lost.

Signatures travel packed. A task first joins its own sets, so a signature costs
one entry per task however many of its sets share it; buckets grow in number with
the corpus, not in size. Each signature pairs its sets with the least one; pairs
that neither size nor a sketch rules out are confirmed on full sets, member by
member against the centre of a star, and a large star is split. Signatures whose
sets then still lie in several components are taken up again: every set of a
minority component meets, in blocks, every set of another component. Nothing is
capped.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.components import components
from layerscan.llm.minhash import shingle_sets
from layerscan.llm.words import mix, trimmed, trimmed_group
from layerscan.session import materialize

SHINGLE = 5
PERCENT = 80
#: Greatest over least size in a band.
SPREAD = 1.95
#: Pieces of a part, and how many may differ.
PIECES, OFF = 3, 1
#: Choices of pieces of a part that are signed.
CHOICES = [list(c) for c in combinations(range(PIECES), PIECES - OFF)]
#: Text bytes whose signatures are joined in a task before they are sent.
PIECE = 4 << 20
#: Rows whose sets are made at once.
ROWS = 256
#: Text bytes per bucket of signatures.
BUCKET_BYTES = 8 << 20
#: Sets in a block when a signature is taken up again.
BLOCK = 512
#: Features signed at once.
SETS = 1 << 18
#: Cells of a rough sketch.
CELLS = 256
#: Rows of a block that is gone through together with others.
SMALL = 64
#: Features in a part of a star.
STAR = 1 << 21
#: Bytes of full sets in a batch.
SENT = 4 << 20
#: Bits of the filter that spares the shuffle texts without candidates.
FILTER_BITS = 1 << 23


def most_different(size: int, percent: int) -> int:
    """The most features in which a set of ``size`` differs from a similar one."""
    return size * (100 - percent) // percent


def _parts(low: int, high: int, percent: int) -> int:
    """Parts of a band: so many that few of its sets exceed their differences in none."""
    parts = most_different(high, percent) // (OFF + 1) + 1
    while True:
        enough = True
        for size in (low, high):
            gap = (1 - 1 / (parts * PIECES)) ** size
            chance = [comb(PIECES, m) * (1 - gap) ** m * gap ** (PIECES - m) for m in range(PIECES + 1)]
            mean = sum(c * min(m, OFF + 1) for m, c in enumerate(chance))
            spread = sum(c * min(m, OFF + 1) ** 2 for m, c in enumerate(chance)) - mean**2
            enough &= parts * mean - 2 * (parts * spread) ** 0.5 > most_different(size, percent)
        if enough or parts > 4 * high:
            return parts
        parts += max(1, parts // 50)


@lru_cache(maxsize=None)
def bands(most: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Number, least and greatest size, and parts of each band up to size ``most``.

    Sets of ``a`` and ``b`` features with ``100 * a >= percent * b`` share a band.
    """
    out, low = [], -(-percent // (100 - percent))
    while low <= most:
        high = max(int(low * SPREAD), -(-low * 100 // percent))
        out.append((len(out), low, high, _parts(low, high, percent)))
        low = high * percent // 100 + 1
    return out


def signatures(keys: np.ndarray, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of many sets, and the set that each belongs to.

    The sets are the ranges ``cuts`` of ``keys``. A set too small to differ from
    a similar one has none.
    """
    sizes, out, owner = np.diff(cuts), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for band, low, high, parts in bands(1 << int(sizes.max(initial=0)).bit_length(), percent):
        own = np.flatnonzero((sizes >= low) & (sizes <= high))
        for turn in range(0, len(own), max(1, SETS // high)):
            some = own[turn : turn + max(1, SETS // high)]
            sign, of = _of_band(keys, cuts, some, band, parts, most_different(sizes[some], percent))
            out.append(sign)
            owner.append(of)
    return np.concatenate(out), np.concatenate(owner)


def _of_band(
    keys: np.ndarray, cuts: np.ndarray, own: np.ndarray, band: int, parts: int, most: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    n = cuts[own + 1] - cuts[own]
    of = np.repeat(np.arange(len(own)), n)
    at = np.arange(n.sum()) + np.repeat(cuts[own] - np.r_[0, np.cumsum(n)[:-1]], n)
    feature = mix(keys[at] + np.uint64((2 * band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    part = ((feature >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    piece = ((feature & np.uint64(0xFFFFFFFF)) * np.uint64(PIECES) >> np.uint64(32)).astype(np.int64)
    cell = (of * parts + part) * PIECES + piece
    sums = np.zeros(len(own) * parts * PIECES, np.uint64)
    np.add.at(sums, cell, mix(feature))
    filled = (np.bincount(cell, minlength=len(sums)) > 0).reshape(-1, PIECES)
    sums = sums.reshape(-1, PIECES)
    cost = np.minimum(filled.sum(axis=1), OFF + 1).reshape(len(own), parts)
    reached = np.cumsum(cost, axis=1)
    used = (reached - cost <= most[:, None]).ravel()
    thin = np.repeat(reached[:, -1] <= most, parts)
    out, owner = [], []
    for turn, chosen in enumerate(CHOICES):
        sign = np.flatnonzero(used & (filled[:, chosen].any(axis=1) | thin))
        name = (np.uint64(band << 48) + (sign % parts).astype(np.uint64)) * np.uint64(len(CHOICES)) + np.uint64(turn)
        out.append(mix(sums[sign][:, chosen].sum(axis=1, dtype=np.uint64) + mix(name)))
        owner.append(own[sign // parts])
    return np.concatenate(out), np.concatenate(owner)


class _Piece:
    """Sets of some rows of a task: ids, sizes, sums, sketches and signatures.

    Of equal sets only the first with an id has signatures: classes join the others.
    """

    def __init__(self, held: list[tuple]):
        ids, names, drawn, signs, owners = zip(*held)
        self.ids = pa.concat_arrays(ids)
        self.names = [np.concatenate(x) for x in zip(*names)]
        self.sketch, self.fine = (sum(x, []) for x in zip(*drawn))
        starts = np.r_[0, np.cumsum([len(x) for x in ids])[:-1]]
        owner = np.concatenate([x + start for x, start in zip(owners, starts)])
        valid, seen = self.ids.is_valid().to_numpy(zero_copy_only=False), {}
        first = np.array([v and seen.setdefault(x, i) == i for i, (v, x) in enumerate(zip(valid, zip(*self.names)))], bool)
        kept = first[owner]
        self.sign, self.owner = np.concatenate(signs)[kept], owner[kept]

    def entries(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key of each signature.

        A key is 32 bits beside the bucket's number; keys that fall together by
        chance only make a pair that is not confirmed.
        """
        bucket = (self.sign % np.uint64(buckets)).astype(np.int64)
        return bucket, (self.sign // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def small_batches(batches):
    """The same rows, ``ROWS`` at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _pieces(batches, percent: int, draw: bool = False):
    held, size = [], 0
    for batch in small_batches(batches):
        for a, b, keys, cuts in shingle_sets(batch.column("text"), SHINGLE):
            sums = (np.r_[np.uint64(0), np.cumsum(mix(keys + np.uint64(salt)))] for salt in (1, 2))
            names = [np.diff(cuts), *((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums)]
            rough = np.full(b - a, CELLS)
            drawn = (sketches(keys, cuts, rough), sketches(keys, cuts, fine_cells(names[0]))) if draw else ([], [])
            held.append((batch.column("id").slice(a, b - a), names, drawn, *signatures(keys, cuts, percent)))
            size += len(keys) * 6
            if size >= PIECE:
                yield _Piece(held)
                held, size = [], 0
    if held:
        yield _Piece(held)


def sketches(keys: np.ndarray, cuts: np.ndarray, cells: np.ndarray) -> list[bytes]:
    """A byte per cell of the domain, a sum of features, for each set of so many cells (a power of 2).

    Of two sets so many cells differ at most as features do. A sketch of fewer
    cells is a sum of parts of one of more.
    """
    ends = np.r_[0, np.cumsum(cells)]
    row = np.repeat(np.arange(len(cells)), np.diff(cuts))
    sums = np.zeros(ends[-1], np.uint64)
    np.add.at(sums, ends[row] + (keys & (cells[row] - 1).astype(np.uint64)).astype(np.int64), mix(keys) >> np.uint64(56))
    sums = sums.astype(np.uint8)
    return [sums[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def fine_cells(sizes: np.ndarray) -> np.ndarray:
    """Cells of a fine sketch: about one or two per feature."""
    return np.array([max(CELLS, 1 << (max(int(n), 1) - 1).bit_length()) for n in sizes], np.int64)


def _finely_ruled_out(left: bytes, right: bytes, sizes: int, percent: int) -> bool:
    """``_ruled_out`` by fine sketches, the larger one folded to the cells of the other."""
    x, y = sorted((np.frombuffer(s, np.uint8) for s in (left, right)), key=len)
    y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.uint8)
    return int((x != y).sum()) > (100 - percent) * sizes // (100 + percent)


def _ruled_out(size: np.ndarray, sketch: np.ndarray, other_size: np.ndarray, other_sketch: np.ndarray, percent: int):
    """Pairs that cannot be similar by size or sketch."""
    small, large = np.minimum(size, other_size), np.maximum(size, other_size)
    # Similar sets share percent / (100 + percent) of the sum of their sizes at least.
    most = (100 - percent) * (size + other_size) // (100 + percent)
    return (100 * small < percent * large) | ((sketch != other_sketch).sum(axis=1) > most)


def _described(percent: int, buckets: int):
    """Size, sums and sketch of each set, and those of its signatures that another set of the task has."""

    def run(batches):
        for piece in _pieces(batches, percent, draw=True):
            bucket, key = piece.entries(buckets)
            named = (bucket << 32) | key
            _, where, times = np.unique(named, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(times[where] > 1)
            shared = shared[np.argsort(piece.owner[shared], kind="stable")]
            cuts = np.searchsorted(piece.owner[shared], np.arange(len(piece.ids) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.ids,
                    *map(pa.array, piece.names),
                    pa.array(piece.sketch, pa.binary()),
                    pa.array(piece.fine, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(named[shared])),
                ],
                names=["id", "n", "one", "two", "sketch", "fine", "signs"],
            )

    return run


DESCRIBED = "id long, n long, one long, two long, sketch binary, fine binary, signs array<long>"
PACKED = "bucket long, keys binary, runs binary, ids binary, pairs binary"


def _signed(percent: int, buckets: int):
    """A row per bucket: its signatures with the least id of each, and the pairs found here.

    Signatures of one id follow each other, so the id is sent once, with their number.
    """

    def run(batches):
        for piece in _pieces(batches, percent):
            if not len(piece.sign):
                continue
            ids = piece.ids.fill_null(0).to_numpy()[piece.owner]
            bucket, key = piece.entries(buckets)
            order = np.lexsort((ids, key, bucket))
            bucket, key, ids = bucket[order], key[order], ids[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]
            least = ids[new][np.cumsum(new) - 1]
            pair = np.unique(np.stack((least, ids), axis=1)[least != ids], axis=0)
            bucket, key, ids = bucket[new], key[new], ids[new]
            order = np.lexsort((ids, bucket))
            bucket, key, ids = bucket[order], key[order], ids[order]
            begin = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])])
            runs = np.diff(np.r_[begin, len(ids)]).astype(np.uint32)
            home = (mix(pair[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            pair, home, each = pair[order], home[order], np.arange(buckets + 1)
            of_keys, of_runs, of_pairs = (np.searchsorted(x, each) for x in (bucket, bucket[begin], home))
            sent = np.flatnonzero((np.diff(of_keys) > 0) | (np.diff(of_pairs) > 0))
            cut = lambda x, c: pa.array([x[c[b] : c[b + 1]].tobytes() for b in sent], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent), cut(key, of_keys), cut(runs, of_runs), cut(ids[begin], of_runs), cut(pair, of_pairs)],
                names=["bucket", "keys", "runs", "ids", "pairs"],
            )

    return run


def _joined(table: pa.Table) -> pa.Table:
    """Of a bucket: pairs ``a``, ``b``, and the sets ``a`` of each signature ``sign`` that tasks share."""
    joined = lambda c, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in table[c].to_pylist())])
    keys, ids = joined("keys", np.uint32), np.repeat(joined("ids", np.int64), joined("runs", np.uint32))
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    least = ids[new][np.cumsum(new) - 1]
    pairs = np.stack((least, ids), axis=1)[least != ids]
    pairs = np.unique(np.concatenate((pairs, joined("pairs", np.int64).reshape(-1, 2))), axis=0)
    shared = np.flatnonzero(np.repeat(np.diff(np.r_[np.flatnonzero(new), len(keys)]) > 1, np.diff(np.r_[np.flatnonzero(new), len(keys)])))
    sign = (table["bucket"][0].as_py() << 32) | keys[shared].astype(np.int64)
    return pa.table(
        {
            "a": pa.array(np.r_[pairs[:, 0], ids[shared]]),
            "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(shared), pa.int64())]),
            "sign": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(sign)]),
        }
    )


def _plausible(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` that neither size nor sketch rules out, with the size of ``b``."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("fine_a", "fine_b", "n_a", "n_b"))
            keep = [not _finely_ruled_out(x, y, n + m, percent) for x, y, n, m in zip(*columns)]
            yield batch.select(["a", "b", "n_b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: described.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    joined = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return joined.select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(trimmed(run), "a long, b long, n_b long")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size: bits of two hashes of each id."""
    bits = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(FILTER_BITS)) for i in (1, 2)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, value in words.collect():
        out[word] = value
    return out


def _named_by(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids``, and some others, left out before any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def among(one: pa.Array, two: pa.Array) -> pa.Array:
        known = np.ones(len(one), bool)
        for bit in (one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)):
            known &= (shared.value[bit >> 6] >> (bit & 63) & 1) == 1
        return pa.array(known)

    bits = (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(FILTER_BITS)) for i in (1, 2))
    return docs.where(F.arrow_udf(among, "boolean")(*bits))


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def _seated(batches):
    """The full set of each row, once per seat."""
    schema = pa.schema([("star", pa.int64()), ("salt", pa.int32()), ("center", pa.int32()), ("id", pa.int64()), ("full", pa.binary())])
    rows, size = [], 0
    for batch in small_batches(batches):
        ids, seats = batch.column("id").to_pylist(), batch.column("seats")
        for a, b, keys, cuts in shingle_sets(batch.column("text"), SHINGLE):
            for i in range(a, b):
                full = keys[cuts[i - a] : cuts[i - a + 1]].tobytes()
                for seat in seats[i].as_py():
                    rows.append((seat["star"], seat["salt"], seat["center"], ids[i], full))
                    size += len(full)
                    if size >= SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of ``pairs`` whose full sets are similar enough.

    All pairs of an ``a`` are a star; a star of many features is split by ``b``.
    """

    def check(table):
        sets = [np.frombuffer(x, np.uint64) for x in table["full"].to_pylist()]
        center, ids = table["center"].to_numpy(), table["id"].to_numpy()
        own = [sets[i] for i in np.flatnonzero(center == 1)]
        found = [i for i in np.flatnonzero(center == 0) if any(similar(x, sets[i], percent) for x in own)]
        return pa.table({"a": table["star"].take(pa.array(found, pa.int64())), "b": pa.array(ids[found], pa.int64())})

    salts = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / STAR).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(
        F.col("b").alias("id"), F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("center")
    )
    centers = salts.select(
        F.col("a").alias("id"), F.col("a").alias("star"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("center")
    )
    # A broadcast join would put the filter's Python workers beside those of the sets in one stage.
    seats = materialize(
        members.union(centers).groupBy("id").agg(F.collect_list(F.struct("star", "salt", "center")).alias("seats")), "seats"
    )
    full = _named_by(docs, seats.select("id")).join(seats.hint("merge"), "id").select("id", "text", "seats")
    full = full.mapInArrow(trimmed(_seated), "star long, salt int, center int, id long, full binary")
    return materialize(full.groupBy("star", "salt").applyInArrow(trimmed_group(check), "a long, b long"), "links")


def _met(percent: int):
    """Pairs of a block across components that size and sketch do not rule out.

    Rows come in order of signature, block and id; small blocks are gone through together.
    """

    def pairs_of(table: pa.Table) -> np.ndarray:
        sign, block, ids, comp, size, guest, minor = (
            table[c].to_numpy() for c in ("sign", "block", "id", "component", "n", "guest", "minor")
        )
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, CELLS)
        begin = np.flatnonzero(np.r_[True, (sign[1:] != sign[:-1]) | (block[1:] != block[:-1])])
        sizes = np.diff(np.r_[begin, len(sign)])
        found = [np.empty((0, 2), np.int64)]

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            """A visiting set meets one at home; of two visitors, the smaller id meets the other at home."""
            ok = (comp[i] != comp[j]) & (guest[i] != guest[j]) & ((guest[i] == 1) | (minor[i] == 0)) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            ok = ~_ruled_out(size[i], sketch[i], size[j], sketch[j], percent)
            found.append(np.stack((ids[i[ok]], ids[j[ok]]), axis=1))

        small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        end = np.repeat(begin + sizes, sizes)[small]
        for step in range(1, SMALL):
            inside = small + step < end
            if not inside.any():
                break
            meet(small[inside], small[inside] + step)
        for a, n in zip(begin[sizes > SMALL], sizes[sizes > SMALL]):
            for i in range(a, a + n - 1):
                meet(np.full(a + n - 1 - i, i), np.arange(i + 1, a + n))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            if not table.num_rows:
                continue
            sign, block = table["sign"].to_numpy(), table["block"].to_numpy()
            last = np.flatnonzero((sign != sign[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            left = table.slice(cut)
            if cut:
                yield from _as_pairs(pairs_of(table.slice(0, cut)))
        if left is not None:
            yield from _as_pairs(pairs_of(left))

    return run


def _as_pairs(pairs: np.ndarray):
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _across(members: DataFrame, named: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Pairs of one signature whose sets still lie in different components."""
    rows = materialize(
        members.join(named, "id", "left").select("sign", "id", F.coalesce("component", "id").alias("component")), "signatures"
    )
    mixed = (
        rows.groupBy("sign", "component").agg(F.count("*").alias("size"))
        .groupBy("sign").agg(
            F.sum("size").alias("all"), F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("major")
        )
        .where("parts > 1")
        .select("sign", F.col("major.component").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    )
    of_mixed = rows.join(mixed, "sign").select(
        "sign", "id", "component", "blocks", (F.col("component") != F.col("major")).cast("int").alias("minor")
    )
    at_home = of_mixed.select("*", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("guest"))
    visits = of_mixed.where("minor = 1").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("guest")
    )
    seats = materialize(at_home.union(visits), "seats")
    return (
        seats.join(described.select("id", "n", "sketch"), "id")
        .select("sign", "block", "id", "component", "n", "guest", "minor", "sketch")
        .repartition("sign", "block").sortWithinPartitions("sign", "block", "id")
        .mapInArrow(trimmed(_met(percent)), "a long, b long").distinct()
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Shingle count and component of each row under an exact Jaccard join.

    Links sets with ``100 * intersection >= percent * union`` after lower-casing
    A-Z. Returns ``id``, ``n_shingles`` and ``component``, the least id reachable
    by links, itself included. A text that is null or has no words has an empty
    set, linked with nothing; so is a row without an id, whose component is null.
    Rows of one id are one node: what links to one of them links to all. Equal
    sets link whatever their number; other columns of ``docs`` are not read.
    """
    if not 50 < percent < 100:
        raise ValueError("percent lies between 50 and 100")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    described = materialize(docs.mapInArrow(trimmed(_described(percent, buckets)), DESCRIBED), "described")
    usable = described.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = materialize(usable.groupBy("n", "one", "two").agg(F.min("id").alias("class")), "classes")
    copies = (
        usable.select("id", "n", "one", "two").join(classes, ["n", "one", "two"]).where("id != class")
        .select(F.col("class").alias("a"), F.col("id").alias("b"))
    )
    packed = docs.mapInArrow(trimmed(_signed(percent, buckets)), PACKED)
    joined = materialize(packed.groupBy("bucket").applyInArrow(trimmed_group(_joined), "a long, b long, sign long"), "joined")
    members = usable.select("id", F.explode("signs").alias("sign")).union(
        joined.where("sign is not null").select("a", "sign")
    )
    pairs = joined.where("sign is null").select("a", "b").distinct()
    pairs = materialize(_plausible(pairs, usable, percent), "pairs")
    links = materialize(_confirmed(pairs, docs, percent).union(copies), "links")
    named = materialize(components(links).toDF("id", "component"), "components")
    across = materialize(_across(members, named, usable, percent), "across")
    more = _confirmed(materialize(_plausible(across, usable, percent), "pairs"), docs, percent)
    whole = named.join(
        components(
            more.join(named.toDF("a", "left"), "a", "left").join(named.toDF("b", "right"), "b", "left")
            .select(F.coalesce("left", "a").alias("a"), F.coalesce("right", "b").alias("b"))
        ).toDF("component", "whole"),
        "component", "full",
    )
    # A set that only the second search linked has no component of the first.
    final = whole.select(F.coalesce("id", "component").alias("id"), F.coalesce("whole", "component").alias("component"))
    return described.join(final, "id", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")
    )


def join_report(docs: DataFrame) -> DataFrame:
    """``op11``: set size and component of each document."""
    out = jaccard_join(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
