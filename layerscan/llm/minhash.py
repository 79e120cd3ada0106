"""MinHash near-dedup with sequential Bayesian verification.

A document is its set of distinct word shingles. Documents of one set form a
class. Signatures of classes are banded; within a bucket each class is paired
with the least one, so a bucket of n classes gives n - 1 pairs. Pairs are
compared in batches of signature values and dropped once the posterior
probability that they are similar enough falls below ``MISS``; the rest are
confirmed on the full sets. Buckets whose classes then still lie in several
components are taken up again: their classes meet in blocks of bounded size,
where pairs across components go through the same bounds; what is left is
confirmed, once per pair, where the full sets of the block meet, so no row is
made for a pair. No bucket, partner or candidate is capped.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.batches import materialize_in_small_batches
from layerscan.llm.components import components
from layerscan.llm.words import Words, lower_ascii, mix, slices, text_bytes, trimmed, window_hashes
from layerscan.session import materialize

SHINGLE = 5
ROWS, BANDS = 6, 42
VALUES = ROWS * BANDS
BATCH = 36
#: Posterior probability of enough similarity below which a pair is dropped.
MISS = 1e-6
#: Classes in a block when a bucket is taken up again.
BLOCK = 512
PIECE = 4 << 20

_MULTIPLIERS = (
    np.random.default_rng(20240229).integers(1, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each text, as one array and its bounds.

    A text of fewer words counts as one shingle, a text without words as none.
    """
    data, bounds = text_bytes(column)
    for a, b in slices(bounds, PIECE):
        part = lower_ascii(data[bounds[a] : bounds[b]])
        words = Words(part, bounds[a : b + 1] - bounds[a])
        hashes, counts = words.hashes(), words.counts
        at, keys = window_hashes(hashes, words.first, size)
        text = words.text_of()[at] if len(at) else np.empty(0, np.int64)
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            own = hashes[words.first[i] : words.first[i + 1]]
            whole = mix(np.array([sum(int(h) * (j + 3) for j, h in enumerate(own)) % (1 << 64)], np.uint64))
            keys, text = np.r_[keys, whole], np.r_[text, i]
        order = np.lexsort((keys, text))
        keys, text = keys[order], text[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])] if len(keys) else np.empty(0, bool)
        keys, text = keys[new], text[new]
        yield a, b, keys, np.searchsorted(text, np.arange(b - a + 1))


def signature(keys: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least of each of VALUES permutations of the keys."""
    # No permutation moves 0.
    small = np.maximum((keys >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(small), 1024):
        np.minimum(least, (small[None, i : i + 1024] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return (least * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of each signature (rows)."""
    parts = sign.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def least_matches(percent: int) -> list[tuple[int, int]]:
    """After so many compared values, the matches below which a pair is dropped.

    With a uniform prior, m of n matches make the posterior of a similarity of
    t or more the chance of at most m successes in n + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def plausible(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays pass all bounds, compared batch by batch."""
    alive = np.arange(len(right))
    matches, begin = np.zeros(len(right), np.int64), 0
    for n, least in bounds:
        own = left[alive] if len(left) > 1 else left
        matches[alive] += (own[:, begin:n] == right[alive, begin:n]).sum(axis=1)
        alive, begin = alive[matches[alive] >= least], n
    return alive


def _described(batches):
    for batch in batches:
        text = batch.column("text")
        for a, b, keys, cuts in shingle_sets(text):
            size = np.diff(cuts)
            sums = [np.r_[np.uint64(0), np.cumsum(mix(keys + np.uint64(salt)))] for salt in (1, 2)]
            one, two = ((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums)
            signs = [signature(keys[i:j]).tobytes() if j > i else None for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), pa.array(size), pa.array(one), pa.array(two), pa.array(signs, pa.binary())],
                names=["id", "n", "one", "two", "sign"],
            )


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _banded(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_signs(batch.column("sign"))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)),
                    pa.array(keys.ravel()),
                ],
                names=["id", "band", "key"],
            )


def _plausible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` that pass the bounds on their signatures."""
    bounds = least_matches(percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = plausible(_signs(batch.column("sign_a")), _signs(batch.column("sign_b")), bounds)
                yield batch.select(["a", "b"]).take(pa.array(found))

    def side(c):
        return classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    # Sets whose sizes differ by more cannot be similar enough.
    joined = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return joined.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``id`` and packed shingle set of the named documents."""

    def full(batches):
        for batch in batches:
            for a, b, keys, cuts in shingle_sets(batch.column("text")):
                packed = [keys[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(packed, pa.binary())], names=["id", "full"]
                )

    return materialize_in_small_batches(
        docs.join(ids.distinct(), "id", "left_semi").mapInArrow(trimmed(full), "id long, full binary"), "sets"
    )


def _similar(left: bytes, right: bytes, percent: int) -> bool:
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            sides = zip(batch.column("full_a"), batch.column("full_b"))
            keep = [_similar(x.as_py(), y.as_py(), percent) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    joined = pairs.join(sets.toDF("a", "full_a"), "a").join(sets.toDF("b", "full_b"), "b")
    return materialize_in_small_batches(
        joined.select("a", "b", "full_a", "full_b").mapInArrow(run, "a long, b long"), "links"
    )


BUCKET = ("band", "key", "low", "high")


def _plausible_in_buckets(members: DataFrame, named: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Classes with plausible partners of other components in their bucket.

    Buckets of several components are cut into blocks; a row per class of a
    pair of blocks holds the partners to be compared, packed.
    """
    bounds = least_matches(percent)

    def run(key, table):
        band, _, low, high = (k.as_py() for k in key)
        ids, comp, size = (table[c].to_numpy() for c in ("id", "component", "n"))
        block = table["block"].to_numpy()
        signs = _signs(table["sign"].combine_chunks())
        bands = band_keys(signs)
        partners, used = [b""] * len(ids), np.zeros(len(ids), bool)
        for i in range(len(ids)):
            if low != high and block[i] != low:
                continue
            other = np.arange(i + 1, len(ids)) if low == high else np.flatnonzero(block != low)
            other = other[(comp[other] != comp[i]) & (ids[other] != ids[i])]
            small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            other = other[100 * small >= percent * large]
            # A pair counts in the first band that its classes share.
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band]
            other = other[plausible(signs[i : i + 1], signs[other], bounds)]
            if len(other):
                partners[i] = ids[other].tobytes()
                used[i] = used[other] = True
        use = pa.array(used)
        out = {c: pa.array([k.as_py()] * len(ids), k.type) for c, k in zip(BUCKET, key)}
        out |= {"id": table["id"], "component": table["component"], "partners": pa.array(partners, pa.binary())}
        return pa.table(out).filter(use)

    several = (
        members.join(named, "id").groupBy("band", "key")
        .agg(F.count("*").alias("size"), F.min("component").alias("first"), F.max("component").alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("band", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    rows = (
        members.join(several, ["band", "key"]).join(named, "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component")
        .join(classes.select("id", "n", "sign"), "id")
    )
    schema = "band int, key long, low int, high int, id long, component long, partners binary"
    return rows.groupBy(*BUCKET).applyInArrow(run, schema)


def _linked_in_buckets(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` between components, confirmed on the full sets where a bucket's block meets.

    Components that a block has already linked need no second link from it.
    """

    def run(table):
        ids, comp = table["id"].to_pylist(), table["component"].to_pylist()
        full = dict(zip(ids, table["full"].to_pylist()))
        component, above = dict(zip(ids, comp)), {c: c for c in comp}

        def top(c):
            while above[c] != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        found = []
        for i, packed in zip(ids, table["partners"].to_pylist()):
            for j in np.frombuffer(packed, np.int64).tolist():
                x, y = top(component[i]), top(component[j])
                if x != y and _similar(full[i], full[j], percent):
                    above[x] = y
                    found.append((component[i], component[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = _full_sets(rows.select("id"), docs)
    return materialize(
        rows.join(sets, "id").groupBy(*BUCKET).applyInArrow(run, "a long, b long"), "links"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Shingle count and near-duplicate component of each row.

    Links sets with ``100 * intersection >= percent * union`` after lower-casing
    A-Z. Returns ``id``, ``n_shingles``, ``component`` (the least id reachable,
    itself included) and ``kept`` (the row's id is its component's). A text that
    is null or has no words has an empty set and is linked with nothing; so is a
    row without an id, whose component is null and which is kept. Rows of one id
    share their component if their sets are equal or linked.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    described = materialize_in_small_batches(
        docs.mapInArrow(trimmed(_described), "id long, n long, one long, two long, sign binary"), "described"
    )
    usable = described.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = materialize(
        usable.groupBy("one", "two").agg(F.min(F.struct("id", "n", "sign")).alias("least")).select("one", "two", "least.*"),
        "classes",
    )
    banded = materialize(classes.mapInArrow(trimmed(_banded), "id long, band int, key long"), "bands")
    shared = (
        banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("id").alias("center"))
        .where("size > 1").select("band", "key", "center")
    )
    members = materialize(banded.join(shared, ["band", "key"]), "members")
    stars = members.where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    tried = materialize(_plausible_pairs(stars, classes, percent), "stars")
    links = _confirmed(tried, docs, percent)
    found = materialize(components(links), "components")
    named = members.select("id").distinct().join(found.toDF("id", "component"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
    named = materialize(named, "named")
    more = materialize(_plausible_in_buckets(members.select("id", "band", "key"), named, classes, percent), "more")
    joined = components(_linked_in_buckets(more, docs, percent)).toDF("component", "whole")
    final = materialize(
        named.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component")), "final"
    )
    by_class = classes.select("one", "two", "id").join(final, "id", "left").select(
        "one", "two", F.coalesce("component", "id").alias("component")
    )
    usable_one = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("one"))
    return (
        described.select("id", "n", usable_one.alias("one"), "two").join(by_class, ["one", "two"], "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
    )


def near_report(docs: DataFrame) -> DataFrame:
    """``op10``: shingles, component and verdict of each document."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
