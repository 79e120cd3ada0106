"""Importance resampling towards a target distribution, ranked by a radix sort.

Runs of words fall into hashed buckets; a bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus. A text's weight sums an array of
gains over its features. With a Gumbel number of its id added, the greatest scores
are a draw without replacement in proportion to exponentiated weights.

Ranks come from a distributed radix sort, least significant digit first. The
key of a row (score, then id, then features) is cut into digits of ``DIGIT``
bits. A pass counts digits per block of rows; prefix sums over digits and, within
a digit, over blocks give every block's first destination for the digit, and a row
goes there plus its place among the block's rows of the digit, which keeps order.
So no task sorts more than a block's rows of one digit, and after the last pass
a row's position is its rank. Each pass is written to the shared folder.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerscan.llm.words import text_bytes
from layerscan.session import materialize

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 1
SEED = 2024
#: Words from which a text can be drawn, and the share of such texts that is.
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit, and rows of a block.
DIGIT, BLOCK = 12, 1 << 16
#: Words whose buckets a task remembers at once.
MEMORY = 200_000
#: Bytes of a text whose features are held at once.
PIECE = 1 << 20

#: Letters and digits stay, A-Z lower-cased; other ASCII parts words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


class Buckets(dict):
    """Buckets of features; remembers those of ``MEMORY`` at most."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < MEMORY and len(feature) < 256:
            self[feature] = bucket
        return bucket


def word_runs(text: bytes, carried: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in stretches, each with the ``carried`` words before it, and how many these are."""
    text, at, before = text.translate(_TABLE), 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words = before + text[at:end].split()
        yield words, len(before)
        before = words[len(words) - carried :] if carried else []
        at = end


def features(text: bytes, known: Buckets, run: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretch by stretch: new words, and the buckets of all features that end in them."""
    for words, old in word_runs(text, run - 1):
        found = list(map(known.__getitem__, words[old:]))
        for size in range(2, run + 1):
            ends = range(max(size, old + 1), len(words) + 1)
            found += [known[b" ".join(words[end - size : end])] for end in ends]
        yield len(words) - old, np.array(found, np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, bounds = text_bytes(batch.column("text"))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield data[a:b].tobytes()


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``bucket`` and ``n``, its features over all rows; a task sends one row per bucket."""

    def count(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in _texts(batch):
                for _, found in features(raw, known, run):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket from the bucket counts of corpus and target.

    The driver holds ``buckets`` numbers of either, whatever the size of the tables.
    """
    counts = []
    for counted in (corpus, target):
        own = [0] * buckets
        for bucket, n in counted.collect():
            own[bucket] = n
        counts.append(own)
    (s, t), (all_s, all_t) = counts, map(sum, counts)
    ratio = lambda x, y: (float(y + 1) * float(all_s + buckets)) / (float(x + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(x, y))) for x, y in zip(s, t)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``id``, words, features and weight of each row of ``id`` and ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        known, own = Buckets(len(shared.value)), shared.value
        for batch in batches:
            out = []
            for raw in _texts(batch):
                parts = [(n, len(found), int(own[found].sum())) for n, found in features(raw, known, run)]
                out.append(tuple(map(sum, zip(*parts))) if parts else (0, 0, 0))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns], names=["id", "n_words", "n_features", "weight"]
            )

    return docs.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel number of the id, rounded down; a null id counts as no text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _digit(fields: list[tuple[Column, int]], at: int) -> Column:
    """Bits ``at`` to ``at + DIGIT`` of the fields put in a row, the least significant first."""
    out, low = F.lit(0).cast("long"), 0
    for value, width in fields:
        a, b = max(at, low), min(at + DIGIT, low + width)
        if a < b:
            part = F.shiftrightunsigned(value, a - low).bitwiseAND((1 << (b - a)) - 1)
            out = out.bitwiseOR(F.shiftleft(part, a - at))
        low += width
    return out.cast("int")


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """Rows moved to where a stable counting sort by ``digit`` puts them."""
    rows = rows.withColumn("block", F.shiftright("pos", int(math.log2(BLOCK)))).withColumn("digit", digit)
    counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # One row per digit at most, whatever the number of rows.
    every = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    first = every.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(first, "digit")
    starts = starts.select("digit", "block", (F.col("first") + F.col("earlier")).alias("start"))
    place = F.row_number().over(Window.partitionBy("digit", "block").orderBy("pos")) - 1
    moved = rows.withColumn("place", place).join(starts, ["digit", "block"])
    return moved.withColumn("pos", F.col("start") + F.col("place")).drop("digit", "block", "start", "place")


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with ``rank`` from 1 by the long columns ``keys``; True is for descending.

    Nulls come last. Rows with equal keys get neighbouring ranks in any order.
    """
    ends = [f(c).alias(f"{f.__name__}_{c}") for c, _ in keys for f in (F.min, F.max)]
    bounds = rows.agg(*ends).first()
    fields = []
    for c, falling in reversed(keys):
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        if low is None:
            continue
        offset = F.lit(high) - F.col(c) if falling else F.col(c) - F.lit(low)
        fields.append((F.coalesce(offset, F.lit(high - low + 1)), (high - low + 1).bit_length()))
    rows = materialize(rows.withColumn("pos", F.monotonically_increasing_id()), "positions")
    width = sum(w for _, w in fields)
    # A pass at least makes positions dense.
    for at in range(0, max(width, 1), DIGIT):
        rows = materialize(_pass(rows, _digit(fields, at)), "positions")
    return rows.withColumn("rank", F.col("pos") + 1).drop("pos")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED,
) -> DataFrame:
    """Features, weight, score and rank of every row; rows that are not drawn have no rank.

    Returns ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.
    Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn (rounded
    down), greatest score first, then smallest id; rows without an id come last
    among equals, and repeated rows take neighbouring ranks. A null or empty text
    has no features and weighs 0; ``target`` may be empty. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(docs, "text", buckets, run), bucket_counts(target, text, buckets, run), buckets)
    scored = materialize(
        weighed(docs, gain, run).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored"
    )
    usable = scored.where(F.col("n_words") >= least_words)
    drawn = usable.count() * percent // 100
    ranked = radix_ranks(usable, [("score", True), ("id", False), ("n_features", False)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(
        scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    )


def resample_report(spark, sf_dir: str) -> DataFrame:
    """``op13``: documents drawn to resemble the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = resample(docs, target)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = """
WITH RECURSIVE texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM texts
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS word FROM benchmark
), steps AS (
  SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), crc_table AS (
  SELECT i, c FROM steps WHERE k = 8
), occurrences AS (
  SELECT r, unnest(words) AS word FROM doc_words
), vocabulary AS (
  SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM occurrences UNION SELECT word FROM target_words)
), crcs AS (
  SELECT word, bytes, 1 AS place, 4294967295::BIGINT AS c FROM vocabulary
  UNION ALL
  SELECT word, bytes, place + 2, xor(crcs.c // 256, t.c)
  FROM crcs JOIN crc_table t ON t.i = xor(crcs.c % 256, ('0x' || substr(bytes, place, 2))::BIGINT)
  WHERE place < length(bytes)
), hashed AS (
  SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crcs WHERE place > length(bytes)
), corpus AS (
  SELECT bucket, count(*) AS s FROM occurrences JOIN hashed USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(s) FROM corpus), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS all_t
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000))
    / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM corpus FULL JOIN target USING (bucket) CROSS JOIN totals
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM occurrences JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE
    ))))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
