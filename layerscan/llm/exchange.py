"""Questions from chunks of texts to hash buckets, and their answers, in packed rows.

A row for every window of a corpus would cost far more than the corpus itself.
Here documents are dealt into chunks by a hash; a chunk sends each bucket one
row with all its keys of that bucket, packed; a bucket sees all keys of its
hash range and sends each chunk one row back. A key costs a few bytes, a key
that a third of all documents share costs a bucket one entry per chunk, and
chunks and buckets grow with the square root of the corpus, so rows stay of
useful length and groups small.

Chunks are functions of the rows alone and a chunk's rows are put in order
before use, so a task that is run again asks and answers the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.words import trim

ASK = "bucket long, chunk long, keys binary, extra binary"
ASK_ARROW = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())]
)
ANSWER = "chunk long, keys binary"
ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("keys", pa.binary())])


def sides(docs: DataFrame, text: str, per_row: int) -> int:
    """Number of chunks and of buckets: the root of the corpus' bytes over ``per_row``."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(24, math.isqrt(size // per_row))


def chunked(docs: DataFrame, id_col: str, text: str, carry: tuple[str, ...], n: int) -> DataFrame:
    """Id, text, carried columns and the chunk of each row."""
    return docs.select(
        F.pmod(F.xxhash64(id_col, text), F.lit(n)).alias("chunk"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text).alias("text"),
        *(F.struct(*carry).alias("rest") for _ in carry[:1]),
    )


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk by id, then text."""
    return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))


def send(chunk: int, n: int, by: np.ndarray, keys: np.ndarray, *extras: np.ndarray) -> pa.Table:
    """One row per bucket (``by`` modulo ``n``) with its keys and extras, packed."""
    bucket = (by % np.uint64(n)).astype(np.uint32)
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    used = np.flatnonzero(np.diff(cuts))
    columns = [np.ascontiguousarray(x[order]) for x in (keys, *extras)]
    parts = lambda x: [x[cuts[b] : cuts[b + 1]].tobytes() for b in used]
    extra = [b"".join(x) for x in zip(*map(parts, columns[1:]))] if extras else [b""] * len(used)
    return pa.table(
        [pa.array(used), pa.array(np.full(len(used), chunk)), pa.array(parts(columns[0]), pa.binary()), pa.array(extra, pa.binary())],
        schema=ASK_ARROW,
    )


def unpack(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and the row each belongs to."""
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    sizes = [len(x) for x in rows]
    values = np.concatenate(rows) if rows else np.empty(0, kind)
    return values, np.repeat(np.arange(len(rows)), sizes)


def reply(chunks: np.ndarray, row: np.ndarray, keys: np.ndarray) -> pa.Table:
    """Sends ``keys``, which lie by ``row``, back to the chunks of their rows."""
    cuts = np.searchsorted(row, np.arange(len(chunks) + 1))
    used = np.flatnonzero(np.diff(cuts))
    packed = [keys[cuts[r] : cuts[r + 1]].tobytes() for r in used]
    return pa.table([pa.array(chunks[used]), pa.array(packed, pa.binary())], schema=ANSWER_ARROW)


def _trimmed(table: pa.Table) -> pa.Table:
    """The answer of a group, with the memory of its work given back."""
    trim()
    return table


def ask(chunks: DataFrame, question: Callable[[int, pa.Table], Iterator[pa.Table]]) -> DataFrame:
    """Rows for the buckets from each chunk's rows."""

    def run(key, table):
        return _trimmed(pa.concat_tables([ASK_ARROW.empty_table(), *question(key[0].as_py(), ordered(table))]))

    return chunks.groupBy("chunk").applyInArrow(run, ASK)


def ask_again(
    chunks: DataFrame, answers: DataFrame, question: Callable[[int, pa.Table, pa.ChunkedArray], Iterator[pa.Table]]
) -> DataFrame:
    """Rows for the buckets from each chunk's rows and the answers that it got."""

    def run(key, table, got):
        return _trimmed(pa.concat_tables([ASK_ARROW.empty_table(), *question(key[0].as_py(), ordered(table), got["keys"])]))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ASK)


def answer(asked: DataFrame, reply_to: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Rows for the chunks from all that a bucket was asked."""

    def run(table):
        return _trimmed(reply_to(table.sort_by("chunk")))

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def finish(
    chunks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.ChunkedArray], pa.Table], schema: str
) -> DataFrame:
    """Result rows from each chunk's rows and the answers that it got."""

    def run(table, got):
        return _trimmed(work(ordered(table), got["keys"]))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
