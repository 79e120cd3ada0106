"""Pixel rows packed by block of an image, for sums over neighbours.

A pixel row is ten times as wide as its three numbers. Rows that have all other
columns in common are packed before they are shuffled and sorted, which then
move and hold a row per block, and a task works on one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of a packed pixel, and the one that stands for null.
CELL = np.dtype("<i4")
NULL = np.iinfo(CELL).min


def blocks_near(position: str, side: int, reach: int) -> Column:
    """Blocks that hold a position or have it in their halo; without position, block 0."""
    first, last = F.floor((F.col(position) - reach) / side), F.floor((F.col(position) + reach) / side)
    return F.coalesce(F.sequence(first, last), F.array(F.lit(0).cast("bigint")))


def block_of(position: str, side: int) -> Column:
    return F.coalesce(F.floor(F.col(position) / side), F.lit(0))


def with_blocks(pixels: DataFrame, side: int, reach: int) -> DataFrame:
    """Pixels with a copy for each ``block_y``, ``block_x`` that sees them, and ``own`` of one of them."""
    own = (F.col("block_y") == block_of("y", side)) & (F.col("block_x") == block_of("x", side))
    return (
        pixels.withColumn("block_y", F.explode(blocks_near("y", side, reach)))
        .withColumn("block_x", F.explode(blocks_near("x", side, reach)))
        .withColumn("own", own)
    )


def codes(columns: Sequence[pa.Array], rows: int) -> np.ndarray:
    """Equal numbers for rows that are equal in all columns, nulls included."""
    out, most = np.zeros(rows, np.int64), 1
    for column in columns:
        found = column.dictionary_encode()
        values = len(found.dictionary) + 1
        index = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        if most > (1 << 62) // values:
            out = np.unique(out, return_inverse=True)[1]
            most = rows
        out, most = out * values + index, most * values
    return out


def packed_cells(pixels: DataFrame, by: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Rows of an Arrow batch that are equal in ``by`` as one row, whose ``cells`` are their numbers."""
    kept, width = len(by), len(numbers)
    schema = T.StructType([*(pixels.schema[c] for c in by), T.StructField("cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = codes(batch.columns[:kept], batch.num_rows)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=code[order[0]] - 1))
            cells = np.stack([c.fill_null(NULL).to_numpy() for c in batch.columns[kept:]], axis=1)[order].astype(CELL)
            bounds = np.append(starts, batch.num_rows) * (width * CELL.itemsize)
            first = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays(
                [*(c.take(first) for c in batch.columns[:kept]), binaries(bounds, cells)], names=[*by, "cells"]
            )

    return pixels.select(*by, *(F.col(c).cast("int").alias(f"number_{c}") for c in numbers)).mapInArrow(run, schema)


def binaries(bounds: np.ndarray, content: np.ndarray) -> pa.Array:
    """Binary values from the bounds of each in contiguous content."""
    buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(content))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def runs(
    batches: Iterator[pa.RecordBatch], by: Sequence[str], width: int
) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sorted packed rows, those equal in ``by`` together.

    Gives the values of ``by``, the rows without their cells, the cells (n x
    ``width``) and the row of each.
    """
    key, parts, cells = None, [], []

    def joined():
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        sizes = np.array([len(c) for c in cells])
        return key, rows, np.concatenate(cells), np.repeat(np.arange(len(cells)), sizes)

    for batch in batches:
        if not batch.num_rows:
            continue
        code = codes([batch.column(c) for c in by], batch.num_rows)
        starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1)).tolist()
        plain = batch.select([c for c in batch.schema.names if c != "cells"])
        packed = batch.column("cells")
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            here = tuple(batch.column(c)[start].as_py() for c in by)
            if here != key:
                if parts:
                    yield joined()
                key, parts, cells = here, [], []
            parts.append(plain.slice(start, end - start))
            cells.extend(np.frombuffer(packed[i].as_buffer(), CELL).reshape(-1, width) for i in range(start, end))
    if parts:
        yield joined()


class Places:
    """Finds the cells of a layer by position within a box."""

    def __init__(self, x: np.ndarray, y: np.ndarray, box: tuple[int, int, int]) -> None:
        left, top, side = box
        place = (y.astype(np.int64) - top) * side + (x.astype(np.int64) - left)
        self.order = np.argsort(place, kind="stable")
        found, first, count = np.unique(place[self.order], return_index=True, return_counts=True)
        self.first, self.count = np.zeros(side * side, np.int32), np.zeros(side * side, np.int32)
        self.first[found], self.count[found] = first, count
        self.any = len(found) > 0


#: A layer without any cell.
NOWHERE = Places(np.empty(0), np.empty(0), (0, 0, 1))
