"""Arrow helpers for packed images (little-endian unsigned 16-bit samples)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

SAMPLE = np.dtype("<u2")


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row boundaries and the bytes of a binary column, without copying."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bounds, content


@arrow_udf(T.ArrayType(T.IntegerType()))
def unpack_temps(temps: pa.Array) -> pa.Array:
    """Samples of each packed image as an array."""
    bounds, content = _flat_bytes(temps)
    samples = content[bounds[0] : bounds[-1]].view(SAMPLE).astype(np.int32)
    starts = (bounds - bounds[0]) // SAMPLE.itemsize
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(samples))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that what is made of a batch at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def pack_images(
    batches: Iterator[pa.RecordBatch], size: int, chunk_bytes: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Packed images of ``size`` pixels from ``positions`` and ``temps``, zero elsewhere.

    The two lists come last and give way to the image. Images are sent in
    chunks of bounded size, since sparse lists do not bound them.
    """
    rows = max(1, chunk_bytes // (size * SAMPLE.itemsize))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            *kept, positions, temps = part.columns
            image_of = np.repeat(np.arange(part.num_rows), positions.value_lengths().to_numpy())
            samples = np.zeros(part.num_rows * size, SAMPLE)
            samples[image_of * size + positions.flatten().to_numpy()] = temps.flatten().to_numpy()
            offsets = np.arange(part.num_rows + 1) * (size * SAMPLE.itemsize)
            images = pa.Array.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(samples)]
            ).cast(pa.binary())
            names = [*part.schema.names[:-2], "temps"]
            yield pa.RecordBatch.from_arrays([*kept, images], names=names)
