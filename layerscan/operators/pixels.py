"""Frames, pixel rows and the way between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.packed import pack_images, unpack_temps
from layerscan.functions.pixel import is_candidate, is_saturated
from layerscan.operators.cells import CELL, NULL, packed_cells, runs
from layerscan.params import Params
from layerscan.schema import FRAME, IMAGE

#: Columns of a pixel itself.
PIXEL = ("x", "y", "temp")
#: Pixels of a dense grid that go in one Arrow batch.
DENSE_ROWS = 1 << 16


def frames_from_pixels(
    pixels: DataFrame, width: int, height: int, image: Sequence[str] = IMAGE
) -> DataFrame:
    """Dense packed frames from sparse pixel rows; missing pixels are zero.

    A group is one image, so its size is bounded by width * height.
    """
    position = (F.col("y") * width + F.col("x")).cast("int")
    cells = (
        pixels.groupBy(*image)
        .agg(F.collect_list(F.struct(position.alias("pos"), "temp")).alias("cells"))
        .select(*image, "cells.pos", "cells.temp")
    )
    schema = T.StructType([*cells.schema.fields[:-2], T.StructField("temps", T.BinaryType())])
    packed = cells.mapInArrow(lambda batches: pack_images(batches, width * height), schema)
    return packed.select(
        *image, F.lit(width).alias("width"), F.lit(height).alias("height"), "temps"
    )


def pixel_rows(frames: DataFrame) -> DataFrame:
    """One row per pixel: column x, row y, temp."""
    kept = [c for c in frames.columns if c not in ("width", "height", "temps")]
    return (
        frames.select(*kept, "width", unpack_temps("temps").alias("temps"))
        .select(*kept, "width", F.posexplode("temps").alias("pos", "temp"))
        .select(
            *kept,
            (F.col("pos") % F.col("width")).alias("x"),
            F.expr("pos div width").cast("int").alias("y"),
            "temp",
        )
    )


def densify(
    pixels: DataFrame,
    width: int | Column,
    height: int | Column,
    image: Sequence[str] = IMAGE,
    margin: int = 0,
) -> DataFrame:
    """Full grids of pixel rows, with zeros where ``pixels`` has none.

    The pixels of an image are packed and meet in one task, an image at a time,
    where the zeros are added. ``margin`` extends a grid to the right and
    downwards for keys whose images differ in size.
    """
    sides = [(F.lit(side) + F.lit(margin)).cast("int") for side in (width, height)]
    packed = packed_cells(pixels.select(*image, "x", "y", "temp"), list(image), PIXEL)
    ordered = packed.repartition(*image).sortWithinPartitions(*image)
    sized = ordered.select(*image, sides[0].alias("columns"), sides[1].alias("rows"), "cells")
    schema = T.StructType([*(pixels.schema[c] for c in image), *(T.StructField(c, T.IntegerType()) for c in PIXEL)])
    dense = sized.mapInArrow(lambda batches: _dense(batches, list(image)), schema)
    return dense.select(*image, *(F.col(c).cast(pixels.schema[c].dataType) for c in ("x", "y")), "temp")


def _dense(batches: Iterator[pa.RecordBatch], image: list[str]) -> Iterator[pa.RecordBatch]:
    for _, rows, cells, _ in runs(batches, image, len(PIXEL)):
        wide, high = (rows.column(c)[0].as_py() or 0 for c in ("columns", "rows"))
        x, y = cells[:, 0], cells[:, 1]
        inside = (x >= 0) & (x < wide) & (y >= 0) & (y < high)
        grid = np.zeros(max(wide, 0) * max(high, 0), CELL)
        np.maximum.at(grid, y[inside].astype(np.int64) * wide + x[inside], cells[inside, 2])
        for start in range(0, len(grid), DENSE_ROWS):
            place = np.arange(start, min(start + DENSE_ROWS, len(grid)))
            yield _rows_of(rows, image, place % wide, place // wide, grid[place])
        # Pixels off the grid stay as they are.
        beyond, at = np.unique(cells[~inside, :2], axis=0, return_inverse=True)
        if len(beyond):
            temps = np.full(len(beyond), NULL, CELL)
            np.maximum.at(temps, at.ravel(), cells[~inside, 2])
            yield _rows_of(rows, image, *beyond.T, temps)


def _rows_of(rows: pa.RecordBatch, image: list[str], *numbers: np.ndarray) -> pa.RecordBatch:
    """Pixel rows of the image that ``rows`` are of."""
    kept = rows.select(image).take(pa.array(np.zeros(len(numbers[0]), np.int64)))
    own = [pa.array(c, pa.int32(), mask=c == NULL) for c in numbers]
    return pa.RecordBatch.from_arrays([*kept.columns, *own], names=[*image, *PIXEL])


def saturated_count(
    pixels: DataFrame, params: Params = Params(), image: Sequence[str] = FRAME
) -> DataFrame:
    """Saturated pixels of each image, zero included."""
    return pixels.groupBy(*image).agg(
        F.count_if(is_saturated(F.col("temp"), params)).cast("int").alias("saturated")
    )


def candidate_pixels(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    return pixels.filter(is_candidate(F.col("temp"), params))
