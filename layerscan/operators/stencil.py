"""Neighbourhood sums over pixel rows, across space and layers.

``neighbour_join`` is the direct form: every pixel meets every stencil
offset, in its block of the image. ``diamond_sums`` needs no pairs: each layer
is summed once over growing diamonds, and the sums of three layers combine into
both means. Both serve pixel tables; ``operators.bands`` serves packed frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.pixel import is_candidate, is_outlier
from layerscan.operators.cells import CELL, NOWHERE, NULL, Places, packed_cells, runs, with_blocks
from layerscan.operators.layers import has_full_window, layer_chunks, layer_window
from layerscan.operators.pixels import PIXEL
from layerscan.params import Params
from layerscan.schema import FRAME

#: Sums of a pixel's neighbourhoods.
TOTALS = ("close_sum", "outer_sum")
#: Pixels whose lists of neighbours go in one Arrow batch.
LISTED = 4096


def _offsets(params: Params) -> list[tuple[int, int, int]]:
    """(layers back, dx, dy) of every offset, by layers back."""
    span = range(-params.reach, params.reach + 1)
    return [
        (back, dx, dy)
        for back in range(params.window_size)
        for dy in span
        for dx in span
        if abs(dx) + abs(dy) + back <= params.reach
    ]


def _offset_array(params: Params) -> str:
    """SQL text of the constant array of (kind, layer_offset, dx, dy)."""
    cells = []
    for back, dx, dy in _offsets(params):
        kind = "close" if abs(dx) + abs(dy) + back <= params.distance_factor else "outer"
        cells.append(f"named_struct('kind', '{kind}', 'layer_offset', {back}, 'dx', {dx}, 'dy', {dy})")
    return f"array({', '.join(cells)})"


def stencil_offsets(spark: SparkSession, params: Params = Params()) -> DataFrame:
    """The offsets of both neighbourhoods: one row per (layer_offset, dx, dy)."""
    return spark.range(1).selectExpr(f"inline({_offset_array(params)})")


def neighbour_lists(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """Candidate pixels of full windows, each with the list ``near`` of its neighbours.

    The list has the stencil offset's number and ``n_temp`` of every neighbour.
    A pixel meets its neighbours in its block (key, chunk of layers, square of
    ``band_rows`` pixels with a halo), so pixels are shuffled, packed, and their
    pairs are not. Of a block three layers are held at a time.
    """
    side, reach, keys = params.band_rows, params.reach, list(params.key_cols)
    kept = list(dict.fromkeys([*keys, *FRAME]))
    group = [*keys, "chunk", "block_y", "block_x"]
    ours = F.col("chunk") == F.floor((F.col("seq") - 1) / params.chunk_layers)
    chosen = F.col("own") & ours & has_full_window(params) & is_candidate(F.col("temp"), params)
    dealt = (
        with_blocks(pixels.select(*kept, "x", "y", "temp").filter(F.col("seq").isNotNull()), side, reach)
        .withColumn("chunk", F.explode(layer_chunks(params)))
        .withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    )
    columns = [*kept, "chunk", "block_y", "block_x"]
    packed = packed_cells(dealt, columns, ["x", "y", "temp", "chosen"])
    ordered = packed.repartition(*group).sortWithinPartitions(*group, "seq")
    near = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n_temp", T.LongType())]))
    schema = T.StructType([*(pixels.schema[c] for c in (*kept, "x", "y")), T.StructField("near", near)])
    return ordered.mapInArrow(lambda batches: _list_batches(batches, group, kept, params), schema)


def neighbour_pairs(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """Candidate pixels of full windows next to every neighbour they have.

    One row per pixel and stencil offset; ``n_temp`` is null for a neighbour
    that is off the grid or, on sparse pixels, missing.
    """
    offset = F.element_at(F.expr(_offset_array(params)), F.col("slot") + 1)
    return (
        neighbour_lists(pixels, params)
        .select(*FRAME, "x", "y", F.inline("near"))
        .select(
            *FRAME, "x", "y", *(offset[c].alias(c) for c in ("kind", "layer_offset", "dx", "dy")), "n_temp"
        )
    )


def neighbour_join(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """Sums of both neighbourhoods by joining each pixel to each neighbour.

    A missing neighbour adds nothing to the sum but counts in the
    denominator. Each candidate pixel expands to one row per offset where its
    block lies, so this form is for cross-checks and sparse data.
    """

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_temp"))), F.lit(0))

    return (
        neighbour_pairs(pixels, params)
        .groupBy(*FRAME, "x", "y")
        .agg(total("close").alias("close_sum"), total("outer").alias("outer_sum"))
    )


def offset_profile(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """What each stencil offset sees: pixels, neighbours on the grid, their sum."""
    return (
        neighbour_pairs(pixels, params)
        .groupBy("kind", "layer_offset", "dx", "dy")
        .agg(
            F.count(F.lit(1)).alias("pixels"),
            F.count("n_temp").alias("on_grid"),
            F.coalesce(F.sum("n_temp"), F.lit(0)).alias("temp_sum"),
        )
    )


def diamond_sums(
    pixels: DataFrame, params: Params = Params(), image: Sequence[str] = FRAME
) -> DataFrame:
    """Add ``d0 .. dn``: sums over ``|dx| + |dy| <= r`` inside the image.

    The grid must be dense. One shuffle brings the pixels of a block and its
    halo together, packed; a task sums one block at a time.
    """
    sums = [f"d{r}" for r in range(params.reach + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells, row, found in _summed(batches, image, params):
            yield _pixel_batch(rows.select(others), row, dict(zip([*PIXEL, *sums], [*cells.T, *found])))

    others = [c for c in pixels.columns if c not in PIXEL]
    schema = _pixel_schema(pixels, others, sums)
    return _of_types(_blocks(pixels, image, others, params).mapInArrow(run, schema), pixels, sums)


def packed_sums(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """The sums of ``diamond_sums``, one row per block: its ``cells`` by place and their ``sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cells, _, found in _summed(batches, FRAME, params):
            packed = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (cells, found)]
            yield pa.RecordBatch.from_arrays(
                [*rows.select([*others, "block_y", "block_x"]).slice(0, 1).columns, *packed],
                names=[*others, "block_y", "block_x", "cells", "sums"],
            )

    others = [c for c in pixels.columns if c not in PIXEL]
    blocks = _blocks(pixels, FRAME, others, params)
    packed = [T.StructField(c, T.BinaryType()) for c in ("cells", "sums")]
    schema = T.StructType([*(blocks.schema[c] for c in (*others, "block_y", "block_x")), *packed])
    return blocks.mapInArrow(run, schema)


def neighbour_sums(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """``close_sum`` and ``outer_sum`` of every pixel, from diamond sums.

    Each layer is summed once; the windows that hold it share its sums. They
    stay packed until the layers are combined. Columns besides the pixel's own
    belong to the image.
    """
    others = [c for c in pixels.columns if c not in PIXEL]
    layers = layer_window(packed_sums(pixels, params), ["cells", "sums"], params, within=("block_y", "block_x"))
    schema = _pixel_schema(pixels, others, TOTALS)
    return _of_types(
        layers.mapInArrow(lambda batches: _combined(batches, others, params), schema), pixels, TOTALS
    )


def with_means(sums: DataFrame, params: Params = Params()) -> DataFrame:
    """Means over the fixed cell counts, and the deviation between them."""
    close = F.col("close_sum") / params.close_cells
    outer = F.col("outer_sum") / params.outer_cells
    return sums.select(
        "*",
        close.alias("close_mean"),
        outer.alias("outer_mean"),
        F.abs(close - outer).alias("deviation"),
    )


def neighbour_means(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    return with_means(neighbour_sums(pixels, params), params)


def outlier_rows(pixels: DataFrame, params: Params = Params()) -> DataFrame:
    """Flagged pixels of a pixel table.

    The candidate filter follows the sums: neighbours are not masked.
    """
    means = neighbour_means(pixels, params).filter(
        has_full_window(params) & is_candidate(F.col("temp"), params)
    )
    flagged = is_outlier(F.col("close_mean"), F.col("outer_mean"), params)
    return means.filter(flagged).select(
        *FRAME, "x", "y", "close_mean", "outer_mean", "deviation"
    )


def _list_batches(
    batches: Iterator[pa.RecordBatch], group: Sequence[str], kept: Sequence[str], params: Params
) -> Iterator[pa.RecordBatch]:
    """Neighbours of the chosen cells of each block, layer by layer."""
    reach, keys = params.reach, len(params.key_cols)
    side = params.band_rows + 2 * reach
    steps = [np.array([dy * side + dx for b, dx, dy in _offsets(params) if b == n]) for n in range(params.window_size)]
    held: list[tuple[tuple, int, Places, np.ndarray]] = []
    for key, rows, cells, row in runs(batches, [*group, "seq"], 4):
        block, seq = key[:-1], key[-1]
        box = (block[-1] * params.band_rows - reach, block[-2] * params.band_rows - reach, side)
        known = (cells[:, 0] != NULL) & (cells[:, 1] != NULL)
        # A null key equals no key, and a pixel without a place is next to none.
        seen = cells[known] if None not in block[:keys] else cells[:0]
        places = Places(seen[:, 0], seen[:, 1], box)
        held = [h for h in held if h[0] == block and h[1] >= seq - params.history]
        held.append((block, seq, places, seen[places.order, 2]))
        by_back = {seq - at: (found, temps) for _, at, found, temps in held}
        chosen = np.flatnonzero(cells[:, 3] == 1)
        for start in range(0, len(chosen), LISTED):
            here = chosen[start : start + LISTED]
            x, y = cells[here, 0].astype(np.int64), cells[here, 1].astype(np.int64)
            placed = known[here][:, None]
            place = np.where(placed, ((y - box[1]) * side + (x - box[0]))[:, None], 0)
            counts, firsts, temps, base = [], [], [np.empty(0, CELL)], 0
            for back, step in enumerate(steps):
                found, values = by_back.get(back, (NOWHERE, np.empty(0, CELL)))
                at = np.where(placed & found.any, place + step, 0)
                counts.append(np.where(placed & found.any, found.count[at], 0))
                firsts.append(found.first[at] + base)
                temps.append(values)
                base += len(values)
            near = _near(np.hstack(counts), np.hstack(firsts), np.concatenate(temps))
            own = [pa.array(c, pa.int32(), mask=c == NULL) for c in (cells[here, 0], cells[here, 1])]
            yield pa.RecordBatch.from_arrays(
                [*rows.select(kept).take(pa.array(row[here])).columns, *own, near], names=[*kept, "x", "y", "near"]
            )


def _near(count: np.ndarray, first: np.ndarray, temps: np.ndarray) -> pa.Array:
    """Lists of (slot, n_temp) from the places of each slot's neighbours; without any, a null."""
    times = np.maximum(count, 1)
    sizes, times = times.sum(axis=1), times.ravel()
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    slot = np.repeat(np.tile(np.arange(count.shape[1], dtype=np.int32), len(count)), times)
    there = np.repeat(count.ravel() > 0, times)
    values = np.full(len(slot), NULL, np.int64)
    values[there] = temps[(np.repeat(first.ravel(), times) + turn)[there]]
    pairs = pa.StructArray.from_arrays([pa.array(slot), pa.array(values, mask=values == NULL)], names=["slot", "n_temp"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pairs)


def _blocks(pixels: DataFrame, image: Sequence[str], others: Sequence[str], params: Params) -> DataFrame:
    """Packed pixels of each block of an image with its halo, in sorted partitions."""
    group = [*image, "block_y", "block_x"]
    dealt = with_blocks(pixels, params.band_rows, params.reach)
    packed = packed_cells(dealt, [*others, "block_y", "block_x"], [*PIXEL, "own"])
    return packed.repartition(*group).sortWithinPartitions(*group)


def _pixel_schema(pixels: DataFrame, others: Sequence[str], sums: Sequence[str]) -> T.StructType:
    return T.StructType(
        [pixels.schema[c] for c in others]
        + [T.StructField(c, T.IntegerType()) for c in PIXEL]
        + [T.StructField(c, T.LongType()) for c in sums]
    )


def _of_types(rows: DataFrame, pixels: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Columns in the order and of the types of ``pixels``, and the sums."""
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in pixels.schema), *sums)


def _pixel_batch(rows: pa.RecordBatch, row: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Pixel rows, each with the columns of its row among ``rows``."""
    own = [
        pa.array(c, pa.int32(), mask=c == NULL) if n in PIXEL else pa.array(c, pa.int64()) for n, c in columns.items()
    ]
    return pa.RecordBatch.from_arrays([*rows.take(pa.array(row)).columns, *own], names=[*rows.schema.names, *columns])


def _summed(
    batches: Iterator[pa.RecordBatch], image: Sequence[str], params: Params
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block its rows, its own cells by place, the row of each, and their sums (radius x cell)."""
    reach = params.reach
    for _, rows, cells, row in runs(batches, [*image, "block_y", "block_x"], 4):
        if not (cells[:, 3] == 1).any():
            continue
        known = (cells[:, 0] != NULL) & (cells[:, 1] != NULL)
        x, y = (c.astype(np.int64) for c in cells.T[:2])
        left, top = (c[known].min(initial=0 if not known.any() else c[known][0]) for c in (x, y))
        wide, high = (c[known].max(initial=b) - b + 1 for c, b in ((x, left), (y, top)))
        canvas = np.zeros((high + 2 * reach, wide + 2 * reach), np.int64)
        usable = known & (cells[:, 2] != NULL)
        np.add.at(canvas, (y[usable] - top + reach, x[usable] - left + reach), cells[usable, 2])
        order = np.lexsort((x, y))
        order = order[cells[order, 3] == 1]
        found = np.repeat(cells[None, order, 2].astype(np.int64), reach + 1, axis=0)
        placed = known[order]
        at = order[placed]
        found[:, placed] = _diamonds(canvas, params)[:, y[at] - top, x[at] - left]
        yield rows, cells[order, :3], row[order], found


def _diamonds(canvas: np.ndarray, params: Params) -> np.ndarray:
    """Sums over diamonds of each radius inside the margins of the canvas."""
    reach = params.reach
    high, wide = canvas.shape[0] - 2 * reach, canvas.shape[1] - 2 * reach
    before = np.pad(np.cumsum(canvas, axis=1), ((0, 0), (1, 0)))
    row_runs = [before[:, reach + k + 1 :][:, :wide] - before[:, reach - k :][:, :wide] for k in range(reach + 1)]
    out = np.zeros((reach + 1, high, wide), np.int64)
    for radius in range(reach + 1):
        for dy in range(-radius, radius + 1):
            out[radius] += row_runs[radius - abs(dy)][reach + dy : reach + dy + high]
    return out


def _combined(batches: Iterator[pa.RecordBatch], others: Sequence[str], params: Params) -> Iterator[pa.RecordBatch]:
    """Close and outer sums of the cells of each block from the sums of its layers."""
    radii = params.reach + 1

    def unpacked(cells: pa.Array, sums: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.frombuffer(cells[i].as_buffer(), CELL).reshape(-1, len(PIXEL)),
            np.frombuffer(sums[i].as_buffer(), np.int64).reshape(radii, -1),
        )

    for batch in batches:
        rows = batch.select(list(others))
        held = [(None, batch.column("cells"), batch.column("sums"))]
        for back in range(1, params.window_size):
            layer = batch.column(f"earlier_{back}")
            held.append((layer, layer.field("cells"), layer.field("sums")))
        for i in range(batch.num_rows):
            cells = unpacked(*held[0][1:], i)[0]
            close, outer = np.zeros((2, len(cells)), np.int64)
            for back, close_radius, outer_radius in params.stencil_radii():
                layer, *packed = held[back]
                if layer is not None and not layer[i].is_valid:
                    continue
                there, sums = unpacked(*packed, i)
                mine, at = _same_places(cells, there)
                inner = sums[close_radius, at] if close_radius >= 0 else 0
                close[mine] += inner
                outer[mine] += sums[outer_radius, at] - inner
            yield _pixel_batch(
                rows.slice(i, 1), np.zeros(len(cells), np.int64), {**dict(zip(PIXEL, cells.T)), "close_sum": close, "outer_sum": outer}
            )


def _same_places(mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray | slice]:
    """Which cells have a cell of the other layer at their place, and which one; both go by place."""
    if np.array_equal(mine[:, :2], other[:, :2]):
        return slice(None), slice(None)
    own, there = (c[:, 1].astype(np.int64) << 32 | c[:, 0].astype(np.int64) & 0xFFFFFFFF for c in (mine, other))
    _, a, b = np.intersect1d(own, there, return_indices=True)
    return a, b
