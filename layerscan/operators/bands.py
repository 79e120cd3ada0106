"""Bands: blocks of image rows with a halo, the unit of work on frames.

A frame is cut into bands of rows, each with a copy of the ``reach`` rows
around it, so that one image is worked on by several tasks and a hot tile
spreads over bands and layer chunks. Bands stay packed binary: one shuffle
brings the layers of a band together, and only flagged pixels leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.packed import SAMPLE, slices
from layerscan.operators.layers import layer_chunks, layer_window
from layerscan.operators.stencil import with_means
from layerscan.params import Params
from layerscan.schema import FRAME

def bands_of(params: Params) -> Column:
    """Numbers of the bands that hold rows of an image, as an array.

    The last one may hold halo rows only; it serves a taller neighbour layer.
    """
    last = F.floor((F.col("height") - 1 + params.reach) / params.band_rows)
    return F.sequence(F.lit(0), last.cast("int"))


def band_slice(band: Column, params: Params) -> tuple[Column, Column]:
    """First image row in a band, and the packed rows with their halo.

    Halo rows exist as far as the image goes. All of it is slicing in the JVM.
    """
    first = band * params.band_rows
    top = F.greatest(first - params.reach, F.lit(0))
    end = F.least(first + (params.band_rows + params.reach), F.col("height"))
    row_bytes = F.col("width") * SAMPLE.itemsize
    rows = F.col("temps").substr(top * row_bytes + 1, (end - top) * row_bytes)
    return top, rows


def split_bands(
    frames: DataFrame, params: Params = Params(), image: Sequence[str] = FRAME
) -> DataFrame:
    """Packed frames to packed bands: ``band``, its first row ``top``, its ``rows``."""
    top, rows = band_slice(F.col("band"), params)
    return frames.select(
        *image, "width", "height", F.explode(bands_of(params)).alias("band"), "temps"
    ).select(*image, "width", "height", "band", top.alias("top"), rows.alias("rows"))


def band_windows(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """Own bands of every frame with the same bands of the earlier layers."""
    bands = split_bands(frames, params)
    windows = layer_window(bands, ("width", "top", "rows"), params, within=("band",))
    return windows.filter(F.col("band") * params.band_rows < F.col("height"))


SCANNED = T.ArrayType(
    T.StructType(
        [
            T.StructField("x", T.IntegerType()),
            T.StructField("y", T.IntegerType()),
            T.StructField("close_sum", T.IntegerType()),
            T.StructField("outer_sum", T.IntegerType()),
        ]
    )
)


def scan_bands(windows: DataFrame, params: Params = Params()) -> DataFrame:
    """Per band: ``saturated`` pixels and the ``flagged`` pixels with their sums.

    One row per band comes out, so a frame without any flagged pixel stays.
    """
    earlier = [f"earlier_{n}" for n in range(1, params.history + 1)]
    schema = T.StructType(
        [windows.schema[c] for c in (*FRAME, "band")]
        + [T.StructField("saturated", T.IntegerType()), T.StructField("flagged", SCANNED)]
    )
    ordered = windows.select(*FRAME, "band", "height", "width", "top", "rows", *earlier)
    return ordered.mapInArrow(lambda batches: _scan_batches(batches, params), schema)


def scan_layers(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """``scan_bands`` for stored frames: each band is read and summed once.

    The bands of a key come in order of their layers, so a task keeps the sums
    of the few layers before the newest one and adds them up. Chunks of layers
    bound a group; a chunk repeats the layers that its first ones look back at.
    """
    group = [*params.key_cols, "band", "chunk"]
    own = F.col("chunk") == F.floor((F.col("seq") - 1) / params.chunk_layers)
    chunked = (
        split_bands(frames, params)
        .withColumn("chunk", F.explode(layer_chunks(params)))
        .repartition(*group)
        .sortWithinPartitions(*group, "seq")
        .select(
            *FRAME, "band", own.alias("own"), F.xxhash64(*group).alias("group"), "height", "width", "top", "rows"
        )
    )
    schema = T.StructType(
        [chunked.schema[c] for c in (*FRAME, "band")]
        + [T.StructField("saturated", T.IntegerType()), T.StructField("flagged", SCANNED)]
    )
    return chunked.mapInArrow(lambda batches: _scan_layer_batches(batches, params), schema)


def frame_counts(scanned: DataFrame) -> DataFrame:
    """Saturated pixels of each frame, over its bands."""
    return scanned.groupBy(*FRAME).agg(F.sum("saturated").cast("int").alias("saturated"))


def flagged_pixels(scanned: DataFrame, params: Params = Params()) -> DataFrame:
    """Flagged pixels as rows, with means and deviation."""
    rows = scanned.select(*FRAME, F.inline("flagged"))
    return with_means(rows, params).drop("close_sum", "outer_sum")


def outliers(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """Flagged pixels of packed frames that carry ``seq``."""
    return flagged_pixels(scan_layers(frames, params), params)


def _scan_batches(
    batches: Iterator[pa.RecordBatch], params: Params
) -> Iterator[pa.RecordBatch]:
    """Stack bands of one shape, up to a cache-sized pile, and scan each pile."""
    pile_pixels = 1 << 18
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bands = batch.select(range(len(FRAME), batch.num_columns)).to_pylist()
        seqs = batch.column(FRAME.index("seq")).to_pylist()
        found: list[tuple] = [None] * len(bands)
        piles: dict[tuple[int, int], list[int]] = {}
        for i, band in enumerate(bands):
            first = band["band"] * params.band_rows
            shape = (min(params.band_rows, band["height"] - first), band["width"])
            pile = piles.setdefault(shape, [])
            pile.append(i)
            if len(pile) * shape[0] * shape[1] >= pile_pixels:
                _scan_pile(shape, piles.pop(shape), bands, seqs, found, params)
        for shape, pile in piles.items():
            _scan_pile(shape, pile, bands, seqs, found, params)

        saturated, flagged = zip(*found)
        offsets = np.concatenate(([0], np.cumsum([f.shape[1] for f in flagged])))
        columns = np.concatenate(flagged, axis=1).astype(np.int32)
        cells = pa.StructArray.from_arrays(
            [pa.array(c) for c in columns], names=SCANNED.elementType.names
        )
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(len(FRAME) + 1)),
                pa.array(saturated, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells),
            ],
            names=[*FRAME, "band", "saturated", "flagged"],
        )


def _scan_layer_batches(
    batches: Iterator[pa.RecordBatch], params: Params
) -> Iterator[pa.RecordBatch]:
    """Sum each band once and combine it with the sums of the layers before it."""
    held: list[tuple[int, int, np.ndarray]] = []
    for batch in slices(batches):
        bands = batch.select(range(len(FRAME) - 1, batch.num_columns)).to_pylist()
        kept, saturated, flagged = [], [], [np.empty((4, 0), np.int64)]
        for i, band in enumerate(bands):
            canvas = np.zeros((params.band_rows + 2 * params.reach, band["width"] + 3 * params.reach), np.int32)
            if band["rows"]:
                _place(canvas, band, band["band"] * params.band_rows - params.reach, params.reach)
            # A layer may be narrower than the newest one, whose pixels still see it.
            sums = _diamonds(canvas, params)
            held = [h for h in held if h[0] == band["group"] and h[1] >= band["seq"] - params.history]
            held.append((band["group"], band["seq"], sums))
            first = band["band"] * params.band_rows
            if band["own"] and first < band["height"]:
                hit, count = _flagged_of(canvas, band, held, params)
                kept.append(i)
                saturated.append(count)
                flagged.append(hit)
        if not kept:
            continue
        offsets = np.cumsum([f.shape[1] for f in flagged])
        columns = np.concatenate(flagged, axis=1).astype(np.int32)
        cells = pa.StructArray.from_arrays(
            [pa.array(c) for c in columns], names=SCANNED.elementType.names
        )
        names = [*FRAME, "band"]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.select(names).take(pa.array(kept)).columns,
                pa.array(saturated, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells),
            ],
            names=[*names, "saturated", "flagged"],
        )


def _diamonds(canvas: np.ndarray, params: Params) -> np.ndarray:
    """Sums over diamonds of each radius, for the rows of the band and columns
    up to ``reach`` beyond the image."""
    reach, width = params.reach, canvas.shape[1] - 2 * params.reach
    before = np.pad(np.cumsum(canvas, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
    runs = [
        before[:, reach + k + 1 : reach + k + 1 + width] - before[:, reach - k : reach - k + width]
        for k in range(reach + 1)
    ]
    out = np.zeros((reach + 1, params.band_rows, width), np.int32)
    for radius in range(reach + 1):
        for dy in range(-radius, radius + 1):
            out[radius] += runs[radius - abs(dy)][reach + dy : reach + dy + params.band_rows]
    return out


def _flagged_of(
    canvas: np.ndarray, band: dict, held: list[tuple[int, int, np.ndarray]], params: Params
) -> tuple[np.ndarray, int]:
    """Flagged pixels (4 x n) of the newest layer, and its saturated pixels."""
    first, width, reach = band["band"] * params.band_rows, band["width"], params.reach
    height = min(params.band_rows, band["height"] - first)
    own = canvas[reach : reach + height, reach : reach + width]
    count = int((own > params.saturation_thresh).sum())
    if band["seq"] < params.window_size:
        return np.empty((4, 0), np.int64), count
    close, outer = np.zeros((height, width), np.int32), np.zeros((height, width), np.int32)
    by_seq = {seq: sums for _, seq, sums in held}
    for back, close_radius, outer_radius in params.stencil_radii():
        sums = by_seq.get(band["seq"] - back)
        if sums is None:
            continue
        w = min(width, sums.shape[2])
        outer[:, :w] += sums[outer_radius, :height, :w]
        if close_radius >= 0:
            close[:, :w] += sums[close_radius, :height, :w]
            outer[:, :w] -= sums[close_radius, :height, :w]
    hit = np.abs(close / params.close_cells - outer / params.outer_cells) > params.outlier_thresh
    hit &= (own > params.empty_thresh) & (own < params.saturation_thresh)
    y, x = np.nonzero(hit)
    return np.stack((x, y + first, close[y, x], outer[y, x])), count


def _scan_pile(
    shape: tuple[int, int],
    pile: list[int],
    bands: list[dict],
    seqs: list[int],
    found: list,
    params: Params,
) -> None:
    """Fill ``found`` with (saturated, 4 x n array of flagged pixels) per band."""
    height, width = shape
    reach, depth = params.reach, params.window_size
    layers = np.zeros((depth, len(pile), height + 2 * reach, width + 2 * reach), np.int32)
    for k, i in enumerate(pile):
        row_0 = bands[i]["band"] * params.band_rows - reach
        pieces = [bands[i]] + [bands[i][f"earlier_{n}"] for n in range(1, depth)]
        for back, piece in enumerate(pieces):
            if piece is not None and piece["rows"]:
                _place(layers[back, k], piece, row_0, reach)

    own = layers[0, :, reach : reach + height, reach : reach + width]
    saturated = (own > params.saturation_thresh).sum(axis=(1, 2))
    close, outer = _stencil_sums(layers, height, width, params)
    hit = np.abs(close / params.close_cells - outer / params.outer_cells) > params.outlier_thresh
    hit &= (own > params.empty_thresh) & (own < params.saturation_thresh)
    hit &= np.array([seqs[i] >= depth for i in pile])[:, None, None]
    for k, i in enumerate(pile):
        y, x = np.nonzero(hit[k])
        first = bands[i]["band"] * params.band_rows
        found[i] = (
            int(saturated[k]),
            np.stack((x, y + first, close[k, y, x], outer[k, y, x])),
        )


def _place(canvas: np.ndarray, piece: dict, row_0: int, reach: int) -> None:
    """Copy a layer's rows to the canvas, whose first row is image row ``row_0``.

    Rows and columns beyond the canvas are out of every stencil's reach.
    """
    rows = np.frombuffer(piece["rows"], SAMPLE).reshape(-1, piece["width"])
    y = piece["top"] - row_0
    rows = rows[: canvas.shape[0] - y, : canvas.shape[1] - reach]
    canvas[y : y + rows.shape[0], reach : reach + rows.shape[1]] = rows


def _stencil_sums(
    layers: np.ndarray, height: int, width: int, params: Params
) -> tuple[np.ndarray, np.ndarray]:
    """Close and outer sums; ``layers`` is (layers back, band, y, x) with margins."""
    reach = params.reach
    close = np.zeros((layers.shape[1], height, width), np.int32)
    outer = np.zeros_like(close)
    for back, close_radius, outer_radius in params.stencil_radii():
        before = np.cumsum(layers[back], axis=-1, dtype=np.int32)
        before = np.pad(before, ((0, 0), (0, 0), (1, 0)))
        # runs[k] sums the 2k+1 pixels of a row around each column.
        runs = [
            before[..., reach + k + 1 : reach + k + 1 + width]
            - before[..., reach - k : reach - k + width]
            for k in range(outer_radius + 1)
        ]
        for dy in range(-outer_radius, outer_radius + 1):
            rows = slice(reach + dy, reach + dy + height)
            outer += runs[outer_radius - abs(dy)][:, rows]
            if abs(dy) <= close_radius:
                inner = runs[close_radius - abs(dy)][:, rows]
                close += inner
                outer -= inner
    return close, outer
