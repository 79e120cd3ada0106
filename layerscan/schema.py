"""Fixed schemas of the tables that flow through the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# One raw record: one tile image of one layer of one print.
MESSAGES = T.StructType(
    [
        T.StructField("batch_id", T.IntegerType()),
        T.StructField("print_id", T.StringType()),
        T.StructField("tile_id", T.IntegerType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("tif", T.BinaryType()),
    ]
)

# A decoded image. ``temps`` holds width * height little-endian unsigned
# 16-bit samples in row-major order, two bytes per pixel: half the shuffle
# volume of ARRAY<INT>, and sliceable with ``substring``.
FRAME_SCHEMA = T.StructType(
    [
        T.StructField("print_id", T.StringType()),
        T.StructField("tile_id", T.IntegerType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("batch_id", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("temps", T.BinaryType()),
    ]
)

CENTROID = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("count", T.IntegerType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("batch_id", T.IntegerType()),
        T.StructField("query", T.IntegerType()),
        T.StructField("print_id", T.StringType()),
        T.StructField("tile_id", T.IntegerType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("saturated", T.IntegerType()),
        T.StructField("centroids", T.ArrayType(CENTROID)),
    ]
)

# Columns that identify one image, in the raw tables ...
IMAGE = ("print_id", "tile_id", "layer", "batch_id")
# ... and once it has its place in its key's arrival order.
FRAME = IMAGE + ("seq",)
