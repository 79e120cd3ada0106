"""Images derived from relational tables, for queries over tabular data.

``order_raster`` draws lineitem: a block of orders is a print, the supplier
picks the tile, the year the layer, and the part and order keys the pixel.
``vector_mosaic`` draws embeddings: sixteen vectors make one image. Both
cover their whole table, and the number of images grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerscan.operators.layers import arrival_seq
from layerscan.operators.pixels import frames_from_pixels
from layerscan.params import Params

SIDE = 32
TILES = 4
LAYERS = 7
ORDERS_PER_PRINT = 3750


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pixel rows of lineitem."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.expr(f"l_orderkey div {ORDERS_PER_PRINT}").alias("print_no"),
        (F.col("l_suppkey") % TILES).cast("int").alias("tile_id"),
        (F.year("l_shipdate") - 1995).alias("layer"),
        (F.col("l_partkey") % SIDE).cast("int").alias("x"),
        (F.col("l_orderkey") % SIDE).cast("int").alias("y"),
        F.floor("l_extendedprice").alias("price"),
    )
    return (
        cells.groupBy("print_no", "tile_id", "layer", "x", "y")
        .agg((F.sum("price") % 65536).cast("int").alias("temp"))
        .select(
            F.concat(F.lit("P"), F.col("print_no")).alias("print_id"),
            "tile_id",
            "layer",
            (F.col("print_no") * (LAYERS * TILES) + F.col("layer") * TILES + F.col("tile_id"))
            .cast("int")
            .alias("batch_id"),
            "x",
            "y",
            "temp",
        )
    )


def vector_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pixel rows of embeddings; the last image may be part empty."""
    cells = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("i", "value")
    )
    level = F.floor(F.lit(32768) + F.col("value").cast("double") * 100000)
    return cells.select(
        F.lit("P0").alias("print_id"),
        (F.expr("vec_id div 16") % TILES).cast("int").alias("tile_id"),
        F.expr(f"vec_id div {16 * TILES}").cast("int").alias("layer"),
        F.expr("vec_id div 16").cast("int").alias("batch_id"),
        ((F.col("vec_id") % 4) * 8 + F.col("i") % 8).cast("int").alias("x"),
        ((F.expr("vec_id div 4") % 4) * 8 + F.expr("i div 8")).cast("int").alias("y"),
        F.greatest(F.lit(0), F.least(F.lit(65535), level)).cast("int").alias("temp"),
    )


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_pixels(order_raster(spark, sf_dir), SIDE, SIDE)


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_pixels(vector_mosaic(spark, sf_dir), SIDE, SIDE)


def generated_frames(
    spark: SparkSession, layers: int, tiles: int, width: int, height: int
) -> DataFrame:
    """Frames of any size for benches, from row numbers by integer arithmetic:
    a mild pattern with hot blocks that wander from layer to layer."""
    pixel = spark.range(layers * tiles * width * height).select(
        F.expr(f"cast(id div {tiles * width * height} as int)").alias("layer"),
        F.expr(f"cast((id div {width * height}) % {tiles} as int)").alias("tile_id"),
        F.expr(f"cast((id div {width}) % {height} as int)").alias("y"),
        F.expr(f"cast(id % {width} as int)").alias("x"),
    )
    hot = (F.expr("(x div 12 + 3 * layer) % 9") == 0) & (
        F.expr("(y div 12 + 5 * tile_id) % 7") == 0
    )
    pattern = 12000 + (F.col("x") * 37 + F.col("y") * 91 + F.col("layer") * 53) % 4000
    pixels = pixel.select(
        F.lit("G").alias("print_id"),
        "tile_id",
        "layer",
        (F.col("layer") * tiles + F.col("tile_id")).alias("batch_id"),
        "x",
        "y",
        F.when(hot, 60000).otherwise(pattern).alias("temp"),
    )
    return frames_from_pixels(pixels, width, height)


def sequenced(frames: DataFrame, params: Params = Params()) -> DataFrame:
    return arrival_seq(frames, params)
