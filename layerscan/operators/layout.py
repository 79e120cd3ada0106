"""Placement of tiles and of parts of tiles on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.params import Params


def tile_partition(n: int, tile: str = "tile_id") -> Column:
    """Partition number of a tile; never negative, also for the end marker's -1."""
    return F.pmod(F.col(tile), F.lit(n)).cast("int")


def place_by_tile(df: DataFrame, n: int, tile: str = "tile_id") -> DataFrame:
    """Tile ``t`` on partition ``t mod n``; for inputs with evenly filled tiles.

    The analysis itself does not rely on it, as one tile may hold most rows.
    """
    placed = df.withColumn("tile_partition", tile_partition(n, tile))
    return placed.repartitionById(n, "tile_partition").drop("tile_partition")


def with_halo(
    pixels: DataFrame, height: int | Column, block_rows: int, params: Params = Params()
) -> DataFrame:
    """Pixel rows replicated to each block of image rows that reads them.

    ``block`` owns ``block_rows`` rows and also reads the ``reach`` rows above
    and below; ``in_core`` tells own pixels from halo copies.
    """

    def block_of(row: Column) -> Column:
        return F.floor(row / block_rows).cast("int")

    y = F.col("y")
    first = block_of(F.greatest(y - params.reach, F.lit(0)))
    last = block_of(F.least(y + params.reach, F.lit(height) - 1))
    return pixels.select("*", F.explode(F.sequence(first, last)).alias("block")).withColumn(
        "in_core", F.col("block") == block_of(y)
    )
