"""Cluster summaries: centroid, size, the largest ones per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerscan.operators.neighbours import POINT_SET
from layerscan.params import Params


def cluster_centroids(labels: DataFrame, by: Sequence[str] = POINT_SET) -> DataFrame:
    """Mean column and row of each cluster and its number of points."""
    size = F.count(F.lit(1))
    return labels.groupBy(*by, "cluster_id").agg(
        (F.sum("x") / size).alias("cx"),
        (F.sum("y") / size).alias("cy"),
        size.cast("int").alias("count"),
    )


def largest_clusters(
    centroids: DataFrame, params: Params = Params(), by: Sequence[str] = POINT_SET
) -> DataFrame:
    """The ``top_k`` largest clusters of each image, with their ``rank``.

    Clusters of one size keep their discovery order, i.e. ascending ids.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "cluster_id")
    return centroids.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= params.top_k
    )


def swap_axes(clusters: DataFrame) -> DataFrame:
    """Results report a centroid's row as x and its column as y."""
    kept = [c for c in clusters.columns if c not in ("cx", "cy")]
    return clusters.select(*kept, F.col("cy").alias("x"), F.col("cx").alias("y"))
