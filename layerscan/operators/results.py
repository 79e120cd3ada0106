"""One result row per tile image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.operators.neighbours import POINT_SET
from layerscan.schema import CENTROID, RESULTS


def named_print() -> Column:
    """A print's name that is never null, so that joins on it lose nothing."""
    return F.coalesce(F.concat(F.lit("="), "print_id"), F.lit(""))


def print_of_name() -> Column:
    return F.when(F.col("print_id") != "", F.substring("print_id", 2, 1 << 30))


def nest_centroids(clusters: DataFrame, by: Sequence[str] = POINT_SET) -> DataFrame:
    """Ranked clusters (at most ``top_k`` rows per image) as one array."""
    entry = F.struct("rank", "x", "y", "count")
    ranked = F.array_sort(F.collect_list(entry))
    plain = F.transform(ranked, lambda c: F.struct(c["x"], c["y"], c["count"]).cast(CENTROID))
    return clusters.groupBy(*by).agg(plain.alias("centroids"))


def assemble_results(
    counts: DataFrame, clusters: DataFrame, by: Sequence[str] = POINT_SET
) -> DataFrame:
    """Every frame with its count and centroids, an empty list if it has none."""
    nested = nest_centroids(clusters, by)
    none = F.array().cast(RESULTS["centroids"].dataType)
    return counts.join(nested, list(by), "left").select(
        "batch_id",
        F.lit(0).alias("query"),
        "print_id",
        "tile_id",
        "layer",
        "saturated",
        F.coalesce("centroids", none).alias("centroids"),
    )


def flatten_results(results: DataFrame) -> DataFrame:
    """One row per centroid; images without any keep one row with nulls."""
    kept = [c for c in results.columns if c != "centroids"]
    return results.select(*kept, F.posexplode_outer("centroids").alias("pos", "c")).select(
        *kept,
        (F.col("pos") + 1).alias("rank"),
        F.col("c.x").alias("x"),
        F.col("c.y").alias("y"),
        F.col("c.count").alias("count"),
    )
