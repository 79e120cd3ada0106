"""The complete analysis over stored tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.operators.bands import frame_counts, scan_layers
from layerscan.operators.clusters import cluster_centroids, largest_clusters, swap_axes
from layerscan.operators.dbscan import dbscan
from layerscan.operators.layers import arrival_seq
from layerscan.operators.records import mark_rejects, split_valid
from layerscan.operators.results import assemble_results, named_print, print_of_name
from layerscan.params import Params
from layerscan.session import materialize
from layerscan.sources.messages import decoded_messages


def point_set(params: Params) -> list[str]:
    """Columns that identify an image: its key and its place in arrival order."""
    return [*params.key_cols, "seq"]


def analyze(tiles: DataFrame, params: Params = Params()) -> DataFrame:
    """Results of raw messages or of packed frames, one row per tile image."""
    return analyze_counted(tiles, params)[0]


def analyze_counted(
    tiles: DataFrame, params: Params = Params()
) -> tuple[DataFrame, DataFrame]:
    """Results, and the number of records by ``reject_reason`` (null: used).

    Images shuffle twice, packed: once to number them in arrival order and
    once to bring the layers of a band together. Beyond that point only
    counts and flagged pixels travel.
    """
    marked = marked_frames(tiles)
    frames = arrival_seq(split_valid(marked)[0], params)
    scanned = scan_layers(frames, params)
    rejects = marked.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("records"))
    return results_of(materialize(scanned, "scanned"), params), rejects


def marked_frames(tiles: DataFrame) -> DataFrame:
    """Packed frames with ``reject_reason``; the payloads of messages are read once.

    Decoded messages are stored, so numbering counts them without their images.
    """
    if "tif" in tiles.columns:
        return materialize(decoded_messages(tiles), "decoded")
    return mark_rejects(tiles, "temps")


def results_of(scanned: DataFrame, params: Params = Params()) -> DataFrame:
    """Results from scanned bands, which are stored or kept by the caller."""
    by = point_set(params)
    scanned = scanned.withColumn("print_id", named_print())
    clusters = ranked_clusters(scanned.select(*by, F.inline("flagged")), params)
    results = assemble_results(frame_counts(scanned), clusters, by)
    return results.withColumn("print_id", print_of_name())


def ranked_clusters(points: DataFrame, params: Params = Params()) -> DataFrame:
    """The largest clusters of flagged pixels, in result axes."""
    by = point_set(params)
    labels = dbscan(points.select(*by, "x", "y"), params, by)
    return swap_axes(largest_clusters(cluster_centroids(labels, by), params, by))


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store results as Parquet."""
    results.write.mode(mode).parquet(path)
