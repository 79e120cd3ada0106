"""Registered queries: every operator over whole tables.

Each takes a session and the folder of the tables. Images come from
``order_frames`` (lineitem) or ``vector_frames`` (embeddings), so the work
grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerscan.operators.bands import frame_counts, outliers, scan_layers
from layerscan.operators.clusters import cluster_centroids, largest_clusters, swap_axes
from layerscan.operators.dbscan import dbscan
from layerscan.operators.layers import arrival_seq, has_full_window, layer_window
from layerscan.operators.layout import place_by_tile, tile_partition, with_halo
from layerscan.operators.neighbours import POINT_SET, eps_join, mark_core
from layerscan.operators.pixels import (
    candidate_pixels,
    densify,
    pixel_rows,
    saturated_count,
)
from layerscan.operators.records import mark_rejects, split_valid
from layerscan.operators.results import flatten_results
from layerscan.operators.stencil import (
    diamond_sums,
    neighbour_join,
    neighbour_means,
    offset_profile,
    outlier_rows,
)
from layerscan.params import Params
from layerscan.plans.analyze import analyze, analyze_counted, write_results
from layerscan.session import fresh_path, materialize
from layerscan.sources.log import append_log, stream_log
from layerscan.sources.messages import (
    check_messages,
    decode_frames,
    encode_frames,
    read_messages,
    stream_messages,
    typed_messages,
)
from layerscan.sources.rasters import (
    SIDE,
    order_frames,
    order_raster,
    sequenced,
    table,
    vector_frames,
)
from layerscan.streaming.analysis import (
    analyze_stream,
    read_results,
    start_stateful,
    with_layer_watermark,
)
from layerscan.streaming.closing import closed_layers
from layerscan.streaming.sink import commit, read_table
from layerscan.streaming.window import SIDE as LATE_APART

Query = Callable[[SparkSession, str], DataFrame]

# Small images need a small radius to show more than one cluster.
FINE = Params(dbscan_eps=2.0)
POINT = (*POINT_SET, "x", "y")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced(order_frames(spark, sf_dir))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(_frames(spark, sf_dir))


def _order_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(_frames(spark, sf_dir)).select(*POINT)


def _vector_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(sequenced(vector_frames(spark, sf_dir))).select(*POINT)


def _append_of(batches: int) -> Column:
    """Which of three appends a message comes with: cut by arrival number."""
    return F.floor(F.col("batch_id") * 3 / batches).cast("int")


def _damaged(messages: DataFrame) -> DataFrame:
    """Messages of which some have no payload, a bad one, no tile, or no print."""
    turn = F.col("batch_id") % 9
    return messages.select(
        "batch_id",
        F.when(turn == 5, None).otherwise(F.col("print_id")).alias("print_id"),
        F.when(turn == 3, None).when(turn == 4, -1).otherwise(F.col("tile_id")).alias("tile_id"),
        "layer",
        F.when(turn == 1, None).when(turn == 2, F.substring("tif", 1, 200)).otherwise(F.col("tif")).alias("tif"),
    )


def _vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(_vector_outliers(spark, sf_dir), FINE)


# Sources and records.


def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(order_raster(spark, sf_dir), SIDE, SIDE)


def decoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as TIFF messages, through the payload check and the decoder."""
    good, _ = split_valid(check_messages(encode_frames(order_frames(spark, sf_dir))))
    return pixel_rows(decode_frames(good))


def compressed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as compressed messages, each payload decoded in the pass that checks it."""
    return pixel_rows(decode_frames(encode_frames(order_frames(spark, sf_dir), deflate=True)))


def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text to typed messages; numbers beyond 32 bits become null."""
    events = table(spark, sf_dir, "events")
    text = F.to_json(
        F.struct(
            (F.col("event_id") * 1000000).alias("batch_id"),
            F.col("event_type").alias("print_id"),
            F.col("user_id").alias("tile_id"),
            F.col("event_id").alias("layer"),
            F.base64(F.col("props")).alias("tif"),
        )
    )
    typed = typed_messages(events.select(text.alias("record")), json="record")
    return typed.withColumn("tif", F.col("tif").cast("string"))


def _marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 50
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(turn == 0, None).when(turn == 1, -1).otherwise(F.col("user_id")).alias("tile_id"),
        F.when(turn == 2, None).otherwise(F.col("props")).alias("payload"),
    )


def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records: the good ones and the rejects with their reason."""
    good, rejects = split_valid(mark_rejects(_marked_events(spark, sf_dir), payload="payload"))
    both = good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects)
    return both.select("event_id", "reject_reason")


# Layer windows.


def arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("print_id", "tile_id", "layer", "batch_id", "seq")


def layer_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir).select("print_id", "tile_id", "layer", "batch_id", "seq")
    return layer_window(frames, ["layer", "batch_id"]).select(
        *frames.columns,
        F.col("earlier_1.batch_id").alias("batch_1"),
        F.col("earlier_2.batch_id").alias("batch_2"),
        has_full_window().alias("is_full"),
    )


def event_window3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user, by time."""
    return _last_three(table(spark, sf_dir, "events"))


def keyless_window3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with events that lack their user or time: none is lost."""
    return _last_three(
        table(spark, sf_dir, "events")
        .withColumn("user_id", F.when(F.col("event_id") % 13 > 0, F.col("user_id")))
        .withColumn("ts", F.when(F.col("event_id") % 17 > 0, F.col("ts")))
    )


def _last_three(events: DataFrame) -> DataFrame:
    by_user = Params(key_cols=("user_id",))
    events = events.select("event_id", "ts", "user_id", "value")
    numbered = arrival_seq(
        events,
        by_user,
        order_cols=("ts", "event_id"),
        bucket=F.unix_date(F.to_date("ts")) * 1440 + F.hour("ts") * 60 + F.minute("ts"),
    )
    return layer_window(numbered, ["event_id", "value"], by_user).select(
        "event_id",
        "user_id",
        "seq",
        "value",
        F.col("earlier_1.event_id").alias("event_1"),
        F.col("earlier_1.value").alias("value_1"),
        F.col("earlier_2.event_id").alias("event_2"),
        F.col("earlier_2.value").alias("value_2"),
    )


def watermark_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time of each record: its layer in milliseconds."""
    records = order_frames(spark, sf_dir).select("print_id", "tile_id", "layer", "batch_id")
    timed = with_layer_watermark(records)
    return timed.select(*records.columns, F.unix_millis("event_time").alias("event_ms"))


# Pixels and neighbourhoods.


def saturated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saturated_count(_pixels(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_pixels(_pixels(spark, sf_dir)).filter(has_full_window())


def offset_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stencil's offsets with what they see over all pixels."""
    return offset_profile(_pixels(spark, sf_dir))


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diamond_sums(_pixels(spark, sf_dir))


def neighbour_sums_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_join(_pixels(spark, sf_dir))


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_means(_pixels(spark, sf_dir)).filter(has_full_window())


def outlier_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(_frames(spark, sf_dir))


def outlier_pixels_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_rows(_pixels(spark, sf_dir))


def outlier_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from bands of eight rows."""
    return outliers(_frames(spark, sf_dir), Params(band_rows=8))


def outliers_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(sequenced(vector_frames(spark, sf_dir)))


def frame_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturated pixels counted in the same pass that finds outliers."""
    return frame_counts(scan_layers(_frames(spark, sf_dir)))


# Clustering.


def eps_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eps_join(materialize(_order_outliers(spark, sf_dir), "points"), 2.0)


def eps_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each flagged pixel that has any: their number and the first one."""
    pairs = eps_join(materialize(_order_outliers(spark, sf_dir), "points"), 2.0)
    first = F.min(F.struct("near_y", "near_x"))
    return pairs.groupBy(*POINT).agg(F.count(F.lit(1)).alias("neighbours"), first.alias("first")).select(
        *POINT, "neighbours", F.col("first.near_x").alias("first_x"), F.col("first.near_y").alias("first_y")
    )


def core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_core(_vector_outliers(spark, sf_dir), FINE.dbscan_eps, FINE.dbscan_min_pts)
    return marked.select(*POINT, "is_core")


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_labels(spark, sf_dir)


def dbscan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with blocks so small that clusters cross them."""
    return dbscan(_vector_outliers(spark, sf_dir), Params(dbscan_eps=2.0, block_cells=2))


def dbscan_labels_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(_order_outliers(spark, sf_dir))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_centroids(_vector_labels(spark, sf_dir))


def top10_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_axes(largest_clusters(cluster_centroids(_vector_labels(spark, sf_dir)), FINE))


# Results.


def tile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image; its centroids as JSON text."""
    results = analyze(order_frames(spark, sf_dir))
    return results.withColumn("centroids", F.to_json("centroids"))


def shared_tile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prints on a tile share one window."""
    shared = Params(dbscan_eps=2.0, key_cols=("tile_id",))
    return flatten_results(analyze(order_frames(spark, sf_dir), shared))


def tile_results_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_results(analyze(order_frames(spark, sf_dir), FINE))


def tile_results_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_results(analyze(vector_frames(spark, sf_dir), FINE))


def default_eps_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_results(analyze(order_frames(spark, sf_dir)))


def message_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored TIFF messages to stored results."""
    path = fresh_path(spark, "messages")
    encode_frames(order_frames(spark, sf_dir)).write.parquet(path)
    out = fresh_path(spark, "results")
    write_results(analyze(read_messages(spark, path), FINE), out)
    return flatten_results(spark.read.parquet(out))


def damaged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of messages of which some cannot be used and some have no print."""
    return flatten_results(analyze(_damaged(encode_frames(order_frames(spark, sf_dir))), FINE))


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the same messages by reject reason, counted by the analysis."""
    return analyze_counted(_damaged(encode_frames(order_frames(spark, sf_dir))), FINE)[1]


def _appended(spark: SparkSession, messages: DataFrame, append: Column, start) -> None:
    """Three appends; after each, ``start`` gives a stream that goes on from its last state."""
    path, state = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-checkpoint")
    messages = materialize(messages.withColumn("append", append), "stream-messages")
    for turn in range(3):
        messages.filter(F.col("append") == turn).drop("append").write.mode("append").parquet(path)
        start(stream_messages(spark, path, files_per_trigger=1 << 20), state).awaitTermination()


def _streamed(spark: SparkSession, messages: DataFrame, append: Column, **options) -> str:
    """Folder of the tables of an analysis of three appends."""
    out = fresh_path(spark, "stream-out")
    _appended(spark, messages, append, lambda source, state: analyze_stream(source, out, state, FINE, **options))
    return out


def _with_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Messages, and the number that all arrival numbers are below."""
    messages = materialize(encode_frames(order_frames(spark, sf_dir)), "messages")
    return messages, messages.agg(F.max("batch_id")).first()[0] + 1


def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as a stream in three appends that cut prints in two."""
    messages, batches = _with_batches(spark, sf_dir)
    return flatten_results(read_results(spark, _streamed(spark, messages, _append_of(batches))))


def stream_late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with records that come an append late: each counts on arrival."""
    messages, batches = _with_batches(spark, sf_dir)
    return flatten_results(read_results(spark, _streamed(spark, messages, _late_append_of(batches))))


def log_stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages pulled from a log by record number, in two runs that stop amid a segment."""
    path, out, state = (fresh_path(spark, f"log-{x}") for x in ("in", "out", "checkpoint"))
    messages = encode_frames(order_frames(spark, sf_dir)).repartitionByRange(3, "batch_id")
    total = append_log(messages.sortWithinPartitions("batch_id"), path, end=True)
    for limit in (total // 2, 0):
        analyze_stream(stream_log(spark, path, limit), out, state, FINE).awaitTermination()
    return flatten_results(read_results(spark, out))


def _late_append_of(batches: int) -> Column:
    late = (F.col("batch_id") % 11 == 3).cast("int")
    return F.least(_append_of(batches) + late, F.lit(2))


def stream_late_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with late records kept apart: results, and the late records' rows without any."""
    messages, batches = _with_batches(spark, sf_dir)
    out = _streamed(spark, messages, _late_append_of(batches), late=LATE_APART, lateness=0)
    late = read_results(spark, out, "late").withColumn("is_late", F.lit(True))
    results = flatten_results(read_results(spark, out)).withColumn("is_late", F.lit(False))
    return results.unionByName(late, allowMissingColumns=True)


def stream_tied_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with two layers of a tile under one layer and arrival number: images go by digest."""
    messages, batches = _with_batches(spark, sf_dir)
    layer = F.col("layer") - F.col("layer") % 2
    tied = messages.withColumn("batch_id", F.col("batch_id") - 4 * (F.col("layer") % 2)).withColumn("layer", layer)
    return flatten_results(read_results(spark, _streamed(spark, tied, _append_of(batches))))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of damaged messages by reject reason, counted by the stream that analyses them."""
    messages, batches = _with_batches(spark, sf_dir)
    out = _streamed(spark, _damaged(messages), _append_of(batches))
    return read_results(spark, out, "counts").groupBy("reject_reason").agg(F.sum("records").alias("records"))


def stream_closed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that the watermark, two layers behind, has closed: tiles seen, saturated pixels."""
    messages = materialize(encode_frames(vector_frames(spark, sf_dir)), "messages")
    batches, out = messages.agg(F.max("batch_id")).first()[0] + 1, fresh_path(spark, "stream-out")

    def start(source: DataFrame, state: str):
        timed = with_layer_watermark(source, lateness="2 milliseconds", first_ms=1000)
        closed = closed_layers(decode_frames(timed))
        return start_stateful(closed, lambda rows, n: commit(spark, out, n, {"closed": rows}), state, True)

    _appended(spark, messages, _append_of(batches), start)
    return read_table(spark, out, "closed")


# Placement.


def tile_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition of each record under modulo placement, end markers included."""
    return _marked_events(spark, sf_dir).select(
        "event_id", tile_partition(16).alias("tile_partition")
    )


def placed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where modulo placement actually puts each frame."""
    records = order_frames(spark, sf_dir).select("print_id", "tile_id", "layer", "batch_id")
    return place_by_tile(records, 16).withColumn("tile_partition", F.spark_partition_id())


def halo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_halo(_pixels(spark, sf_dir), SIDE, 8)


QUERIES: dict[str, Query] = {
    "pixel_grid": pixel_grid,
    "decoded_messages": decoded_messages,
    "compressed_messages": compressed_messages,
    "typed_records": typed_records,
    "reject_split": reject_split,
    "arrival_seq": arrival_order,
    "layer_window": layer_window_rows,
    "event_window3": event_window3,
    "keyless_window3": keyless_window3,
    "watermark_layers": watermark_layers,
    "saturated_count": saturated_pixels,
    "candidate_pixels": candidates,
    "stencil_offsets": offset_sums,
    "neighbour_sums_plain": neighbour_sums_plain,
    "diamond_sums": diamonds,
    "neighbour_means": means,
    "outlier_pixels": outlier_pixels,
    "outlier_pixels_rows": outlier_pixels_rows,
    "outlier_bands": outlier_bands,
    "outliers_embeddings": outliers_embeddings,
    "frame_saturation": frame_saturation,
    "eps_pairs": eps_pairs,
    "eps_neighbours": eps_neighbours,
    "core_points": core_points,
    "dbscan_labels": dbscan_labels,
    "dbscan_blocks": dbscan_blocks,
    "dbscan_labels_default": dbscan_labels_default,
    "cluster_centroids": centroids,
    "top10_clusters": top10_clusters,
    "tile_results": tile_results,
    "shared_tile_results": shared_tile_results,
    "tile_results_flat": tile_results_flat,
    "tile_results_embeddings": tile_results_embeddings,
    "default_eps_results": default_eps_results,
    "message_results": message_results,
    "damaged_results": damaged_results,
    "reject_counts": reject_counts,
    "stream_results": stream_results,
    "log_stream_results": log_stream_results,
    "stream_late_results": stream_late_results,
    "stream_late_side": stream_late_side,
    "stream_tied_results": stream_tied_results,
    "stream_counts": stream_counts,
    "stream_closed_layers": stream_closed_layers,
    "tile_partition": tile_placement,
    "placed_tiles": placed_tiles,
    "halo_blocks": halo_blocks,
}
