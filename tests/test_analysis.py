import numpy as np
from brute import collected, frames_df, random_images, results
from test_messages import tiff

from layerscan.operators.bands import band_windows, scan_bands, scan_layers
from layerscan.operators.layers import arrival_seq
from layerscan.operators.layout import place_by_tile, with_halo
from layerscan.operators.pixels import pixel_rows
from layerscan.params import Params
from layerscan.plans.analyze import analyze, analyze_counted, write_results
from layerscan.schema import MESSAGES, RESULTS
from layerscan.session import fresh_path
from layerscan.sources.messages import encode_frames, stream_messages
from layerscan.streaming.analysis import (
    analyze_stream,
    read_results,
    with_layer_watermark,
)
from pyspark.sql import functions as F

FINE = Params(dbscan_eps=3.0)


def two_tiles(layers=6, prints=("a",)):
    """Tiles that arrive interleaved, with gaps in the layer numbers."""
    out = []
    for n, name in enumerate(prints):
        for tile in (0, 1):
            for layer, image in enumerate(random_images(10 * n + tile, layers, 22, 26)):
                batch = (layer * 2 + tile) * len(prints) + n
                out.append((name, tile, 3 * layer, batch, image))
    return out


def messages_df(spark, frames):
    rows = [(b, p, t, layer, tiff(image)) for p, t, layer, b, image in frames]
    return spark.createDataFrame(rows, MESSAGES)


def test_results_match_the_definition(spark):
    frames = two_tiles()
    expected = results(frames, FINE)
    assert sum(len(r[-1]) for r in expected) > 8
    df = frames_df(spark, frames).repartition(3)
    found = analyze(df, FINE)
    assert found.schema.names == RESULTS.names
    assert [f.dataType for f in found.schema] == [f.dataType for f in RESULTS]
    assert collected(found) == expected
    small = Params(dbscan_eps=3.0, band_rows=7, chunk_layers=2, bucket_frames=2, block_cells=2)
    assert collected(analyze(df, small)) == expected
    assert collected(analyze(messages_df(spark, frames), FINE)) == expected


def test_default_radius(spark):
    frames = two_tiles(4)
    assert collected(analyze(frames_df(spark, frames))) == results(frames)


def test_other_window_sizes(spark):
    frames = two_tiles(6)
    df = frames_df(spark, frames).repartition(3)
    for size in (1, 2, 4):
        params = Params(dbscan_eps=3.0, window_size=size, chunk_layers=2, band_rows=9)
        assert collected(analyze(df, params)) == results(frames, params)


def test_records_without_a_print(spark):
    frames = [(None, *f[1:]) for f in two_tiles(5)]
    found, rejects = analyze_counted(messages_df(spark, frames), FINE)
    assert collected(found) == results(frames, FINE)
    assert [tuple(r) for r in rejects.collect()] == [(None, 10)]


def test_both_scans_agree(spark):
    df = frames_df(spark, [(*f[:4], f[4][: 9 + f[3] % 7, : 12 + f[3] % 5]) for f in two_tiles()])
    frames = arrival_seq(df, FINE)
    params = Params(dbscan_eps=3.0, band_rows=6, chunk_layers=2)
    once, windows = scan_layers(frames, params), scan_bands(band_windows(frames, params), params)
    assert once.exceptAll(windows).count() == windows.exceptAll(once).count() == 0


def test_two_prints_on_a_tile(spark):
    frames = two_tiles(4, ("a", "b"))
    apart = collected(analyze(frames_df(spark, frames), FINE))
    mixed = Params(dbscan_eps=3.0, key_cols=("tile_id",))
    together = collected(analyze(frames_df(spark, frames), mixed))
    assert apart == results(frames, FINE)
    assert together == results(frames, mixed)
    assert apart != together


def test_unusable_records_do_not_count(spark):
    frames = two_tiles(4)
    good = messages_df(spark, frames)
    extra = spark.createDataFrame(
        [
            (3, "a", 0, 1, None),
            (5, "a", 0, 4, b"II*"),
            (5, "a", None, 4, b""),
            (-1, "END", -1, None, None),
        ],
        MESSAGES,
    )
    assert collected(analyze(good.unionByName(extra), FINE)) == results(frames, FINE)


def run(spark, source, out, checkpoint, params=FINE):
    query = analyze_stream(stream_messages(spark, source, 1), out, checkpoint, params)
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_across_a_restart(spark):
    source, out = fresh_path(spark, "t-in"), fresh_path(spark, "t-out")
    checkpoint = fresh_path(spark, "t-state")
    frames = sorted(two_tiles(), key=lambda f: f[3])
    # Sizes change on one tile, and a band layout with several slots in use.
    frames = [(*f[:4], f[4][: 15 + f[3] % 5]) if f[1] else f for f in frames]
    params = Params(dbscan_eps=3.0, band_rows=4, stream_slots=3)
    first, second = messages_df(spark, frames[:5]), messages_df(spark, frames[5:])
    bad = spark.createDataFrame([(99, "a", 0, 1, b"junk"), (-1, "END", -1, None, None)], MESSAGES)
    first.unionByName(bad).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, checkpoint, params)
    assert read_results(spark, out).count() == 5
    second.coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, checkpoint, params)
    assert collected(read_results(spark, out)) == results(frames, params)
    reasons = read_results(spark, out, "rejects").select("batch_id", "reject_reason").collect()
    assert sorted(map(tuple, reasons)) == [(-1, "end_marker"), (99, "bad_payload")]
    counts = read_results(spark, out, "counts").groupBy("reject_reason").sum("records").collect()
    assert dict(map(tuple, counts)) == {None: len(frames), "bad_payload": 1, "end_marker": 1}


def test_watermark(spark):
    source = fresh_path(spark, "t-late")
    encode_frames(frames_df(spark, two_tiles(3))).coalesce(1).write.parquet(source)
    timed = with_layer_watermark(stream_messages(spark, source), F.current_timestamp())
    kept = timed.groupBy(F.window("event_time", "1 second"), "tile_id").count()
    counts = kept.writeStream.format("memory").queryName("by_second").outputMode("complete")
    counts.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("by_second").agg(F.sum("count")).first()[0] == 6


def test_results_are_stored(spark):
    path = fresh_path(spark, "t-results")
    found = analyze(frames_df(spark, two_tiles(3)), FINE)
    write_results(found, path)
    assert spark.read.parquet(path).exceptAll(found).count() == 0


def test_placement(spark):
    tiles = spark.range(-1, 40).select(F.col("id").cast("int").alias("tile_id"), F.lit("p").alias("print_id"))
    placed = place_by_tile(tiles, 16).withColumn("at", F.spark_partition_id()).collect()
    assert all(r.at == r.tile_id % 16 for r in placed)


def test_halo_blocks(spark):
    image = np.arange(20 * 3).reshape(20, 3)
    pixels = pixel_rows(frames_df(spark, [("p", 0, 0, 0, image)]))
    for rows in (2, 8, 50):
        found = {(r.y, r.block, r.in_core) for r in with_halo(pixels, 20, rows).collect()}
        blocks = range(-(-20 // rows))
        assert found == {
            (y, b, y // rows == b)
            for y in range(20)
            for b in blocks
            if b * rows - 4 <= y <= min(b * rows + rows, 20) + 3
        }
