"""The message log: exact offsets, limits, end markers, and stream = batch."""

from brute import collected, results
from test_analysis import FINE, messages_df, two_tiles

from layerscan.plans.analyze import analyze
from layerscan.session import fresh_path
from layerscan.sources import log
from layerscan.sources.log import append_log, read_log, stream_log
from layerscan.streaming.analysis import analyze_stream, read_results
from layerscan.streaming.sink import commit, read_table


def ids(df):
    return sorted(r.batch_id for r in df.select("batch_id").collect())


def pulled(spark, path, turns, **options):
    """Records of each micro-batch, over runs of the same query."""
    out, state, seen = fresh_path(spark, "t-out"), fresh_path(spark, "t-state"), []
    for turn in turns:
        turn()

        def write(rows, n):
            commit(spark, out, n, {"t": rows.drop("tif")})
            seen.append(n)

        stream = stream_log(spark, path, **options)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return ids(read_table(spark, out, "t"))


def test_offsets_limits_and_end_markers(spark, monkeypatch):
    path = fresh_path(spark, "t-log")
    frames = sorted(two_tiles(5), key=lambda f: f[3])
    assert append_log(messages_df(spark, frames[:6]).coalesce(1), path) == 6
    assert ids(read_log(spark, path)) == list(range(6))
    assert ids(read_log(spark, path, limit=4)) == list(range(4))
    assert pulled(spark, path, [lambda: None], limit=4) == [-1, 0, 1, 2, 3]
    assert pulled(spark, path, [lambda: None]) == list(range(6))
    more = lambda: append_log(messages_df(spark, frames[6:]).repartition(2), path, end=True)
    # The end marker comes once, after the last record, also if the run goes on with nothing new.
    assert pulled(spark, path, [lambda: None, more, lambda: None]) == [-1, *range(10)]
    assert append_log(messages_df(spark, []), path) == 10


def test_a_range_of_offsets_gives_the_same_records(spark, monkeypatch):
    path = fresh_path(spark, "t-log")
    append_log(messages_df(spark, sorted(two_tiles(5), key=lambda f: f[3])).coalesce(1), path)
    monkeypatch.setattr(log, "PART_ROWS", 3)
    rows = lambda a, b: [r for part in log.ranges(path, a, b) for batch in log.read_part(part) for r in batch["batch_id"].to_pylist()]
    assert rows(2, 9) == rows(2, 9) == list(range(2, 9))
    assert rows(0, 2) + rows(2, 7) + rows(7, 99) == list(range(10))
    stream = log.LogStream({"path": path, "per_batch": "4"})
    at, steps = stream.initialOffset(), []
    while True:
        end = stream.latestOffset()
        if end == at:
            break
        stream.partitions(at, end)
        steps.append(end["record"])
        at = end
    assert steps == [4, 8, 10]


def test_stop_and_resume_in_a_segment_equals_batch(spark):
    """The first run ends after five records of a segment of twelve."""
    path, out, state = (fresh_path(spark, f"t-{x}") for x in ("log", "out", "state"))
    frames = sorted(two_tiles(), key=lambda f: f[3])
    append_log(messages_df(spark, frames).coalesce(1), path, end=True)
    for limit in (5, 0):
        query = analyze_stream(stream_log(spark, path, limit=limit), out, state, FINE)
        query.awaitTermination()
        if limit:
            assert read_results(spark, out).count() == 5
    assert collected(read_results(spark, out)) == results(frames, FINE) == collected(analyze(read_log(spark, path), FINE))
