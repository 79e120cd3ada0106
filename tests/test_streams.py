"""State, late records, timers and the sink of streams."""

import threading
import time

import numpy as np
import pandas as pd
import pytest
from brute import collected, frames_df, random_images, results
from test_analysis import FINE, messages_df, two_tiles

from layerscan.operators import bands
from layerscan.operators.bands import bands_of, band_slice
from layerscan.params import Params
from layerscan.plans.analyze import analyze
from layerscan.session import fresh_path, materialize, scratch
from layerscan.sources.messages import decode_frames, encode_frames, stream_messages
from layerscan.streaming import sink, window
from layerscan.streaming.analysis import analyze_stream, read_results, start_stateful, with_layer_watermark
from layerscan.streaming.closing import closed_layers
from pyspark.sql import functions as F


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Mapped(dict):
    """Keyed state of one key, in memory."""

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Mapped()


def rows_of(frames, params, slot):
    """Input rows of a slot, as the stream deals them."""
    out = []
    for p, t, layer, b, image in frames:
        height, width = image.shape
        count = (height - 1 + params.reach) // params.band_rows + 1
        pieces = []
        for band in range(slot, count, params.stream_slots):
            top = max(band * params.band_rows - params.reach, 0)
            end = min((band + 1) * params.band_rows + params.reach, height)
            pieces.append({"band": band, "top": top, "rows": image[top:end].astype("<u2").tobytes()})
        out.append({"print_id": p, "tile_id": t, "layer": layer, "batch_id": b, "width": width, "height": height, "digest": "", "pieces": pieces})
    return pd.DataFrame(out)


@pytest.mark.parametrize("held_bytes", [1 << 20, 900])
def test_a_layer_is_summed_once_over_appends(monkeypatch, held_bytes):
    params = Params(band_rows=5, stream_slots=2, stream_held_bytes=held_bytes)
    frames = [("p", 0, n, n, image) for n, image in enumerate(random_images(3, 7, 22, 26))]
    summed, plain = [], bands._diamonds
    monkeypatch.setattr(bands, "_diamonds", lambda *a: summed.append(1) or plain(*a))
    found = {}
    for slot in range(params.stream_slots):
        scan = window.SlotScan(params)
        scan.init(Handle())
        for part in (frames[:3], frames[3:4], frames[4:]):
            for out in scan.handleInputRows(("p", 0, slot), iter([rows_of(part, params, slot)]), None):
                for row in out.to_dict("records"):
                    cells = np.frombuffer(row["flagged"], window.PIXEL).reshape(-1, 4)
                    found.setdefault(row["seq"], []).extend((int(x), int(y)) for x, y, *_ in cells)
        assert not scan.pending
    # 22 rows and the halo of the last ones make six bands.
    assert len(summed) == 6 * len(frames)
    from brute import flagged

    for seq in range(3, 8):
        expected = {(x, y) for x, y, *_ in flagged([f[4] for f in frames[seq - 3 : seq]], params)}
        assert set(found[seq]) == expected and len(found[seq]) == len(expected)


def test_held_sums_survive_packing():
    params = Params(band_rows=6)
    canvas = np.random.default_rng(0).integers(0, 65536, (14, 30)).astype(np.int32)
    sums = bands._diamonds(canvas, params)
    for back in (1, 2):
        again = window.unpack_sums(window.pack_sums(sums, back, params), sums.shape[2], back, params)
        for b, *radii in params.stencil_radii():
            assert b < back or all((again[r] == sums[r]).all() for r in radii if r >= 0)


def run(spark, frames, appends, params=FINE, **options):
    source, out, state = (fresh_path(spark, f"t-{x}") for x in ("in", "out", "state"))
    for part in appends(frames):
        messages_df(spark, part).coalesce(1).write.mode("append").parquet(source)
        query = analyze_stream(stream_messages(spark, source, 9), out, state, params, **options)
        query.awaitTermination()
    return out


def test_records_of_one_arrival_number(spark):
    """Two different images share arrival number and layer; all slots take them in the same order."""
    frames = [(p, t, layer // 2, b - b % 4, image) for p, t, layer, b, image in two_tiles(8)]
    params = Params(dbscan_eps=3.0, band_rows=4, stream_slots=3)
    out = run(spark, frames, lambda f: [f], params)
    of = lambda df: sorted(map(repr, df.drop("query").collect()))
    assert of(read_results(spark, out)) == of(analyze(messages_df(spark, frames).repartition(5), params))


@pytest.mark.parametrize("policy", [window.PROCESS, window.SIDE, window.DROP])
def test_late_records(spark, policy):
    frames = sorted(two_tiles(), key=lambda f: f[3])
    late = [f for f in frames if f[3] in (2, 5)]
    rest = [f for f in frames if f[3] not in (2, 5)]
    out = run(spark, frames, lambda f: [rest[:7], rest[7:] + late], late=policy, lateness=2)
    # The second append brings layers beyond those of the late records.
    order = rest + late if policy == window.PROCESS else rest
    by_arrival = [(p, t, layer, n, image) for n, (p, t, layer, b, image) in enumerate(order)]
    counts = {r[0]: r[1] for r in read_results(spark, out, "counts").groupBy("reject_reason").sum("records").collect()}
    stored = sorted(r.batch_id for r in read_results(spark, out, "late").collect())
    if policy == window.PROCESS:
        assert counts == {None: 12} and stored == []
        return
    assert counts == {None: 10, "late": 2}
    assert stored == ([2, 5] if policy == window.SIDE else [])
    strip = lambda rows: [r[1:] for r in rows]
    assert strip(collected(read_results(spark, out))) == strip(results(by_arrival, FINE))


def test_readers_see_whole_micro_batches(spark):
    out = fresh_path(spark, "t-sink")
    table = lambda *values: {"t": spark.createDataFrame([(v,) for v in values], "v int")}
    read = lambda: sorted(r.v for r in sink.read_table(spark, out, "t").collect())
    with pytest.raises(ValueError):
        read()
    for batch in range(3):
        sink.commit(spark, out, batch, table(batch, batch + 10))
    assert read() == [0, 1, 2, 10, 11, 12]
    before = sink.read_table(spark, out, "t")
    # A replay that stops before its entry is written changes nothing; one that ends replaces.
    table(99)["t"].write.parquet(f"{out}/data/2-stopped/t")
    assert read() == [0, 1, 2, 10, 11, 12]
    sink.commit(spark, out, 2, table(2, 12))
    assert read() == [0, 1, 2, 10, 11, 12] == sorted(r.v for r in before.collect())
    assert sink.compact(spark, out) == 2 and read() == [0, 1, 2, 10, 11, 12]
    sink.commit(spark, out, 3, table(3))
    assert sink.compact(spark, out) == 2 and sink.compact(spark, out) == 0
    assert len(sink.vacuum(spark, out)) == 6
    assert read() == [0, 1, 2, 3, 10, 11, 12]


def test_scratch_is_of_its_thread(spark):
    inside, done, kept = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            kept.append(materialize(spark.range(3), "t-other"))
            inside.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    own = materialize(spark.range(5), "t-own")
    with scratch(spark):
        with scratch(spark):
            inner = materialize(spark.range(7), "t-inner")
        outer = materialize(spark.range(9), "t-outer")
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            inner.collect()
        assert outer.count() == 9
    done.set()
    thread.join()
    assert own.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        kept[0].collect()


def closing(spark, frames, parts, **options):
    source, out, state = (fresh_path(spark, f"t-{x}") for x in ("in", "out", "state"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    def start(now):
        timed = with_layer_watermark(stream_messages(spark, source), lateness="2 milliseconds", first_ms=1000)
        return start_stateful(closed_layers(decode_frames(timed), **options), write, state, now)

    for part in parts:
        encode_frames(frames_df(spark, part)).coalesce(1).write.mode("append").parquet(source)
        if options.get("by") != "idle":
            start(True).awaitTermination()
    if options.get("by") == "idle":
        query = start(False)
        end = time.time() + 90
        while time.time() < end and len(spark.read.schema(closed_schema()).parquet(f"{out}/*").collect() if query.lastProgress else []) < 6:
            time.sleep(1)
        query.stop()
    return sorted(map(tuple, spark.read.schema(closed_schema()).parquet(f"{out}/*").collect()))


def closed_schema():
    from layerscan.streaming.closing import CLOSED

    return CLOSED


def layers_of(frames):
    out = {}
    for p, _, layer, _, image in frames:
        tiles, saturated = out.get((p, layer), (0, 0))
        out[p, layer] = (tiles + 1, saturated + int((image > 65000).sum()))
    return out


def test_the_watermark_closes_layers(spark):
    frames = sorted(two_tiles(), key=lambda f: f[3])
    got = closing(spark, frames, [frames[:5], frames[5:]])
    expected = sorted((*k, *v, "watermark") for k, v in layers_of(frames).items() if k[1] <= 15 - 2)
    assert got == expected and len(got) == 5


def test_idle_layers_close(spark):
    frames = two_tiles()
    got = closing(spark, frames, [frames], by="idle", idle_seconds=1)
    assert got == sorted((*k, *v, "idle") for k, v in layers_of(frames).items())
