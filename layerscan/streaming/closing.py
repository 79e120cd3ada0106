"""Layers closed by time: when the watermark has passed them, or when they fall idle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from layerscan.functions.packed import SAMPLE
from layerscan.params import Params

# Fixed value: a source counts as idle after this time without a record.
IDLE_SECONDS = 30

WATERMARK, IDLE = "watermark", "idle"
CLOSED = T.StructType(
    [
        T.StructField("print_id", T.StringType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("tiles", T.IntegerType()),
        T.StructField("saturated", T.LongType()),
        T.StructField("closed_by", T.StringType()),
    ]
)


def saturated_pixels(temps: str, params: Params = Params()):
    """Saturated pixels of each packed image."""
    above = params.saturation_thresh

    def count(images: pa.Array) -> pa.Array:
        return pa.array([int((np.frombuffer(x.as_buffer(), SAMPLE) > above).sum()) for x in images], pa.int64())

    return F.arrow_udf(count, T.LongType())(temps)


def closed_layers(
    frames: DataFrame, params: Params = Params(), by: str = WATERMARK, idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """One row per layer of a print once it is closed: tile images seen, saturated pixels in all.

    ``frames`` is a stream of decoded frames with ``event_time`` and its watermark.
    By ``watermark`` a layer closes when the watermark passes its event time, and
    records that come later are dropped by it; by ``idle`` it closes when none of
    its records has come for ``idle_seconds``, and a record after that opens it anew.
    The state of a layer is two numbers, so no image is held.
    """
    if by not in (WATERMARK, IDLE):
        raise ValueError(f"no closing by {by!r}")
    counted = frames.select("print_id", "layer", "event_time", saturated_pixels("temps", params).alias("saturated"))
    mode = "EventTime" if by == WATERMARK else "ProcessingTime"
    return counted.groupBy("print_id", "layer").transformWithStateInPandas(
        LayerCloser(by, int(idle_seconds * 1000)), CLOSED, "Append", mode
    )


class LayerCloser(StatefulProcessor):
    """Counts the tile images of a layer; a timer closes it."""

    def __init__(self, by: str, idle_ms: int) -> None:
        self.by, self.idle_ms = by, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "tiles int, saturated long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tiles, saturated = self.total.get() or (0, 0)
        latest = 0
        for piece in rows:
            tiles += len(piece)
            saturated += int(piece["saturated"].sum())
            latest = max(latest, int(piece["event_time"].max().timestamp() * 1000))
        self.total.update((tiles, saturated))
        timers = list(self.handle.listTimers())
        if self.by == IDLE:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        elif not timers:
            self.handle.registerTimer(latest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tiles, saturated = self.total.get()
        self.total.clear()
        yield pd.DataFrame([(key[0], key[1], tiles, saturated, self.by)], columns=CLOSED.names)

    def close(self) -> None:
        pass
