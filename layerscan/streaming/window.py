"""The layer window of a stream, held as keyed state: numbering, scan, late records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from layerscan.operators import bands as B
from layerscan.operators.layers import image_digest
from layerscan.params import Params
from layerscan.schema import FRAME, IMAGE

# Values of ``kind``, and of ``reject_reason`` for records beyond the lateness.
BAND = "band"
REJECT = "reject"
LATE = "late"

# Late policies: take every record, keep late ones apart, or only count them.
PROCESS, SIDE, DROP = "process", "side", "drop"

ROWS_PER_YIELD = 256
#: State keys over which rejects, most of them without a key, are spread.
REJECT_SLOTS = 64
PIXEL = np.dtype("<i4")

TAGGED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
        *(T.StructField(c, T.StringType() if c == "print_id" else T.IntegerType()) for c in FRAME),
        T.StructField("band", T.IntegerType()),
        T.StructField("saturated", T.IntegerType()),
        T.StructField("flagged", T.BinaryType()),
    ]
)


def streaming_scan(
    decoded: DataFrame, params: Params = Params(), late: str = PROCESS, lateness: int = 0
) -> DataFrame:
    """Scanned bands, rejects and late records of a stream of decoded messages, by ``kind``.

    A frame's bands are dealt out to ``stream_slots`` slots, and the state key
    is (key, slot): a busy tile spreads over its slots. Each frame sends one
    row to each slot, even without bands for it, so all slots count alike.
    Rejects pass through on keys of their own. The state store must be RocksDB.
    """
    if late not in (PROCESS, SIDE, DROP):
        raise ValueError(f"no late policy {late!r}")
    slots = params.stream_slots

    def piece(band: Column) -> Column:
        top, rows = B.band_slice(band, params)
        return F.struct(band.alias("band"), top.alias("top"), rows.alias("rows"))

    apart = F.array((F.lit(-1) - F.pmod(F.xxhash64("batch_id", "layer"), F.lit(REJECT_SLOTS))).cast("int"))
    slot = F.when(F.col("reject_reason").isNull(), F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(apart)
    in_slot = F.filter(B.bands_of(params), lambda band: band % slots == F.col("slot"))
    dealt = (
        decoded.select("*", image_digest().alias("digest"), F.explode(slot).alias("slot"))
        .select(*IMAGE, "width", "height", "reject_reason", "digest", "slot", F.transform(in_slot, piece).alias("pieces"))
    )
    tagged = dealt.groupBy(*params.key_cols, "slot").transformWithStateInPandas(
        SlotScan(params, late, lateness), TAGGED, "Append", "None"
    )
    return tagged.withColumn("flagged", unpack_flagged("flagged"))


@F.arrow_udf(B.SCANNED)
def unpack_flagged(packed: pa.Array) -> pa.Array:
    """Flagged pixels of each band as structs."""
    cells = [np.frombuffer(x.as_buffer(), PIXEL) if x.is_valid else np.empty(0, PIXEL) for x in packed]
    names = B.SCANNED.elementType.names
    flat = np.concatenate([np.empty(0, PIXEL), *cells]).reshape(-1, len(names))
    offsets = np.cumsum([0] + [len(x) // len(names) for x in cells])
    structs = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(flat.T)], names=names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _radii(back: int, params: Params) -> list[int]:
    """Radii of the diamonds that a layer gives to windows ``back`` or more layers on."""
    used = {r for b, *both in params.stencil_radii() if b >= back for r in both}
    return sorted(r for r in used if r >= 0)


def pack_sums(sums: np.ndarray, back: int, params: Params) -> bytes:
    """The sums that later windows still need; single pixels take two bytes."""
    kinds = {0: "<u2"}
    return b"".join(sums[r].astype(kinds.get(r, "<i4")).tobytes() for r in _radii(back, params))


def unpack_sums(packed: bytes, width: int, back: int, params: Params) -> np.ndarray:
    out = np.zeros((params.reach + 1, params.band_rows, width), np.int32)
    size, at = params.band_rows * width, 0
    for r in _radii(back, params):
        kind = np.dtype("<i4" if r else "<u2")
        out[r] = np.frombuffer(packed, kind, size, at).reshape(params.band_rows, width)
        at += size * kind.itemsize
    return out


class Pieces:
    """Bands of a micro-batch until their turn: in memory up to a bound, beyond it in keyed state."""

    def __init__(self, state, held_bytes: int) -> None:
        self.state, self.left = state, held_bytes
        self.held: dict[tuple[int, int], tuple] = {}
        self.stored: set[tuple[int, int]] = set()

    def put(self, place: int, band: int, top: int, rows: bytes) -> None:
        self.left -= len(rows or b"")
        if self.left >= 0:
            self.held[place, band] = (top, rows)
        else:
            self.state.updateValue((place, band), (top, rows))
            self.stored.add((place, band))

    def take(self, place: int, band: int) -> tuple | None:
        """Top and rows of a band, once."""
        if (place, band) in self.stored:
            self.stored.remove((place, band))
            value = self.state.getValue((place, band))
            self.state.removeKey((place, band))
            return tuple(value)
        return self.held.pop((place, band), None)


def records_of(piece: pd.DataFrame) -> Iterator[dict]:
    """Rows as dicts; where a batch has nulls, pandas has made its whole numbers floats."""
    for record in piece.to_dict("records"):
        yield {c: (None if v != v else int(v)) if isinstance(v, float) else v for c, v in record.items()}


class SlotScan(StatefulProcessor):
    """Numbers the frames of a slot and scans its bands against earlier layers.

    State: the number of frames so far with the key's greatest layer, and per
    band the sums over diamonds of the last ``history`` layers. A layer is summed
    once, in the micro-batch that brings it. A micro-batch is taken in the order
    of arrival numbers; records of one arrival number go by layer and then by
    their image's digest, so all slots number them alike. At once in memory are
    the headers of the micro-batch, its bands up to ``stream_held_bytes``, and the
    layers of one band.
    """

    def __init__(self, params: Params, late: str = PROCESS, lateness: int = 0) -> None:
        self.params, self.late, self.lateness = params, late, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq int, high int")
        self.sums = handle.getMapState("sums", "band int, place int", "seq int, width int, back int, sums binary")
        self.pending = handle.getMapState("pending", "place int, band int", "top int, rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = Output()
        if key[-1] < 0:
            for piece in rows:
                for record in records_of(piece):
                    yield from out.add(REJECT, record, reject_reason=record["reject_reason"])
            yield from out.rest()
            return
        frames, pieces, of_band = [], Pieces(self.pending, self.params.stream_held_bytes), {}
        for piece in rows:
            for frame in records_of(piece):
                for band in frame.pop("pieces"):
                    pieces.put(len(frames), band["band"], band["top"], band["rows"])
                    of_band.setdefault(band["band"], set()).add(len(frames))
                frames.append(frame)
        order = sorted(range(len(frames)), key=lambda i: tuple(frames[i][c] for c in ("batch_id", "layer", "digest")))
        taken = []
        seq, high = self.seen.get() or (0, None)
        for i in order:
            layer = frames[i]["layer"]
            if self.late != PROCESS and high is not None and layer < high - self.lateness:
                if key[-1] == 0:
                    yield from out.add(LATE, frames[i], reject_reason=LATE)
                continue
            high = layer if high is None else max(high, layer)
            seq += 1
            frames[i]["seq"] = seq
            taken.append(i)
        self.seen.update((seq, high))
        for band in sorted(of_band):
            held = self._held(band)
            for i in taken:
                if i not in of_band[band]:
                    continue
                top, packed = pieces.take(i, band)
                found, held = self._scanned({**frames[i], "band": band, "top": top, "rows": packed}, held)
                if found is not None:
                    yield from out.add(BAND, frames[i], band=band, saturated=found[0], flagged=found[1])
            for i in of_band[band] - set(taken):
                pieces.take(i, band)
            self._hold(band, held, seq)
        yield from out.rest()

    def _scanned(self, band: dict, held: list) -> tuple[tuple[int, bytes] | None, list]:
        """Saturated and flagged pixels of a band, and the layers to hold after it."""
        params = self.params
        canvas = np.zeros((params.band_rows + 2 * params.reach, band["width"] + 3 * params.reach), np.int32)
        first = band["band"] * params.band_rows
        if band["rows"]:
            B._place(canvas, band, first - params.reach, params.reach)
        held = [h for h in held if h[1] >= band["seq"] - params.history]
        held.append((None, band["seq"], B._diamonds(canvas, params)))
        if first >= band["height"]:
            return None, held
        hit, count = B._flagged_of(canvas, band, held, params)
        return (count, np.ascontiguousarray(hit.T, PIXEL).tobytes()), held

    def _held(self, band: int) -> list:
        out = []
        for place in range(self.params.history):
            if self.sums.containsKey((band, place)):
                seq, width, back, packed = self.sums.getValue((band, place))
                out.append((None, seq, unpack_sums(packed, width, back, self.params)))
        return sorted(out, key=lambda h: h[1])

    def _hold(self, band: int, held: list, seq: int) -> None:
        for _, at, sums in held:
            back = seq + 1 - at
            if back <= self.params.history:
                packed = pack_sums(sums, back, self.params)
                self.sums.updateValue((band, at % self.params.history), (at, sums.shape[2], back, packed))

    def close(self) -> None:
        pass


class Output:
    """Tagged rows, sent in frames of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, kind: str, record: dict, **values) -> Iterator[pd.DataFrame]:
        values = {"kind": kind, **{c: record.get(c) for c in FRAME}, **values}
        self.rows.append(tuple(values.get(c) for c in TAGGED.names))
        if len(self.rows) >= ROWS_PER_YIELD:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            frame = pd.DataFrame(self.rows, columns=TAGGED.names, dtype=object)
            for c in (f.name for f in TAGGED if isinstance(f.dataType, T.IntegerType)):
                frame[c] = frame[c].astype("Int32")
            self.rows = []
            yield frame
