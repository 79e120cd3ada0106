"""Images of tile payloads: TIFF with one 16-bit grayscale band, of either byte order.

Strips or tiles; plain, PackBits, LZW or Deflate; with or without horizontal
differencing. Anything else, and any damage, raises an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from layerscan.functions.packed import SAMPLE

# Fixed values of the TIFF format: tags, field types read here, compressions, LZW codes.
TAG_WIDTH = 256
TAG_HEIGHT = 257
TAG_BITS = 258
TAG_COMPRESSION = 259
TAG_PHOTOMETRIC = 262
TAG_STRIP_OFFSETS = 273
TAG_SAMPLES = 277
TAG_ROWS_PER_STRIP = 278
TAG_STRIP_BYTES = 279
TAG_PREDICTOR = 317
TAG_TILE_WIDTH = 322
TAG_TILE_HEIGHT = 323
TAG_TILE_OFFSETS = 324
TAG_TILE_BYTES = 325
FIELD_FORMATS = {3: "H", 4: "I"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
DIFFERENCES = 2
LZW_CLEAR, LZW_END = 256, 257

#: No compression read here gives more bytes for one.
MOST_BYTES_FOR_ONE = 4096


class BadImage(ValueError):
    """A payload that is no image of the kind read here."""


class Segment(NamedTuple):
    """A strip or tile: where its bytes are, and which pixels it holds."""

    start: int
    length: int
    y: int
    x: int
    height: int
    width: int


class Layout(NamedTuple):
    order: str
    width: int
    height: int
    compression: int
    predictor: int
    segments: list[Segment]


def image_error(payload) -> str | None:
    """Why a payload cannot be decoded; plain ones are not copied to find out."""
    try:
        view = memoryview(payload)
        layout = read_layout(view)
        if layout.compression != PLAIN:
            _samples(view, layout)
    except BadImage as problem:
        return str(problem)
    return None


def decode_image(payload) -> tuple[int, int, bytes]:
    """Width, height and packed samples."""
    view = memoryview(payload)
    layout = read_layout(view)
    return layout.width, layout.height, _samples(view, layout)


def read_layout(view: memoryview) -> Layout:
    """What the first directory says of the image, checked against the payload's length."""
    try:
        order = {b"II": "<", b"MM": ">"}.get(bytes(view[:2]))
        if order is None or struct.unpack_from(order + "H", view, 2) != (42,):
            raise BadImage("not a TIFF")
        return _layout(view, order, _read_tags(view, order))
    except (struct.error, KeyError) as problem:
        raise BadImage(str(problem) or type(problem).__name__) from problem


def _layout(view: memoryview, order: str, tags: dict[int, list[int]]) -> Layout:
    width, height = tags[TAG_WIDTH][0], tags[TAG_HEIGHT][0]
    compression, predictor = (tags.get(t, [1])[0] for t in (TAG_COMPRESSION, TAG_PREDICTOR))
    one_band = tags.get(TAG_BITS, [1]) == [16] and tags.get(TAG_SAMPLES, [1]) == [1]
    if not one_band or tags.get(TAG_PHOTOMETRIC, [1])[0] not in (0, 1):
        raise BadImage("not 16-bit grayscale")
    if compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor not in (1, DIFFERENCES):
        raise BadImage("compression not known")
    if width < 1 or height < 1:
        raise BadImage("empty image")
    if width * height * SAMPLE.itemsize > MOST_BYTES_FOR_ONE * len(view):
        raise BadImage("pixels missing")
    cut = _tiles if TAG_TILE_OFFSETS in tags else _strips
    segments = list(cut(tags, width, height, compression))
    if any(s.start + s.length > len(view) for s in segments):
        raise BadImage("payload ends early")
    if compression == PLAIN and any(s.length < s.height * s.width * SAMPLE.itemsize for s in segments):
        raise BadImage("pixels missing")
    return Layout(order, width, height, compression, predictor, segments)


def _strips(tags: dict[int, list[int]], width: int, height: int, compression: int) -> Iterator[Segment]:
    """Strips in use; of plain ones no more bytes than they need."""
    rows = min(tags.get(TAG_ROWS_PER_STRIP, [height])[0], height)
    if rows < 1:
        raise BadImage("empty strips")
    row_bytes, y = width * SAMPLE.itemsize, 0
    offsets = tags[TAG_STRIP_OFFSETS]
    lengths = tags.get(TAG_STRIP_BYTES)
    if lengths is None:
        if compression != PLAIN:
            raise BadImage("strip lengths missing")
        lengths = [rows * row_bytes] * len(offsets)
    for start, length in zip(offsets, lengths):
        if y >= height:
            break
        own = min(rows, height - y)
        if compression == PLAIN:
            # A short plain strip holds as many rows as it has bytes for.
            own = min(own, length // row_bytes)
            length = own * row_bytes
        if own:
            yield Segment(start, length, y, 0, own, width)
        y += own
    if y < height:
        raise BadImage("pixels missing")


def _tiles(tags: dict[int, list[int]], width: int, height: int, compression: int) -> Iterator[Segment]:
    """All tiles; those at the right and lower edge reach beyond the image."""
    across, down = tags[TAG_TILE_WIDTH][0], tags[TAG_TILE_HEIGHT][0]
    if across < 1 or down < 1:
        raise BadImage("empty tiles")
    offsets, lengths = tags[TAG_TILE_OFFSETS], tags[TAG_TILE_BYTES]
    if min(len(offsets), len(lengths)) < -(-height // down) * -(-width // across):
        raise BadImage("pixels missing")
    places = ((y, x) for y in range(0, height, down) for x in range(0, width, across))
    for (y, x), start, length in zip(places, offsets, lengths):
        yield Segment(start, length, y, x, down, across)


def _samples(view: memoryview, layout: Layout) -> bytes:
    """All pixels, row by row."""
    plain_rows = all(s.width == layout.width and s.x == 0 for s in layout.segments)
    if layout.compression == PLAIN and layout.predictor == 1 and layout.order == "<" and plain_rows:
        joined = b"".join(view[s.start : s.start + s.length] for s in layout.segments)
        return joined[: layout.width * layout.height * SAMPLE.itemsize]
    image = np.zeros((layout.height, layout.width), SAMPLE)
    for s in layout.segments:
        need = s.height * s.width * SAMPLE.itemsize
        raw = expand(bytes(view[s.start : s.start + s.length]), layout.compression, need)
        if len(raw) < need:
            raise BadImage("pixels missing")
        pixels = np.frombuffer(raw, layout.order + "u2", s.height * s.width).reshape(s.height, s.width)
        if layout.predictor == DIFFERENCES:
            pixels = np.cumsum(pixels, axis=1, dtype=np.uint16)
        inside = image[s.y : s.y + s.height, s.x : s.x + s.width]
        inside[...] = pixels[: inside.shape[0], : inside.shape[1]]
    return image.tobytes()


def expand(data: bytes, compression: int, size: int) -> bytes:
    """Up to ``size`` bytes of compressed data, and perhaps some more."""
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as problem:
            raise BadImage(str(problem)) from problem
    return data


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: runs of one byte, and bytes as they are."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, the first bit the highest."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    out, words, before = bytearray(), None, None
    held, bits, width = 0, 0, 9
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            words, before, width = list(single), None, 9
            continue
        if words is None or code > len(words) or (before is None and code > 255):
            raise BadImage("bad LZW code")
        if before is not None:
            if len(words) > 4095:
                raise BadImage("too many LZW codes")
            words.append(before + (words[code] if code < len(words) else before)[:1])
        before = words[code]
        out += before
        if len(out) >= size:
            break
        # Codes grow one word early.
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out)


def _read_tags(view: memoryview, order: str) -> dict[int, list[int]]:
    """Integer tags of the first directory."""
    (directory,) = struct.unpack_from(order + "I", view, 4)
    (entries,) = struct.unpack_from(order + "H", view, directory)
    tags = {}
    for n in range(entries):
        at = directory + 2 + 12 * n
        tag, kind, count = struct.unpack_from(order + "HHI", view, at)
        if kind not in FIELD_FORMATS:
            continue
        if not count:
            raise BadImage(f"tag {tag} is empty")
        values = f"{order}{count}{FIELD_FORMATS[kind]}"
        if count * struct.calcsize(FIELD_FORMATS[kind]) > 4:
            (where,) = struct.unpack_from(order + "I", view, at + 8)
        else:
            where = at + 8
        tags[tag] = list(struct.unpack_from(values, view, where))
    return tags


def single_strip_header(width: int, height: int, compression: int = PLAIN, length: int | None = None) -> bytes:
    """What stands before the one strip of an image, by default its packed samples as they are."""
    fields = [
        (TAG_WIDTH, width),
        (TAG_HEIGHT, height),
        (TAG_BITS, 16),
        (TAG_COMPRESSION, compression),
        (TAG_PHOTOMETRIC, 1),
        (TAG_STRIP_OFFSETS, 8 + 2 + 12 * 9 + 4),
        (TAG_SAMPLES, 1),
        (TAG_ROWS_PER_STRIP, height),
        (TAG_STRIP_BYTES, width * height * SAMPLE.itemsize if length is None else length),
    ]
    directory = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in fields)
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + directory + struct.pack("<I", 0)
