import base64
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import random_images

from layerscan.functions.packed import pack_images
from layerscan.operators.records import (
    mark_rejects,
    observe_rejects,
    split_valid,
)
from layerscan.schema import MESSAGES
from layerscan.sources import tiff as tiff_module
from layerscan.session import fresh_path
from layerscan.sources.messages import (
    check_messages,
    decode_frames,
    decoded_messages,
    encode_frames,
    read_messages,
    read_tile_files,
    typed_messages,
)


def tiff(image, order="<", strips=1, **changes):
    """A TIFF of one 16-bit band, its directory after the pixels."""
    height, width = image.shape
    rows = -(-height // strips)
    parts = [image[i : i + rows].astype(order + "u2").tobytes() for i in range(0, height, rows)]
    starts = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    after = 8 + sum(map(len, parts))
    n = len(parts)
    lists = b""
    if n > 1:
        lists = struct.pack(f"{order}{2 * n}I", *starts, *map(len, parts))
    directory = after + len(lists)
    tags = {
        256: (3, 1, width),
        257: (4, 1, height),
        258: (3, 1, 16),
        259: (3, 1, 1),
        262: (3, 1, 1),
        273: (4, n, starts[0] if n == 1 else after),
        277: (3, 1, 1),
        278: (4, 1, rows),
        279: (4, n, len(parts[0]) if n == 1 else after + 4 * n),
        305: (2, 4, 0),
    }
    for tag, value in changes.items():
        tags[int(tag[1:])] = value
    entries = b""
    for tag, (kind, count, value) in sorted(tags.items()):
        single = struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value)
        entries += struct.pack(order + "HHI", tag, kind, count) + single
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, directory)
    return head + b"".join(parts) + lists + struct.pack(order + "H", len(tags)) + entries + bytes(4)


def messages(spark, payloads):
    rows = [(i, "p", 0, i, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, MESSAGES)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("strips", [1, 3, 7])
def test_decode(spark, order, strips):
    images = random_images(1, 3, 7, 5)
    images[0][0, :3] = (0, 65535, 258)
    df = messages(spark, [tiff(i, order, strips) for i in images])
    assert check_messages(df).filter("reject_reason is not null").count() == 0
    for row in decode_frames(df).collect():
        image = images[row.batch_id]
        assert (row.height, row.width) == image.shape
        assert np.array_equal(np.frombuffer(row.temps, "<u2").reshape(image.shape), image)


def test_bad_payloads_are_set_aside(spark):
    image = random_images(1, 1, 6, 5)[0]
    good = tiff(image)
    bad = [
        b"",
        b"II",
        good[:40],
        good[:-30],
        b"XX" + good[2:],
        tiff(image, c259=(3, 1, 5)),
        tiff(image, c258=(3, 1, 8)),
        tiff(image, c277=(3, 1, 3)),
        tiff(image, c257=(4, 1, 60)),
        tiff(image, c273=(4, 1, 10**6)),
    ]
    marked = check_messages(messages(spark, [good, None, *bad]))
    reasons = {r.batch_id: r.reject_reason for r in marked.collect()}
    assert reasons == {0: None, 1: "no_payload", **{i + 2: "bad_payload" for i in range(len(bad))}}
    kept, rejects = split_valid(marked)
    assert decode_frames(kept).count() == 1
    assert rejects.count() == len(bad) + 1


def test_encode_is_the_inverse(spark):
    df = messages(spark, [tiff(i) for i in random_images(2, 4, 9, 4)])
    frames = decode_frames(df)
    again = decode_frames(encode_frames(frames)).select(frames.columns)
    assert again.exceptAll(frames).count() == 0


def test_record_checks(spark):
    rows = [
        (0, "p", 0, 0, b"x"),
        (-1, "END", -1, None, None),
        (1, "p", None, 0, b"x"),
        (2, "p", 3, 0, None),
        (3, "p", 3, None, b"x"),
        (None, None, None, None, None),
    ]
    marked, seen = observe_rejects(mark_rejects(spark.createDataFrame(rows, MESSAGES)))
    reasons = [r.reject_reason for r in marked.coalesce(1).collect()]
    assert reasons == [None, "end_marker", "no_tile", "no_payload", "incomplete", "null_record"]
    assert seen.get == {"records": 6, "rejects": 5}


def test_typed_json(spark):
    tif = base64.b64encode(b"abc").decode()
    texts = [
        {"batch_id": 1, "print_id": "p", "tile_id": 2, "layer": 3, "tif": tif, "more": [1]},
        {"batch_id": 3_000_000_000, "print_id": 7, "tile_id": "x", "tif": "!"},
        {},
    ]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts], "record string")
    found = [tuple(r) for r in typed_messages(df.coalesce(1), json="record").collect()]
    assert found[0] == (1, "p", 2, 3, bytearray(b"abc"))
    assert found[1][:4] == (None, "7", None, None)
    assert found[2] == (None,) * 5


def test_stored_messages(spark):
    path = fresh_path(spark, "test-messages")
    messages(spark, [b"x"] * 40).repartition(6).write.parquet(path)
    assert sorted(r.batch_id for r in read_messages(spark, path).collect()) == list(range(40))


def test_empty_tags_are_bad_payloads(spark):
    image = random_images(1, 1, 6, 5)[0]
    bad = [tiff(image, **{f"c{tag}": (3, 0, 1)}) for tag in (256, 257, 258, 259, 262, 273, 277, 278, 279)]
    decoded = decoded_messages(messages(spark, [tiff(image), None, *bad])).collect()
    reasons = {r.batch_id: r.reject_reason for r in decoded}
    assert reasons == {0: None, 1: "no_payload", **{i + 2: "bad_payload" for i in range(len(bad))}}
    assert all((r.temps is None) == (r.batch_id > 0) for r in decoded)


def test_sparse_images_are_packed_in_chunks():
    lists = pa.record_batch(
        {"n": pa.array([0, 1, 2]), "pos": pa.array([[3], [], [0, 1]], pa.list_(pa.int32())), "temp": pa.array([[7], [], [8, 9]], pa.list_(pa.int32()))}
    )
    out = list(pack_images(iter([lists]), 4, chunk_bytes=16))
    assert [b.num_rows for b in out] == [2, 1]
    images = [np.frombuffer(t.as_py(), "<u2").tolist() for b in out for t in b.column("temps")]
    assert images == [[0, 0, 0, 7], [0, 0, 0, 0], [8, 9, 0, 0]]


def test_tile_files(spark, tmp_path):
    image = random_images(3, 1, 4, 4)[0]
    folder = tmp_path / "print_id=a b" / "tile_id=3" / "layer=12"
    folder.mkdir(parents=True)
    (folder / "77.tif").write_bytes(tiff(image))
    row = read_tile_files(spark, str(tmp_path)).first()
    assert (row.batch_id, row.tile_id, row.layer, bytes(row.tif)) == (77, 3, 12, tiff(image))


def packbits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run]) + data[at : at + 1]
        else:
            while at + run < len(data) and run < 128 and data[at + run] != data[at + run - 1]:
                run += 1
            out += bytes([run - 1]) + data[at : at + run]
        at += run
    return out + b"\x80"


def lzw(data):
    """Codes of 9 to 12 bits, high bit first, a new table when one is full."""
    bits, table, word = "", None, b""
    width = lambda: min(12, max(9, (len(table) + 2).bit_length()))

    def clear():
        nonlocal bits, table
        bits += format(256, f"0{width() if table else 9}b")
        table = {bytes([i]): i for i in range(256)}

    clear()
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        bits += format(table[word], f"0{width()}b")
        table[longer] = len(table) + 2
        if len(table) >= 4092:
            clear()
        word = data[i : i + 1]
    if word:
        bits += format(table[word], f"0{width()}b")
        table[word + b"\0\0"] = len(table) + 2
    bits += format(257, f"0{width()}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


ENCODERS = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: packbits}


def image_file(image, compression, order="<", rows=7, tile=None, predictor=1):
    """A TIFF in strips of ``rows`` rows or tiles of ``tile`` (height, width)."""
    height, width = image.shape
    down, across = tile or (rows, width)
    if tile:
        image = np.pad(image, ((0, -height % down), (0, -width % across)))
    parts = []
    for y in range(0, height, down):
        for x in range(0, width, across):
            part = image[y : y + down, x : x + across].astype(np.uint16)
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint16(0)).astype(np.uint16)
            parts.append(ENCODERS[compression](part.astype(order + "u2").tobytes()))
    starts = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    tags = {256: [width], 257: [height], 258: [16], 259: [compression], 262: [1], 277: [1], 317: [predictor]}
    tags |= {322: [across], 323: [down], 324: starts, 325: [*map(len, parts)]} if tile else {273: starts, 278: [down], 279: [*map(len, parts)]}
    lists, entries, at = b"", b"", 8 + sum(map(len, parts))
    for tag, values in sorted(tags.items()):
        if len(values) == 1:
            entries += struct.pack(order + "HHII", tag, 4, 1, values[0])
        else:
            entries += struct.pack(order + "HHII", tag, 4, len(values), at + len(lists))
            lists += struct.pack(f"{order}{len(values)}I", *values)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(lists))
    return head + b"".join(parts) + lists + struct.pack(order + "H", len(tags)) + entries + bytes(4)


def test_lzw_of_the_format_description():
    """7 7 7 8 8 7 7 6 6 as clear, 7, 258, 8, 8, 258, 6, 6, end in nine bits each."""
    codes = (256, 7, 258, 8, 8, 258, 6, 6, 257)
    bits = "".join(format(c, "09b") for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert tiff_module.unpack_lzw(int(bits, 2).to_bytes(len(bits) // 8, "big"), 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", ENCODERS)
@pytest.mark.parametrize("tile", [None, (8, 16)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_compressed_and_tiled_images(compression, tile, predictor):
    for seed, image in enumerate([*random_images(7, 2, 22, 37), np.full((30, 20), 65535), np.arange(90 * 70).reshape(90, 70) * 37 % 65536]):
        for order in "<>":
            payload = image_file(image, compression, order, tile=tile, predictor=predictor)
            assert tiff_module.image_error(payload) is None
            width, height, samples = tiff_module.decode_image(payload)
            assert (np.frombuffer(samples, "<u2").reshape(height, width) == image).all()


def test_damaged_images_are_errors():
    """Cut and changed bytes give an image or a bad one, never another error."""
    rng, image = np.random.default_rng(5), random_images(9, 1, 25, 18)[0]
    for compression in ENCODERS:
        whole = image_file(image, compression, tile=(8, 16) if compression == 5 else None)
        bad = 0
        for turn in range(150):
            payload = bytearray(whole[: rng.integers(0, len(whole))] if turn % 2 else whole)
            for at in rng.integers(0, max(1, len(payload)), 3 if turn % 2 == 0 else 0):
                payload[at] = rng.integers(0, 256)
            error = tiff_module.image_error(bytes(payload))
            try:
                tiff_module.decode_image(bytes(payload))
                assert error is None
            except tiff_module.BadImage:
                assert error is not None
                bad += 1
        assert bad > 60
    huge = image_file(np.zeros((1, 1)), 8)
    at = huge.index(struct.pack("<HHII", 256, 4, 1, 1))
    assert tiff_module.image_error(huge[: at + 8] + struct.pack("<I", 1 << 31) + huge[at + 12 :]) == "pixels missing"


def test_compressed_messages(spark):
    images = random_images(11, 6, 20, 24)
    kinds = list(ENCODERS)
    rows = [(n, "p", 0, n, image_file(x, kinds[n % len(kinds)], tile=(16, 16) if n % 2 else None)) for n, x in enumerate(images)]
    rows.append((9, "p", 0, 9, rows[1][4][:-40]))
    decoded = decoded_messages(spark.createDataFrame(rows, MESSAGES)).collect()
    assert {r.batch_id: r.reject_reason for r in decoded} == {**dict.fromkeys(range(6)), 9: "bad_payload"}
    for r in decoded[:6]:
        assert (np.frombuffer(r.temps, "<u2").reshape(r.height, r.width) == images[r.batch_id]).all()
