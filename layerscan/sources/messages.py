"""Raw tile messages: reading, typing, and the image payload.

A payload is a TIFF of one 16-bit grayscale band, see ``tiff``. Anything else
is a bad payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerscan.functions.packed import slices
from layerscan.operators.records import mark_rejects, split_valid
from layerscan.schema import MESSAGES
from layerscan.sources.tiff import DEFLATE, BadImage, decode_image, image_error, single_strip_header


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Stored messages."""
    return spark.read.schema(MESSAGES).parquet(path)


def stream_messages(
    spark: SparkSession, path: str, files_per_trigger: int = 64
) -> DataFrame:
    """Messages as they arrive as files in a folder."""
    return (
        spark.readStream.schema(MESSAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def read_tile_files(spark: SparkSession, path: str) -> DataFrame:
    """TIFF files laid out as ``print_id=*/tile_id=*/layer=*/<batch_id>.tif``.

    The plain file source keeps all 16 bits; the image source would not.
    """
    files = spark.read.format("binaryFile").load(f"{path}/print_id=*/tile_id=*/layer=*/*.tif")

    def part(pattern: str) -> Column:
        return F.regexp_extract(F.col("path"), pattern, 1)

    return files.select(
        part(r"([0-9]+)\.tif$").cast("int").alias("batch_id"),
        part(r"/print_id=([^/]+)/").alias("print_id"),
        part(r"/tile_id=(-?[0-9]+)/").cast("int").alias("tile_id"),
        part(r"/layer=([0-9]+)/").cast("int").alias("layer"),
        F.col("content").alias("tif"),
    )


def typed_messages(records: DataFrame, json: str | None = None) -> DataFrame:
    """Loosely typed records to the message schema.

    Values that do not fit, e.g. integers beyond 32 bits, become null, and
    the record checks then reject the record. ``json`` names a column of JSON
    text to read the fields from; its ``tif`` is base64 text.
    """
    if json is not None:
        loose = T.StructType(
            [T.StructField(f.name, T.StringType()) for f in MESSAGES.fields]
        )
        records = records.select(F.from_json(json, loose).alias("r")).select(
            *(F.col(f"r.{f.name}") for f in MESSAGES.fields if f.name != "tif"),
            F.try_to_binary(F.col("r.tif"), F.lit("base64")).alias("tif"),
        )
    return records.select(
        *(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in MESSAGES.fields)
    )


def check_messages(messages: DataFrame) -> DataFrame:
    """Every message with its ``reject_reason``, unreadable payloads included."""
    return mark_rejects(messages, payload_error=payload_error("tif"))


def payload_error(tif: str) -> Column:
    """Why a payload cannot be decoded; null if it can or if there is none."""

    def errors(payloads: pa.Array) -> pa.Array:
        return pa.array([image_error(p.as_buffer()) if p.is_valid else None for p in payloads])

    return F.arrow_udf(errors, T.StringType())(tif)


def decoded_messages(messages: DataFrame) -> DataFrame:
    """Every message with its image in place of its payload, and ``reject_reason``.

    Payloads are checked and decoded in one pass; rejects have no image.
    """
    kept = [f for f in messages.schema.fields if f.name != "tif"]
    schema = T.StructType(
        kept
        + [
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("temps", T.BinaryType()),
            T.StructField("payload_error", T.StringType()),
        ]
    )
    decoded = messages.select(*(f.name for f in kept), "tif").mapInArrow(_decode_batches, schema)
    return mark_rejects(decoded, "temps", F.col("payload_error")).drop("payload_error")


def decode_frames(messages: DataFrame) -> DataFrame:
    """Packed frames of the messages that are not rejects."""
    return split_valid(decoded_messages(messages))[0]


def encode_frames(frames: DataFrame, deflate: bool = False) -> DataFrame:
    """Packed frames as messages, the inverse of decoding; for replays.

    With ``deflate`` payloads are compressed.
    """
    if deflate:

        def payloads(widths: pa.Array, heights: pa.Array, temps: pa.Array) -> pa.Array:
            packed = [zlib.compress(t.as_buffer()) for t in temps]
            sizes = zip(widths.to_pylist(), heights.to_pylist(), packed)
            return pa.array([single_strip_header(w, h, DEFLATE, len(p)) + p for w, h, p in sizes], pa.binary())

        tif = F.arrow_udf(payloads, T.BinaryType())("width", "height", "temps")
        return frames.select("batch_id", "print_id", "tile_id", "layer", tif.alias("tif"))

    def headers(widths: pa.Array, heights: pa.Array) -> pa.Array:
        sizes = zip(widths.to_pylist(), heights.to_pylist())
        return pa.array([single_strip_header(w, h) for w, h in sizes], pa.binary())

    header = F.arrow_udf(headers, T.BinaryType())("width", "height")
    return frames.select(
        "batch_id", "print_id", "tile_id", "layer", F.concat(header, "temps").alias("tif")
    )


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        meta = batch.select([n for n in batch.schema.names if n != "tif"])
        decoded = [_decoded(p.as_buffer() if p.is_valid else None) for p in batch.column("tif")]
        widths, heights, temps, errors = zip(*decoded) if decoded else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                *meta.columns,
                pa.array(widths, pa.int32()),
                pa.array(heights, pa.int32()),
                pa.array(temps, pa.binary()),
                pa.array(errors, pa.string()),
            ],
            names=[*meta.schema.names, "width", "height", "temps", "payload_error"],
        )


def _decoded(payload: pa.Buffer | None) -> tuple:
    """Width, height and samples, and the error if there is one."""
    if payload is None:
        return None, None, None, None
    try:
        return *decode_image(payload), None
    except BadImage as problem:
        return None, None, None, str(problem)
