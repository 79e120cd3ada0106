"""Checks on raw records before any image work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

END_MARKER_TILE = -1

# Values of ``reject_reason``.
NULL_RECORD = "null_record"
NO_TILE = "no_tile"
END_MARKER = "end_marker"
INCOMPLETE = "incomplete"
NO_PAYLOAD = "no_payload"
BAD_PAYLOAD = "bad_payload"


def is_tile_record() -> Column:
    """Neither without a tile nor the marker that ends a bounded stream."""
    return F.col("tile_id").isNotNull() & (F.col("tile_id") != END_MARKER_TILE)


def has_payload(payload: str = "tif") -> Column:
    return F.col(payload).isNotNull()


def mark_rejects(
    records: DataFrame, payload: str | None = "tif", payload_error: Column | None = None
) -> DataFrame:
    """Pass every record through, with ``reject_reason`` null for good ones.

    A record without a print is good; it needs its tile, layer and arrival
    number. A payload that is null for an error is bad, not missing.
    """
    all_null = F.lit(True)
    for name in records.columns:
        all_null &= F.col(name).isNull()
    reason = (
        F.when(all_null, NULL_RECORD)
        .when(F.col("tile_id").isNull(), NO_TILE)
        .when(F.col("tile_id") == END_MARKER_TILE, END_MARKER)
    )
    if payload is not None:
        missing = ~has_payload(payload)
        if payload_error is not None:
            missing &= payload_error.isNull()
        reason = reason.when(missing, NO_PAYLOAD)
    for name in ("batch_id", "layer"):
        if name in records.columns:
            reason = reason.when(F.col(name).isNull(), INCOMPLETE)
    if payload_error is not None:
        reason = reason.when(payload_error.isNotNull(), BAD_PAYLOAD)
    return records.withColumn("reject_reason", reason)


def split_valid(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, rejects with their reason)."""
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.filter(F.col("reject_reason").isNotNull())


def observe_rejects(marked: DataFrame, name: str = "records") -> tuple[DataFrame, Observation]:
    """Count records and rejects on the way, in the job that reads them."""
    seen = Observation(name)
    counted = marked.observe(
        seen,
        F.count(F.lit(1)).alias("records"),
        F.count("reject_reason").alias("rejects"),
    )
    return counted, seen
