"""Arrival order and the count-based window over the layers of a key.

A key (one tile of one print) may hold a large share of all frames, so no
step here groups by the key alone: numbering works on buckets of arrival
numbers, and windows on chunks of consecutive layers that carry a copy of
the few layers before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerscan.params import Params


def image_digest() -> Column:
    """Orders records of one arrival number by what they hold."""
    return F.md5("temps")


def arrival_seq(
    df: DataFrame,
    params: Params = Params(),
    *,
    order_cols: Sequence[str] = ("batch_id", "layer"),
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``seq``, the 1-based arrival position of a row in its key.

    Rows are numbered inside buckets of neighbouring arrival numbers; a
    running sum over the buckets' row counts gives each bucket its offset.
    ``bucket`` must grow with ``order_cols``; the default suits ``batch_id``.
    Rows without a key form a key of their own, rows without an order number
    come first: none is lost. Images of one order number go by their digest.
    """
    keys = list(params.key_cols)
    if bucket is None:
        bucket = F.floor(F.col("batch_id") / params.bucket_frames)
    bucketed = df.withColumn("bucket", bucket)

    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        bucketed.groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("bucket_rows"))
        .select(
            *(F.col(c).alias(f"offset_{c}") for c in (*keys, "bucket")),
            F.coalesce(F.sum("bucket_rows").over(earlier), F.lit(0)).alias("offset"),
        )
    )
    ties = [image_digest()] if "temps" in df.columns else []
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy(*order_cols, *ties)
    same = F.lit(True)
    for c in (*keys, "bucket"):
        same &= F.col(c).eqNullSafe(F.col(f"offset_{c}"))
    # Images may stand in these rows, and no estimate knows their size.
    return (
        bucketed.withColumn("place", F.row_number().over(in_bucket))
        .join(offsets.hint("merge"), same)
        .select(*df.columns, (F.col("place") + F.col("offset")).cast("int").alias("seq"))
    )


def layer_chunks(params: Params = Params()) -> Column:
    """Chunks that need the row: its own, and the next one if the row is
    among the last ``history`` layers before it."""
    own = F.floor((F.col("seq") - 1) / params.chunk_layers)
    newest_reached = F.floor((F.col("seq") - 1 + params.history) / params.chunk_layers)
    return F.sequence(own, newest_reached)


def layer_window(
    df: DataFrame,
    values: Sequence[str],
    params: Params = Params(),
    *,
    within: Sequence[str] = (),
) -> DataFrame:
    """The last ``window_size`` arrivals of a key, next to the newest one.

    Adds ``earlier_1 .. earlier_n``: structs of ``values`` 1 .. n arrivals
    back. A missing row, e.g. a pixel outside a smaller image, gives null: the
    sequence number is compared, so an older layer never takes its place.
    ``within`` refines the key, e.g. to a pixel or a band of rows.
    """
    window = Window.partitionBy(*params.key_cols, *within, "chunk").orderBy("seq")
    steps = range(1, params.history + 1)
    others = [c for c in df.columns if c not in values]
    # The values travel once, inside the struct that the window looks back at.
    chunked = df.select(
        *others,
        F.explode(layer_chunks(params)).alias("chunk"),
        F.struct("seq", F.struct(*values).alias("held")).alias("arrival"),
    ).select("*", *(F.lag("arrival", n).over(window).alias(f"lag_{n}") for n in steps))

    def arrivals_back(n: int) -> Column:
        # The row n arrivals back is at most n rows back.
        candidates = (
            F.when(F.col(f"lag_{m}.seq") == F.col("seq") - n, F.col(f"lag_{m}.held"))
            for m in range(1, n + 1)
        )
        return F.coalesce(*candidates).alias(f"earlier_{n}")

    own = F.col("chunk") == F.floor((F.col("seq") - 1) / params.chunk_layers)
    return chunked.filter(own).select(
        *others, "arrival.held.*", *(arrivals_back(n) for n in steps)
    )


def has_full_window(params: Params = Params()) -> Column:
    """Centroids are reported only once the window is full."""
    return F.col("seq") >= params.window_size
