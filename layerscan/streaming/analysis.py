"""The analysis as a stream: messages in, one result per tile image out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from layerscan.operators.bands import SCANNED
from layerscan.params import Params
from layerscan.plans.analyze import results_of
from layerscan.schema import FRAME, IMAGE
from layerscan.session import materialize, scratch
from layerscan.sources.messages import decoded_messages
from layerscan.streaming.sink import commit, read_table
from layerscan.streaming.window import BAND, DROP, LATE, PROCESS, REJECT, streaming_scan

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# How far event time may run behind its maximum, a layer being a millisecond.
MAX_LATENESS = "3 seconds"
MAX_LATE_LAYERS = 3000


def event_time(arrival_time: Column | None = None, first_ms: int = 0) -> Column:
    """A layer's number read as milliseconds from ``first_ms``, or the arrival time without one."""
    by_layer = F.timestamp_millis(F.col("layer").cast("bigint") + first_ms)
    return by_layer if arrival_time is None else F.coalesce(by_layer, arrival_time)


def with_layer_watermark(
    messages: DataFrame, arrival_time: Column | None = None, lateness: str = MAX_LATENESS, first_ms: int = 0
) -> DataFrame:
    """Event time and watermark, for ``closing`` and for user queries on the stream.

    A stream's watermark starts at 0 and drops what is not after it, so layer 0
    of a stream needs a ``first_ms`` above 0 where the watermark is used.
    """
    timed = messages.withColumn("event_time", event_time(arrival_time, first_ms))
    return timed.withWatermark("event_time", lateness)


def analyze_stream(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    params: Params = Params(),
    available_now: bool = True,
    late: str = PROCESS,
    lateness: int = MAX_LATE_LAYERS,
) -> StreamingQuery:
    """Start the analysis of a message stream; its tables go below ``out``.

    A micro-batch decodes each payload once and leaves four tables, visible
    together and replaced when it is replayed: ``results``, ``rejects``, ``late`` and
    ``counts`` of records by ``reject_reason`` (null: used). A record is late if its
    layer is more than ``lateness`` below the greatest of its key; ``late`` says
    whether such records count like others (``process``), go to the late table
    (``side``), or are only counted (``drop``). With ``available_now`` the query ends
    once the input present at its start is done, otherwise it runs on.
    """
    tagged = streaming_scan(decoded_messages(messages), params, late, lateness)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The stateful step runs once per micro-batch: what it gives is stored.
        with scratch(batch.sparkSession):
            stored = materialize(batch, "tagged")
            commit(batch.sparkSession, out, batch_id, tables_of(stored, params, late))

    return start_stateful(tagged, write, checkpoint, available_now)


def tables_of(tagged: DataFrame, params: Params, late: str = PROCESS) -> dict[str, DataFrame]:
    """Results, rejects, late records and counts from the tagged rows of a micro-batch."""
    of_kind = lambda kind: tagged.where(F.col("kind") == kind)
    scanned = of_kind(BAND).select(*FRAME, "band", "saturated", F.col("flagged").cast(SCANNED).alias("flagged"))
    # A used record has one band 0.
    one_each = tagged.where((F.col("kind") != BAND) | (F.col("band") == 0))
    apart = of_kind(LATE) if late != DROP else of_kind(LATE).limit(0)
    return {
        "results": results_of(scanned, params),
        "rejects": of_kind(REJECT).select(*IMAGE, "reject_reason"),
        "late": apart.select(*IMAGE),
        "counts": one_each.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("records")),
    }


def start_stateful(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Start ``write`` for each micro-batch of a stateful stream, with RocksDB as state store."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def read_results(spark: SparkSession, out: str, name: str = "results") -> DataFrame:
    """What a stream has written so far: ``results``, ``rejects``, ``late`` or ``counts``."""
    return read_table(spark, out, name)
