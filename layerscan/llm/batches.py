"""Jobs whose Arrow batches hold few rows, for rows that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame

from layerscan.session import materialize

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize_in_small_batches(df: DataFrame, name: str, rows: int = 256) -> DataFrame:
    """``materialize`` with at most ``rows`` rows in each batch sent to Python."""
    conf = df.sparkSession.conf
    before = conf.get(KEY)
    conf.set(KEY, str(rows))
    try:
        return materialize(df, name)
    finally:
        conf.set(KEY, before)
