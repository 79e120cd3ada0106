"""Session helpers: recommended settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "layerscan") -> SparkSession:
    """A session for tests and benches on one machine."""
    parallelism = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Call-site capture makes building large plans slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only by a local master that
    names none.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="layerscan-")
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/layerscan/{name}-{uuid.uuid4().hex}"


#: Paths of intermediate tables of the ``scratch`` block that is open in this thread.
_open_block: ContextVar[list[str] | None] = ContextVar("open_block", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes inside the block, at its end.

    Results must be written before the block ends. A block is of its thread
    alone; of nested blocks the inner one deletes its own tables.
    """
    paths: list[str] = []
    outer = _open_block.set(paths)
    try:
        yield
    finally:
        _open_block.reset(outer)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage without tying data to an executor, and the reader gets
    column pruning and true sizes for its join choices.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    block = _open_block.get()
    if block is not None:
        block.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
