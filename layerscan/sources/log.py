"""A log of messages that is pulled by record number, as a batch and as a stream.

A log is a folder of Parquet segments whose names hold the number of their first
record and how many they have, so positions are known without opening a file.
A stream's offset is a record number: it can stop in the middle of a segment and
go on there, and a range of offsets always gives the same records. The end of a
bounded run is told by an end marker, a record of its own.

``limit`` ends the run after exactly so many records (0: no limit), and
``per_batch`` bounds a micro-batch, except the first one after a restart, which
takes what is there. Files are read by the executors through Arrow, so the folder
must be one that Arrow opens: a path that all machines share, or a URI it knows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from layerscan.operators.records import END_MARKER_TILE
from layerscan.schema import MESSAGES

FORMAT = "message_log"
SEGMENT = re.compile(r"segment-(\d{20})-(\d+)\.parquet")
#: Written once no more segments come.
ENDED = "_ENDED"
#: Records of a partition, and of an Arrow batch.
PART_ROWS, BATCH_ROWS = 4096, 64

ARROW = pa.schema(
    [("batch_id", pa.int32()), ("print_id", pa.string()), ("tile_id", pa.int32()), ("layer", pa.int32()), ("tif", pa.binary())]
)


class Segment(NamedTuple):
    first: int
    count: int
    path: str


class Range(InputPartition):
    """Rows ``start`` to ``stop`` of a segment."""

    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class EndMarker(InputPartition):
    def __init__(self) -> None:
        pass


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def segments(path: str) -> tuple[list[Segment], bool]:
    """All segments by record number, up to the first gap, and whether the log is complete."""
    system, root = _opened(path)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    found = sorted(Segment(int(m[1]), int(m[2]), f"{path}/{m[0]}") for m in map(SEGMENT.fullmatch, names) if m)
    whole, at = [], 0
    for segment in found:
        if segment.first != at:
            break
        whole.append(segment)
        at += segment.count
    return whole, ENDED in names


def ranges(path: str, start: int, stop: int) -> list[Range]:
    """Partitions of the records ``start`` to ``stop`` of a log."""
    out = []
    for first, count, name in segments(path)[0]:
        low, high = max(start, first), min(stop, first + count)
        out += [Range(name, at - first, min(at + PART_ROWS, high) - first) for at in range(low, high, PART_ROWS)]
    return out


def read_part(part: InputPartition) -> Iterator[pa.RecordBatch]:
    """Records of a partition; of a segment only the row groups in range are read."""
    if isinstance(part, EndMarker):
        yield pa.RecordBatch.from_pylist([{"batch_id": -1, "print_id": "END", "tile_id": END_MARKER_TILE}], schema=ARROW)
        return
    system, name = _opened(part.path)
    with system.open_input_file(name) as file:
        table = pq.ParquetFile(file)
        at = 0
        for group in range(table.num_row_groups):
            rows = table.metadata.row_group(group).num_rows
            if at < part.stop and at + rows > part.start:
                begin = at
                for batch in table.iter_batches(BATCH_ROWS, row_groups=[group], columns=ARROW.names):
                    low, high = max(part.start - begin, 0), min(part.stop - begin, batch.num_rows)
                    begin += batch.num_rows
                    if low < high:
                        yield batch.slice(low, high - low).cast(ARROW)
            at += rows


class MessageLog(DataSource):
    """The format ``message_log``; options ``path``, ``limit`` and ``per_batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStream(self.options)


class LogReader(DataSourceReader):
    """All records that the log has now, up to the limit, without an end marker."""

    def __init__(self, options: dict) -> None:
        self.path, self.limit = options["path"], int(options.get("limit", 0))

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(self.path, 0, self.limit or 1 << 62)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_part(partition)


class LogStream(DataSourceStreamReader):
    """Pulls records by number until the log ends or the limit is reached, then the end marker."""

    def __init__(self, options: dict) -> None:
        self.path, self.limit = options["path"], int(options.get("limit", 0))
        self.per_batch = int(options.get("per_batch", 0))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        self.at = 0
        return {"record": 0, "ended": False}

    def latestOffset(self) -> dict:
        found, complete = segments(self.path)
        total = found[-1].first + found[-1].count if found else 0
        last = min(total, self.limit) if self.limit else total
        at = last
        if self.per_batch and self.at is not None:
            at = min(last, self.at + self.per_batch)
        ended = at == last and (complete and last == total or bool(self.limit) and last == self.limit)
        return {"record": at, "ended": ended}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end["record"]
        out: list[InputPartition] = list(ranges(self.path, start["record"], end["record"]))
        return out + [EndMarker()] if end["ended"] and not start["ended"] else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_part(partition)


def read_log(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The records of a log, up to ``limit``."""
    spark.dataSource.register(MessageLog)
    return spark.read.format(FORMAT).option("path", path).option("limit", limit).load()


def stream_log(spark: SparkSession, path: str, limit: int = 0, per_batch: int = 0) -> DataFrame:
    """The records of a log as a stream."""
    spark.dataSource.register(MessageLog)
    options = {"path": path, "limit": str(limit), "per_batch": str(per_batch)}
    return spark.readStream.format(FORMAT).options(**options).load()


def append_log(messages: DataFrame, path: str, end: bool = False) -> int:
    """Append the rows of ``messages``, a segment per partition; returns the log's length.

    For one writer at a time. Segments appear one by one, in order, by renaming;
    an attempt that is lost leaves a draft that no reader sees.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(path)
        system.create_dir(f"{root}/drafts", recursive=True)
        name, count = f"{uuid.uuid4().hex}.parquet", 0
        with system.open_output_stream(f"{root}/drafts/{name}") as file, pq.ParquetWriter(file, ARROW) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(ARROW))
                count += batch.num_rows
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "n": [count]})

    rows = messages.select(*ARROW.names).mapInArrow(write, "part long, name string, n long").collect()
    system, root = _opened(path)
    system.create_dir(root, recursive=True)
    found, _ = segments(path)
    at = found[-1].first + found[-1].count if found else 0
    for _, name, count in sorted(rows):
        if count:
            system.move(f"{root}/drafts/{name}", f"{root}/segment-{at:020d}-{count}.parquet")
            at += count
    if end:
        with system.open_output_stream(f"{root}/{ENDED}"):
            pass
    return at
