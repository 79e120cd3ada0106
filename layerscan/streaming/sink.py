"""Tables that a stream writes by micro-batch, and that readers see whole.

A micro-batch writes a folder of its own, new at each attempt, and then puts
its name into the micro-batch's entry of the manifest by one rename. Readers go
by the manifest, so of a micro-batch that is replayed they see the old attempt or
the new one, never both and never a part. ``compact`` merges small folders in the
same way, and ``vacuum`` deletes what no entry names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

MERGED = "merged"


class _Files:
    """The few file operations of the manifest, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.fs.makeQualified(self.path(root)).toUri(), spark._jsc.hadoopConfiguration()
        )
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Put a file in place by one rename, so that readers see the old or the new one."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.context.rename(self.path(draft), self.path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _entries(files: _Files, out: str) -> dict[str, dict]:
    """Manifest entries in force, by name; what a merge covers no longer counts."""
    names = [n.removesuffix(".json") for n in files.names(f"{out}/manifest") if n.endswith(".json")]
    # The merge is read first: an entry that it came to cover meanwhile is skipped, not read twice.
    found = {MERGED: json.loads(files.read(f"{out}/manifest/{MERGED}.json"))} if MERGED in names else {}
    upto = found[MERGED]["upto"] if found else -1
    for name in names:
        if name != MERGED and int(name) > upto:
            found[name] = json.loads(files.read(f"{out}/manifest/{name}.json"))
    return found


def commit(spark: SparkSession, out: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a micro-batch and make them visible together."""
    folder = f"data/{batch_id}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{out}/{folder}/{name}")
    entry = {"folder": folder, "tables": sorted(tables)}
    _Files(spark, out).replace(f"{out}/manifest/{batch_id}.json", json.dumps(entry))


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table as far as finished micro-batches go."""
    entries = _entries(_Files(spark, out), out).values()
    paths = [f"{out}/{e['folder']}/{name}" for e in entries if name in e["tables"]]
    if not paths:
        raise ValueError(f"no finished micro-batch has written {name!r} to {out}")
    return spark.read.parquet(*paths)


def compact(spark: SparkSession, out: str, files_per_table: int = 1) -> int:
    """Merge all finished micro-batches but the newest, which may still be replayed.

    Returns the number of entries merged. Old folders stay for readers at work
    until ``vacuum``.
    """
    files = _Files(spark, out)
    entries = _entries(files, out)
    batches = sorted(int(n) for n in entries if n != MERGED)[:-1]
    if not batches:
        return 0
    merged = [entries[n] for n in ([MERGED] if MERGED in entries else []) + [str(b) for b in batches]]
    folder = f"data/{MERGED}-{uuid.uuid4().hex}"
    tables = sorted({t for e in merged for t in e["tables"]})
    for name in tables:
        paths = [f"{out}/{e['folder']}/{name}" for e in merged if name in e["tables"]]
        spark.read.parquet(*paths).repartition(files_per_table).write.parquet(f"{out}/{folder}/{name}")
    entry = {"folder": folder, "tables": tables, "upto": batches[-1]}
    files.replace(f"{out}/manifest/{MERGED}.json", json.dumps(entry))
    return len(merged)


def vacuum(spark: SparkSession, out: str, keep: Iterable[str] = ()) -> list[str]:
    """Delete the data folders that no entry names; for when no reader of old ones is at work
    and no micro-batch is being written. ``keep`` names folders to leave."""
    files = _Files(spark, out)
    entries = _entries(files, out)
    used = {e["folder"].removeprefix("data/") for e in entries.values()} | set(keep)
    gone = [n for n in files.names(f"{out}/data") if n not in used]
    for name in gone:
        files.delete(f"{out}/data/{name}")
    for name in files.names(f"{out}/manifest"):
        if name.endswith(".json") and name.removesuffix(".json") not in entries:
            files.delete(f"{out}/manifest/{name}")
    return gone
