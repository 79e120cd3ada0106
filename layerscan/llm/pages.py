"""Main text of pages by differencing with the page of the nearest URL.

Pages are sorted by host and path; each is compared with that neighbour of its
host whose path has the longer prefix in common. Lines that a longest common
subsequence aligns belong to the site, not to the page, and go. Only hashes of
lines are sorted and compared; the text is made where the page is read.

Every page is compared, and the comparison decides on every block that markup
does not settle: furniture, notices, adverts, forms, scripts and reader comments
never stay, and blocks inside an ``article`` or ``main`` element do even if a
neighbour has a copy of them. Two pages that share all they have are copies of
each other, which says nothing about the site: the other neighbour is taken.
"""

from __future__ import annotations

import os.path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerscan.llm.html import DROPPED, MAIN, blocks, common_lines
from layerscan.llm.urls import host_of, path_of
from layerscan.session import materialize

LINES = "page_id long, host string, path string, mark long, lines binary"


def _mark():
    """Tells rows of one page id apart."""
    return F.xxhash64("url", "html")


def _lines(batches):
    for batch in batches:
        lines = []
        for page in batch.column("html"):
            found = blocks(page.as_py() or "")
            lines.append(np.array([xxhash.xxh64_intdigest(t) for t, _ in found], np.uint64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "host", "path", "mark")), pa.array(lines, pa.binary())],
            names=["page_id", "host", "path", "mark", "lines"],
        )


def _with_neighbours(pages: DataFrame) -> DataFrame:
    """Hashed lines of each page, with the pages before and after it in order of host and path."""
    order = ("host", "path", "page_id", "mark")
    hashed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _mark().alias("mark"), "html")
    # Written first, as finding the ranges reads the rows once more.
    hashed = materialize(hashed.mapInArrow(_lines, LINES), "hashed")
    ranged = materialize(hashed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "lines")
    page = F.struct("host", "path", "lines")
    within = Window.partitionBy("part").orderBy(*order)
    near = ranged.withColumn("before", F.lag(page).over(within)).withColumn("after", F.lead(page).over(within))
    # The first and last page of each part meet those of the parts beside it: a row per part.
    key = F.struct(*order)
    ends = ranged.groupBy("part").agg(F.min_by(page, key).alias("first"), F.max_by(page, key).alias("last"))
    parts = Window.orderBy("part")
    ends = ends.select(
        "part", F.lag("last").over(parts).alias("last_before"), F.lead("first").over(parts).alias("first_after")
    )
    return near.join(ends, "part").select(
        *order, "lines",
        F.coalesce("before", "last_before").alias("before"), F.coalesce("after", "first_after").alias("after"),
    )


def shared_lines(pages: DataFrame) -> DataFrame:
    """Places of the lines of each page that its nearest page shares, where any count."""

    def run(batches):
        for batch in batches:
            keep, places = [], []
            for i, row in enumerate(batch.select(["host", "path", "lines", "before", "after"]).to_pylist()):
                if not row["host"]:
                    continue
                best = None
                for other in (row["before"], row["after"]):
                    if other and other["host"] == row["host"] and other["lines"] != row["lines"]:
                        length = len(os.path.commonprefix([other["path"], row["path"]]))
                        if best is None or length > best[0]:
                            best = (length, other["lines"])
                if best is None:
                    continue
                mine, theirs = (np.frombuffer(x, np.uint64).tolist() for x in (row["lines"], best[1]))
                shared = common_lines(mine, theirs)
                if shared:
                    keep.append(i)
                    places.append(np.array(shared, np.int32).tobytes())
            part = batch.select(["page_id", "mark"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places, pa.binary())], names=["page_id", "mark", "shared"])

    near = _with_neighbours(pages)
    return near.mapInArrow(run, "page_id long, mark long, shared binary").groupBy("page_id", "mark").agg(F.min("shared").alias("shared"))


def main_text(page: str, shared: bytes | None) -> str:
    """Blocks of the main text joined by empty lines: those that are not shared, and all of an article."""
    gone = set(np.frombuffer(shared or b"", np.int32).tolist())
    return "\n\n".join(t for i, (t, k) in enumerate(blocks(page)) if k == MAIN or (k != DROPPED and i not in gone))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and main ``text`` of each row of ``pages``.

    A null or empty html has the empty text. A page without host, or alone on
    its host, is compared with none. Rows without an id are as good as others.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", shared) for page, shared in zip(*(batch.column(c).to_pylist() for c in ("html", "shared")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    shared = materialize(shared_lines(pages), "shared").toDF("other_id", "other_mark", "shared")
    rows = pages.select("page_id", "url", "html", _mark().alias("mark"))
    same = F.col("page_id").eqNullSafe(F.col("other_id")) & (F.col("mark") == F.col("other_mark"))
    return rows.join(shared, same, "left").select("page_id", "url", "html", "shared").mapInArrow(run, "page_id long, url string, text string")


def page_report(pages: DataFrame) -> DataFrame:
    """``op4``: main text and its length of each page."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
