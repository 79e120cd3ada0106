"""Connected components of many small or large graphs at once.

Edges inside a block of cells are merged in one grouped pass; a block's size
is fixed, so a group is bounded however large an image is. Edges between
blocks, on a graph contracted to one node per merged part, are merged by
rounds of distributed contraction. Images within one block need no round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.session import materialize


def component_labels(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, node, label)`` for every node that has an edge.

    ``edges`` holds ``a, b`` and the block of each end, ``a_block`` and
    ``b_block``. ``label`` is the smallest node of the component.
    """
    by = list(by)
    edges = materialize(edges, "edges")
    crossing = F.col("a_block") != F.col("b_block")
    local = _labels_in_blocks(edges.filter(~crossing), by)
    if edges.filter(crossing).isEmpty():
        return local

    local = materialize(local, "local-labels")
    between = edges.filter(crossing).select(*by, "a", "b")
    merged = _labels_by_contraction(_renamed(between, local, by), by)
    ends = between.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = (
        ends.join(local, [*by, "node"], "left_anti")
        .withColumn("label", F.col("node"))
        .unionByName(local)
    )
    top = merged.select(*by, F.col("node").alias("label"), F.col("label").alias("top"))
    return nodes.join(top, [*by, "label"], "left").select(
        *by, "node", F.coalesce("top", "label").alias("label")
    )


def _labels_in_blocks(edges: DataFrame, by: list[str]) -> DataFrame:
    """Labels from the edges inside each block; ``a_block`` is the block of both ends.

    A task reads its blocks in order and labels all blocks of a batch in one
    go. It holds one Arrow batch and the edges of one block.
    """
    key = [*by, "a_block"]
    grouped = edges.select(*key, "a", "b").repartition(*(F.col(c) for c in key))
    schema = edges.select(*by, F.col("a").alias("node"), F.col("b").alias("label")).schema
    n_keys = len(key)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, n_keys):
            starts = group_starts(table, n_keys)
            group = np.zeros(len(table), np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            of, nodes, labels = smallest_reachable(group, a, b)
            keys = [table.column(n).take(pa.array(starts[of])) for n in by]
            out = pa.table([*keys, pa.array(nodes), pa.array(labels)], names=schema.names)
            yield from out.combine_chunks().to_batches()

    return grouped.sortWithinPartitions(*key).mapInArrow(label, schema)


def group_starts(table: pa.Table, n_keys: int) -> np.ndarray:
    """First row of every run of equal values in the first ``n_keys`` columns."""
    changed = np.zeros(len(table), bool)
    changed[:1] = True
    for column in table.columns[:n_keys]:
        differs = pc.not_equal(column.slice(1), column.slice(0, len(table) - 1))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no group is split between two tables."""
    rest: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if len(table) == 0:
            continue
        edge = pa.concat_tables([t.slice(len(t) - 1) for t in rest[-1:]] + [table])
        starts = group_starts(edge.combine_chunks(), n_keys)[1:] - len(rest[-1:])
        if len(starts) == 0:
            rest.append(table)
            continue
        yield pa.concat_tables([*rest, table.slice(0, starts[-1])]).combine_chunks()
        rest = [table.slice(starts[-1])]
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def smallest_reachable(
    group: np.ndarray, a: np.ndarray, b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, node and smallest connected node, for each node of some edge lists.

    ``a[i]`` and ``b[i]`` are connected within ``group[i]``.
    """
    ends = np.stack((np.tile(group, 2), np.concatenate((a, b))), axis=1)
    order = np.lexsort((ends[:, 1], ends[:, 0]))
    new = np.ones(len(ends), bool)
    new[1:] = (ends[order][1:] != ends[order][:-1]).any(axis=1)
    place = np.empty(len(ends), np.int64)
    place[order] = np.cumsum(new) - 1
    of, nodes = ends[order][new].T
    left, right = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        lower = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, before[left], lower)
        np.minimum.at(label, before[right], lower)
        label = label[label]
        if np.array_equal(label, before):
            return of, nodes, nodes[label]


def _renamed(edges: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Edges between the named parts; edges inside a part vanish."""
    for end in ("a", "b"):
        name = names.select(
            *by, F.col("node").alias(end), F.col("label").alias(f"{end}_name")
        )
        edges = edges.join(name, [*by, end], "left").withColumn(
            end, F.coalesce(f"{end}_name", end)
        ).drop(f"{end}_name")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.select(*by, low.alias("a"), high.alias("b")).filter("a < b").distinct()


def _labels_by_contraction(edges: DataFrame, by: list[str]) -> DataFrame:
    """``(by, node, label)`` by merging each node into a neighbour, in rounds.

    A node joins the neighbour (or itself) that a hash, new in each round,
    puts first. About half of the nodes vanish per round, chains included.
    """
    edges = materialize(edges, "contracted-edges")
    ends = edges.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct()
    names = ends.withColumn("label", F.col("node"))
    turn = 0
    while not edges.isEmpty():

        def ranked(node: str):
            return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), F.col(node).alias("id"))

        both = edges.unionByName(edges.select(*by, F.col("a").alias("b"), F.col("b").alias("a")))
        choice = both.groupBy(*by, "a").agg(F.min(ranked("b")).alias("first"))
        choice = materialize(
            choice.select(
                *by,
                F.col("a").alias("node"),
                F.least("first", ranked("a"))["id"].alias("label"),
            ),
            "choice",
        )
        edges = materialize(_renamed(edges, choice, by), "contracted-edges")
        step = choice.select(*by, F.col("node").alias("label"), F.col("label").alias("next"))
        names = materialize(
            names.join(step, [*by, "label"], "left").select(
                *by, "node", F.coalesce("next", "label").alias("label")
            ),
            "names",
        )
        turn += 1
    smallest = names.groupBy(*by, "label").agg(F.min("node").alias("smallest"))
    return names.join(smallest, [*by, "label"]).select(
        *by, "node", F.col("smallest").alias("label")
    )
