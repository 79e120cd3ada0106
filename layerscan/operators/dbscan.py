"""Density clustering of the flagged pixels of every image at once.

Core points of one cell are all within ``eps`` of each other, so the graph to
connect has one node per cell. Two cells are connected if some core point of
one is near some core point of the other; the outermost points of each row
(or column) of the cells decide that. A cell therefore travels as one row
with at most ``side`` entries, however crowded it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.functions.pixel import point_id
from layerscan.operators.components import component_labels
from layerscan.operators.neighbours import (
    POINT_SET,
    as_targets,
    cell_side,
    explode_cells,
    join_cells,
    mark_core,
    near_cells,
    spread,
    squared_distance,
)
from layerscan.params import Params
from layerscan.session import materialize


def dbscan(
    points: DataFrame, params: Params = Params(), by: Sequence[str] = POINT_SET
) -> DataFrame:
    """``(by, x, y, cluster_id, is_core)`` of all points that are not noise.

    A cluster's id is the smallest row-major number of its core points. A
    border point near several clusters joins the one with the smallest id.
    Runs jobs: intermediate tables go to the shared folder.
    """
    eps, by = params.dbscan_eps, list(by)
    marked = materialize(mark_core(points, eps, params.dbscan_min_pts, by), "marked")
    core = spread(marked.filter("is_core"), by)
    cells = materialize(cell_lines(core, by), "cells")
    labels = component_labels(cell_edges(cells, params, by), by)
    clusters = (
        cells.select(*by, "cx", "cy", "node")
        .join(labels, [*by, "node"], "left")
        .select(*by, "cx", "cy", F.coalesce("label", "node").alias("cluster_id"))
    )
    core = materialize(core.join(clusters, [*by, "cx", "cy"]), "core")
    border = border_clusters(marked.filter(~F.col("is_core")), core, eps, by)
    columns = [*by, "x", "y", "cluster_id", "is_core"]
    return core.select(*columns).unionByName(border.select(*columns))


def cell_lines(core: DataFrame, by: Sequence[str] = POINT_SET) -> DataFrame:
    """One row per cell with core points.

    ``node`` is its smallest core point; ``rows`` and ``columns`` list, for
    each row or column of the cell, the first and the last core point.
    """
    cell = [*by, "cx", "cy"]

    def lines(line: str, along: str) -> DataFrame:
        ends = core.groupBy(*cell, line).agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
        return ends.groupBy(*cell)

    entry = F.struct(F.col("y").alias("at"), "lo", "hi")
    rows = lines("y", "x").agg(
        F.collect_list(entry).alias("rows"),
        F.min(point_id(F.col("lo"), F.col("y"))).alias("node"),
    )
    entry = F.struct(F.col("x").alias("at"), "lo", "hi")
    columns = lines("x", "y").agg(F.collect_list(entry).alias("columns"))
    return rows.join(columns.hint("merge"), cell)


def cell_edges(cells: DataFrame, params: Params, by: Sequence[str] = POINT_SET) -> DataFrame:
    """Connected pairs of cells, each pair once, named by their ``node``.

    A cell looks at those to its right, comparing last with first points of
    rows, and at those straight below, doing the same with columns.
    """
    eps, side = params.dbscan_eps, params.block_cells
    ahead = [(i, j) for i, j in near_cells(cell_side(eps), eps) if i > 0 or (i == 0 and j > 0)]
    block = f"shiftleft(floor(cy / {side}), 32) + floor(cx / {side})"
    a = explode_cells(cells, ahead).selectExpr(
        *by,
        "to_cx",
        "to_cy",
        "to_cx > cx as beside",
        "node as a",
        f"{block} as a_block",
        "if(to_cx > cx, rows, columns) as a_lines",
    )
    b = cells.selectExpr(
        *by,
        "cx as to_cx",
        "cy as to_cy",
        "node as b",
        f"{block} as b_block",
        "rows as b_rows",
        "columns as b_columns",
    )
    between, along = "cast(p.at - q.at as bigint)", "cast(q.lo - p.hi as bigint)"
    meet = f"{between} * {between} + {along} * {along} <= {eps * eps}"
    touching = f"exists(a_lines, p -> exists(if(beside, b_rows, b_columns), q -> {meet}))"
    return join_cells(a, b, by).filter(touching).select(*by, "a", "b", "a_block", "b_block")


def border_clusters(
    others: DataFrame, core: DataFrame, eps: float, by: Sequence[str] = POINT_SET
) -> DataFrame:
    """Non-core points near a core point, with the smallest cluster in reach.

    Non-core points sit in cells with few points, so few rows are expanded.
    """
    return (
        join_cells(
            explode_cells(others, near_cells(cell_side(eps), eps)),
            as_targets(spread(core, by), by, "cluster_id"),
            by,
        )
        .filter(squared_distance("x", "y", "near_x", "near_y") <= eps * eps)
        .groupBy(*by, "x", "y")
        .agg(F.min("cluster_id").alias("cluster_id"))
        .withColumn("is_core", F.lit(False))
    )
