"""Points within a distance of each other, found by equi-joins on grid cells.

``by`` names the columns that identify one image; points of different images
never meet. Points are distinct integer pixels, so a cell holds at most
side * side of them however many rows an image has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One image, by its place in its key's arrival order.
POINT_SET = ("print_id", "tile_id", "seq")


def cell_side(eps: float) -> int:
    """Side of the largest cell whose pixels all lie within ``eps`` of each other."""
    return math.floor(eps / math.sqrt(2)) + 1


def near_cells(side: int, eps: float) -> list[tuple[int, int]]:
    """Cell steps (in x, in y) that can hold a pixel within ``eps`` of a cell's pixels."""

    def gap(step: int) -> int:
        return 0 if step == 0 else (abs(step) - 1) * side + 1

    steps = range(-math.floor(eps) - 1, math.floor(eps) + 2)
    near = [s for s in steps if gap(s) <= eps]
    return [(i, j) for i in near for j in near if gap(i) ** 2 + gap(j) ** 2 <= eps * eps]


def in_cells(points: DataFrame, side: int, by: Sequence[str]) -> DataFrame:
    """Points with the grid cell (cx, cy) that holds them."""
    return points.selectExpr(
        *by,
        "x",
        "y",
        f"cast(floor(x / {side}) as int) as cx",
        f"cast(floor(y / {side}) as int) as cy",
    )


def spread(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows placed by cell, over all shuffle partitions.

    A cell is the finest unit, so a crowded image spreads over many tasks.
    The number is explicit, as later steps multiply the rows: by their size
    alone, few points would be merged into very few tasks.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, *by, "cx", "cy")


def explode_cells(df: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Repeat each row for every cell in ``steps`` from its own: ``to_cx, to_cy``."""
    moves = ", ".join(f"named_struct('i', {i}, 'j', {j})" for i, j in steps)
    return df.selectExpr("*", f"inline(array({moves}))").selectExpr(
        *df.columns, "cx + i as to_cx", "cy + j as to_cy"
    )


def squared_distance(x1: str, y1: str, x2: str, y2: str) -> Column:
    dx, dy = f"cast({x1} - {x2} as bigint)", f"cast({y1} - {y2} as bigint)"
    return F.expr(f"{dx} * {dx} + {dy} * {dy}")


def as_targets(cells: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    """Points renamed for the far side of a join on cells."""
    return cells.selectExpr(
        *by, "cx as to_cx", "cy as to_cy", "x as near_x", "y as near_y", *more
    )


def join_cells(probes: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join exploded rows with the points of the cells they look at.

    Always a sort-merge join: an exploded side is many times larger than its
    estimate, so it must not be broadcast by that. Targets that were spread
    by cell stay in place; only the exploded rows move.
    """
    return probes.join(targets.hint("merge"), [*by, "to_cx", "to_cy"])


def eps_join(points: DataFrame, eps: float, by: Sequence[str] = POINT_SET) -> DataFrame:
    """All ordered pairs of different points within ``eps``: x, y, near_x, near_y.

    The result itself has one row per pair; clustering does without it.
    """
    cells = in_cells(points, max(math.ceil(eps), 1), by)
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    probes = explode_cells(cells, around).drop("cx", "cy")
    targets = as_targets(cells, by)
    apart = squared_distance("x", "y", "near_x", "near_y")
    return (
        join_cells(probes, targets, by)
        .filter((apart <= eps * eps) & (apart > 0))
        .select(*by, "x", "y", "near_x", "near_y")
    )


def mark_core(
    points: DataFrame, eps: float, min_pts: int, by: Sequence[str] = POINT_SET
) -> DataFrame:
    """Each point with its cell (cx, cy) and whether it is a core point.

    A core point has at least ``min_pts`` other points within ``eps``. In a
    cell with more than ``min_pts`` points all are core, without any look at
    pairs; only the few points of other cells count their neighbours.

    Points shuffle once by cell; only those few move again, to each cell in
    reach.
    """
    side = cell_side(eps)
    cell = [*by, "cx", "cy"]
    placed = spread(in_cells(points, side, by), by)
    sized = placed.withColumn("in_cell", F.count(F.lit(1)).over(Window.partitionBy(*cell)))
    crowded = F.col("in_cell") > min_pts
    # A point always meets itself, so none is lost in the inner join.
    counted = (
        join_cells(
            explode_cells(sized.filter(~crowded), near_cells(side, eps)),
            as_targets(placed, by),
            by,
        )
        .filter(squared_distance("x", "y", "near_x", "near_y") <= eps * eps)
        .groupBy(*cell, "x", "y")
        .agg((F.count(F.lit(1)) - 1 >= min_pts).alias("is_core"))
    )
    return (
        sized.filter(crowded)
        .select(*cell, "x", "y", F.lit(True).alias("is_core"))
        .unionByName(counted)
    )
