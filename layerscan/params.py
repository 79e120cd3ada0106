"""Tunable parameters of the defect analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Thresholds of the analysis and the layout knobs of its Spark jobs.

    The defaults of the first block are fixed values: results depend on them.
    The second block only shapes partitions and never changes a result.
    """

    # Fixed values.
    empty_thresh: int = 5000
    saturation_thresh: int = 65000
    distance_factor: int = 2
    outlier_thresh: float = 6000.0
    dbscan_eps: float = 20.0
    dbscan_min_pts: int = 5
    window_size: int = 3
    top_k: int = 10
    key_cols: tuple[str, ...] = ("print_id", "tile_id")

    # Layout.
    bucket_frames: int = 256  # arrival numbers per numbering bucket
    chunk_layers: int = 64  # layers per window chunk
    band_rows: int = 128  # image rows per band
    block_cells: int = 64  # cluster cells per block side
    stream_slots: int = 4  # state keys per tile in a stream
    stream_held_bytes: int = 32 << 20  # bands of a slot's micro-batch held in memory

    @property
    def reach(self) -> int:
        """Largest stencil distance in pixels."""
        return 2 * self.distance_factor

    @property
    def history(self) -> int:
        """Earlier layers a full window holds besides the newest one."""
        return self.window_size - 1

    def stencil_radii(self) -> list[tuple[int, int, int]]:
        """(layers back, close radius, outer radius); radius -1 is the empty diamond."""
        return [
            (back, max(self.distance_factor - back, -1), self.reach - back)
            for back in range(self.window_size)
            if back <= self.reach
        ]

    @property
    def close_cells(self) -> int:
        return sum(diamond_cells(close) for _, close, _ in self.stencil_radii())

    @property
    def outer_cells(self) -> int:
        return sum(
            diamond_cells(outer) - diamond_cells(close)
            for _, close, outer in self.stencil_radii()
        )


def diamond_cells(radius: int) -> int:
    """Number of grid cells within a Manhattan radius (0 for the empty diamond)."""
    return 0 if radius < 0 else 2 * radius * (radius + 1) + 1
