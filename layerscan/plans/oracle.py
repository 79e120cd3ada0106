"""Reference SQL for the registered queries, in DuckDB's dialect.

Each text states the definition directly: all 79 neighbours by a join, all
pairs of points, labels by recursion. Nothing of the Spark plans' shortcuts
appears here.
"""

from __future__ import annotations

# Pixel cells, and one frame per (print, tile, layer).
ORDER_CELLS = """
cells AS (
  SELECT 'P' || print_no AS print_id, tile_id, layer,
         CAST(print_no * 28 + layer * 4 + tile_id AS INTEGER) AS batch_id, x, y, temp
  FROM (
    SELECT l_orderkey // 3750 AS print_no,
           CAST(l_suppkey % 4 AS INTEGER) AS tile_id,
           CAST(year(l_shipdate) - 1995 AS INTEGER) AS layer,
           CAST(l_partkey % 32 AS INTEGER) AS x,
           CAST(l_orderkey % 32 AS INTEGER) AS y,
           CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) % 65536 AS INTEGER) AS temp
    FROM lineitem GROUP BY 1, 2, 3, 4, 5)
)"""

VECTOR_CELLS = """
cells AS (
  SELECT 'P0' AS print_id,
         CAST((vec_id // 16) % 4 AS INTEGER) AS tile_id,
         CAST(vec_id // 64 AS INTEGER) AS layer,
         CAST(vec_id // 16 AS INTEGER) AS batch_id,
         CAST((vec_id % 4) * 8 + i % 8 AS INTEGER) AS x,
         CAST(((vec_id // 4) % 4) * 8 + i // 8 AS INTEGER) AS y,
         CAST(greatest(0, least(65535, floor(
           32768 + CAST(embedding[i + 1] AS DOUBLE) * 100000))) AS INTEGER) AS temp
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)
)"""

FRAMES = """
frames AS (
  SELECT *, CAST(row_number() OVER (
           PARTITION BY print_id, tile_id ORDER BY batch_id, layer) AS INTEGER) AS seq
  FROM (SELECT DISTINCT print_id, tile_id, layer, batch_id FROM cells)
)"""

GRID = """
grid AS (
  SELECT f.*, CAST(c.x AS INTEGER) AS x, CAST(r.y AS INTEGER) AS y,
         coalesce(p.temp, 0) AS temp
  FROM frames f CROSS JOIN range(32) c(x) CROSS JOIN range(32) r(y)
  LEFT JOIN cells p ON p.print_id = f.print_id AND p.tile_id = f.tile_id
    AND p.layer = f.layer AND p.batch_id = f.batch_id AND p.x = c.x AND p.y = r.y
)"""

OFFSETS = """
offsets AS (
  SELECT CASE WHEN abs(dx) + abs(dy) + d <= 2 THEN 'close' ELSE 'outer' END AS kind,
         CAST(d AS INTEGER) AS layer_offset, CAST(dx AS INTEGER) AS dx,
         CAST(dy AS INTEGER) AS dy
  FROM range(3) l(d) CROSS JOIN range(-4, 5) a(dx) CROSS JOIN range(-4, 5) b(dy)
  WHERE abs(dx) + abs(dy) + d <= 4
)"""

# Every pixel of a full window with all its neighbours.
PAIRS = """
pairs AS (
  SELECT t.*, o.kind, o.layer_offset, o.dx, o.dy, n.temp AS n_temp
  FROM (SELECT * FROM grid WHERE seq >= 3) t CROSS JOIN offsets o
  LEFT JOIN grid n ON n.print_id = t.print_id AND n.tile_id = t.tile_id
    AND n.seq = t.seq - o.layer_offset AND n.x = t.x + o.dx AND n.y = t.y + o.dy
)"""

SUMS = """
sums AS (
  SELECT print_id, tile_id, layer, batch_id, seq, x, y, temp,
         CAST(coalesce(sum(n_temp) FILTER (kind = 'close'), 0) AS BIGINT) AS close_sum,
         CAST(coalesce(sum(n_temp) FILTER (kind = 'outer'), 0) AS BIGINT) AS outer_sum
  FROM pairs GROUP BY ALL
)"""

MEANS = """
means AS (
  SELECT *, close_sum / 19 AS close_mean, outer_sum / 60 AS outer_mean,
         abs(close_sum / 19 - outer_sum / 60) AS deviation
  FROM sums
)"""

CANDIDATE = "temp > 5000 AND temp < 65000"

OUTLIERS = f"""
outliers AS (
  SELECT print_id, tile_id, layer, batch_id, seq, x, y, close_mean, outer_mean, deviation
  FROM means WHERE {CANDIDATE} AND deviation > 6000
)"""


def _clusters(squared_eps: int) -> str:
    """Core points, clusters and labels of the flagged pixels."""
    return f"""
points AS (
  SELECT print_id, tile_id, seq, x, y, CAST(y AS BIGINT) * 4294967296 + x AS pid,
         row_number() OVER () AS node
  FROM outliers
),
near AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b
  FROM points a JOIN points b ON a.print_id = b.print_id AND a.tile_id = b.tile_id
    AND a.seq = b.seq AND a.pid <> b.pid
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {squared_eps}
),
core AS MATERIALIZED (
  SELECT p.node, any_value(p.pid) AS pid FROM points p JOIN near n ON n.a = p.node
  GROUP BY p.node HAVING count(*) >= 5
),
links AS MATERIALIZED (
  SELECT n.a, n.b FROM near n JOIN core p ON p.node = n.a JOIN core q ON q.node = n.b
),
reach(node, label) USING KEY (node) AS (
  SELECT node, pid FROM core
  UNION
  SELECT l.b, min(r.label) FROM reach r JOIN links l ON l.a = r.node
  JOIN recurring.reach o ON o.node = l.b
  WHERE r.label < o.label GROUP BY l.b
),
labels AS (
  SELECT p.print_id, p.tile_id, p.seq, p.x, p.y, r.label AS cluster_id, true AS is_core
  FROM points p JOIN reach r ON r.node = p.node
  UNION ALL
  SELECT p.print_id, p.tile_id, p.seq, p.x, p.y, min(r.label) AS cluster_id, false AS is_core
  FROM points p JOIN near n ON n.a = p.node JOIN reach r ON r.node = n.b
  WHERE p.node NOT IN (SELECT node FROM core)
  GROUP BY p.print_id, p.tile_id, p.seq, p.x, p.y
)"""


CENTROIDS = """
centroids AS (
  SELECT print_id, tile_id, seq, cluster_id, sum(x) / count(*) AS cx,
         sum(y) / count(*) AS cy, CAST(count(*) AS INTEGER) AS count
  FROM labels GROUP BY ALL
)"""

TOP = """
top AS (
  SELECT print_id, tile_id, seq, cluster_id, count, rank, cy AS x, cx AS y
  FROM (SELECT *, CAST(row_number() OVER (
          PARTITION BY print_id, tile_id, seq ORDER BY count DESC, cluster_id) AS INTEGER) AS rank
        FROM centroids)
  WHERE rank <= 10
)"""

RESULTS = """
SELECT f.batch_id, 0 AS query, f.print_id, f.tile_id, f.layer,
       CAST(s.saturated AS INTEGER) AS saturated, t.rank, t.x, t.y, t.count
FROM frames f
JOIN (SELECT print_id, tile_id, seq, count(*) FILTER (temp > 65000) AS saturated
      FROM grid GROUP BY ALL) s USING (print_id, tile_id, seq)
LEFT JOIN top t USING (print_id, tile_id, seq)"""

# All prints on a tile share one window.
SHARED_FRAMES = FRAMES.replace("PARTITION BY print_id, tile_id", "PARTITION BY tile_id")
SHARED_PAIRS = PAIRS.replace("n.print_id = t.print_id AND ", "")

# Records that come an append late count on arrival.
LATE_FRAMES = FRAMES.replace(
    "ORDER BY batch_id, layer",
    """ORDER BY least(2, batch_id * 3 // (SELECT max(batch_id) + 1 FROM cells)
             + CAST(batch_id % 11 = 3 AS INTEGER)), batch_id, layer""",
)

# The same with late records apart: those of a lower layer than one before them.
APPENDED = """
marked AS (
  SELECT *, coalesce(layer < max(layer) OVER (PARTITION BY print_id, tile_id ORDER BY append, batch_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_late
  FROM (SELECT DISTINCT print_id, tile_id, layer, batch_id,
          least(2, batch_id * 3 // (SELECT max(batch_id) + 1 FROM cells)
            + CAST(batch_id % 11 = 3 AS INTEGER)) AS append
        FROM cells)
)"""
TIMELY_FRAMES = """
frames AS (
  SELECT print_id, tile_id, layer, batch_id, CAST(row_number() OVER (
           PARTITION BY print_id, tile_id ORDER BY append, batch_id) AS INTEGER) AS seq
  FROM marked WHERE NOT is_late
)"""

# Two layers of a tile under one layer and arrival number: their images go by digest.
DIGESTS = """
digests AS (
  SELECT f.*, md5(unhex(string_agg(printf('%02x%02x', coalesce(p.temp, 0) % 256, coalesce(p.temp, 0) // 256), ''
           ORDER BY r.y, c.x))) AS digest
  FROM (SELECT DISTINCT print_id, tile_id, layer, batch_id FROM cells) f
  CROSS JOIN range(32) c(x) CROSS JOIN range(32) r(y)
  LEFT JOIN cells p ON p.print_id = f.print_id AND p.tile_id = f.tile_id
    AND p.layer = f.layer AND p.batch_id = f.batch_id AND p.x = c.x AND p.y = r.y
  GROUP BY ALL
)"""
TIED_FRAMES = """
frames AS (
  SELECT print_id, tile_id, layer, batch_id, CAST(row_number() OVER (
           PARTITION BY print_id, tile_id
           ORDER BY batch_id - 4 * (layer % 2), layer - layer % 2, digest) AS INTEGER) AS seq
  FROM digests
)"""

# Damaged messages: some cannot be used, some have no print.
GOOD_CELLS = """
cells AS (
  SELECT * REPLACE (CASE WHEN batch_id % 9 = 5 THEN '' ELSE print_id END AS print_id)
  FROM all_cells WHERE batch_id % 9 NOT IN (1, 2, 3, 4)
)"""
DAMAGED = (ORDER_CELLS.replace("cells AS", "all_cells AS", 1), GOOD_CELLS)

TO_GRID = (FRAMES, GRID)
TO_SUMS = (*TO_GRID, OFFSETS, PAIRS, SUMS)
TO_OUTLIERS = (*TO_SUMS, MEANS, OUTLIERS)


def _with(*parts: str, then: str) -> str:
    """A query over named parts; the last argument selects from them."""
    kind = "WITH RECURSIVE" if any("USING KEY" in p for p in parts) else "WITH"
    return f"{kind}{','.join(parts)}\n{then.strip()}"


def _labels(cells: str, squared_eps: int, then: str, *more: str) -> str:
    return _with(cells, *TO_OUTLIERS, _clusters(squared_eps), *more, then=then)


def _results(cells: str, squared_eps: int) -> str:
    return _labels(cells, squared_eps, RESULTS, CENTROIDS, TOP)


def _diamond(radius: int) -> str:
    inside = f"abs(n.x - t.x) + abs(n.y - t.y) <= {radius}"
    return f"CAST(sum(n.temp) FILTER ({inside}) AS BIGINT) AS d{radius}"


def _results_with(cells: tuple, frames: str, pairs: str, then: str = RESULTS) -> str:
    """Results at the small radius under another order of frames."""
    to_outliers = (frames, GRID, OFFSETS, pairs, SUMS, MEANS, OUTLIERS)
    return _with(*cells, *to_outliers, _clusters(4), CENTROIDS, TOP, then=then)


# One row per image, as the JSON text of its centroids.
NESTED = f"""
SELECT batch_id, query, print_id, tile_id, layer, saturated,
       CAST(to_json(coalesce(list(struct_pack(x := x, y := y, count := count) ORDER BY rank)
         FILTER (rank IS NOT NULL), [])) AS VARCHAR) AS centroids
FROM ({RESULTS}) GROUP BY ALL"""

ALL_LABELS = "SELECT print_id, tile_id, seq, x, y, cluster_id, is_core FROM labels"

ORACLE: dict[str, str] = {
    "pixel_grid": _with(
        ORDER_CELLS, *TO_GRID, then="SELECT print_id, tile_id, layer, batch_id, x, y, temp FROM grid"
    ),
    "decoded_messages": _with(
        ORDER_CELLS, *TO_GRID, then="SELECT print_id, tile_id, layer, batch_id, x, y, temp FROM grid"
    ),
    "typed_records": """
SELECT CAST(CASE WHEN event_id * 1000000 <= 2147483647 THEN event_id * 1000000 END AS INTEGER)
         AS batch_id,
       event_type AS print_id, CAST(user_id AS INTEGER) AS tile_id,
       CAST(event_id AS INTEGER) AS layer, props AS tif
FROM events""",
    "reject_split": """
SELECT event_id,
       CASE WHEN event_id % 50 = 0 THEN 'no_tile' WHEN event_id % 50 = 1 THEN 'end_marker'
            WHEN event_id % 50 = 2 OR props IS NULL THEN 'no_payload' END AS reject_reason
FROM events""",
    "arrival_seq": _with(ORDER_CELLS, FRAMES, then="SELECT * FROM frames"),
    "layer_window": _with(
        ORDER_CELLS,
        FRAMES,
        then="""
SELECT *, lag(batch_id, 1) OVER w AS batch_1, lag(batch_id, 2) OVER w AS batch_2,
       count(*) OVER w >= 3 AS is_full
FROM frames WINDOW w AS (PARTITION BY print_id, tile_id ORDER BY batch_id, layer)""",
    ),
    "event_window3": """
SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS seq, value,
       lag(event_id, 1) OVER w AS event_1, lag(value, 1) OVER w AS value_1,
       lag(event_id, 2) OVER w AS event_2, lag(value, 2) OVER w AS value_2
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "keyless_window3": """
SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS seq, value,
       lag(event_id, 1) OVER w AS event_1, lag(value, 1) OVER w AS value_1,
       lag(event_id, 2) OVER w AS event_2, lag(value, 2) OVER w AS value_2
FROM (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN user_id END AS user_id, value,
        CASE WHEN event_id % 17 > 0 THEN ts END AS ts FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)""",
    "watermark_layers": _with(
        ORDER_CELLS,
        FRAMES,
        then="""
SELECT print_id, tile_id, layer, batch_id, epoch_ms(make_timestamp(layer * 1000)) AS event_ms
FROM frames""",
    ),
    "saturated_count": _with(
        ORDER_CELLS,
        *TO_GRID,
        then="""
SELECT print_id, tile_id, layer, batch_id, seq,
       CAST(count(*) FILTER (temp > 65000) AS INTEGER) AS saturated
FROM grid GROUP BY ALL""",
    ),
    "candidate_pixels": _with(
        ORDER_CELLS, *TO_GRID, then=f"SELECT * FROM grid WHERE {CANDIDATE} AND seq >= 3"
    ),
    "stencil_offsets": _with(
        ORDER_CELLS,
        *TO_GRID,
        OFFSETS,
        PAIRS,
        then=f"""
SELECT kind, layer_offset, dx, dy, count(*) AS pixels, count(n_temp) AS on_grid,
       CAST(coalesce(sum(n_temp), 0) AS BIGINT) AS temp_sum
FROM pairs WHERE {CANDIDATE} GROUP BY ALL""",
    ),
    "neighbour_sums_plain": _with(
        ORDER_CELLS,
        *TO_SUMS,
        then=f"""
SELECT print_id, tile_id, layer, batch_id, seq, x, y, close_sum, outer_sum
FROM sums WHERE {CANDIDATE}""",
    ),
    "diamond_sums": _with(
        ORDER_CELLS,
        *TO_GRID,
        then=f"""
SELECT t.print_id, t.tile_id, t.layer, t.batch_id, t.seq, t.x, t.y, t.temp,
       {', '.join(_diamond(r) for r in range(5))}
FROM grid t JOIN grid n ON n.print_id = t.print_id AND n.tile_id = t.tile_id
  AND n.seq = t.seq AND n.x BETWEEN t.x - 4 AND t.x + 4
  AND abs(n.x - t.x) + abs(n.y - t.y) <= 4
GROUP BY ALL""",
    ),
    "neighbour_means": _with(ORDER_CELLS, *TO_SUMS, MEANS, then="SELECT * FROM means"),
    "outlier_pixels": _with(ORDER_CELLS, *TO_OUTLIERS, then="SELECT * FROM outliers"),
    "outlier_pixels_rows": _with(ORDER_CELLS, *TO_OUTLIERS, then="SELECT * FROM outliers"),
    "outlier_bands": _with(ORDER_CELLS, *TO_OUTLIERS, then="SELECT * FROM outliers"),
    "outliers_embeddings": _with(VECTOR_CELLS, *TO_OUTLIERS, then="SELECT * FROM outliers"),
    "frame_saturation": _with(
        ORDER_CELLS,
        *TO_GRID,
        then="""
SELECT print_id, tile_id, layer, batch_id, seq,
       CAST(count(*) FILTER (temp > 65000) AS INTEGER) AS saturated
FROM grid GROUP BY ALL""",
    ),
    "eps_pairs": _with(
        ORDER_CELLS,
        *TO_OUTLIERS,
        then="""
SELECT a.print_id, a.tile_id, a.seq, a.x, a.y, b.x AS near_x, b.y AS near_y
FROM outliers a JOIN outliers b ON a.print_id = b.print_id AND a.tile_id = b.tile_id
  AND a.seq = b.seq AND (a.x <> b.x OR a.y <> b.y)
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4""",
    ),
    "eps_neighbours": _with(
        ORDER_CELLS,
        *TO_OUTLIERS,
        then="""
SELECT a.print_id, a.tile_id, a.seq, a.x, a.y, count(*) AS neighbours,
       arg_min(b.x, b.y * 4096 + b.x) AS first_x, min(b.y) AS first_y
FROM outliers a JOIN outliers b ON a.print_id = b.print_id AND a.tile_id = b.tile_id
  AND a.seq = b.seq AND (a.x <> b.x OR a.y <> b.y)
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4
GROUP BY ALL""",
    ),
    "core_points": _with(
        VECTOR_CELLS,
        *TO_OUTLIERS,
        then="""
SELECT a.print_id, a.tile_id, a.seq, a.x, a.y, count(b.x) >= 5 AS is_core
FROM outliers a LEFT JOIN outliers b ON a.print_id = b.print_id AND a.tile_id = b.tile_id
  AND a.seq = b.seq AND (a.x <> b.x OR a.y <> b.y)
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4
GROUP BY ALL""",
    ),
    "dbscan_labels": _labels(VECTOR_CELLS, 4, ALL_LABELS),
    "dbscan_blocks": _labels(VECTOR_CELLS, 4, ALL_LABELS),
    "dbscan_labels_default": _labels(ORDER_CELLS, 400, ALL_LABELS),
    "cluster_centroids": _labels(VECTOR_CELLS, 4, "SELECT * FROM centroids", CENTROIDS),
    "top10_clusters": _labels(VECTOR_CELLS, 4, "SELECT * FROM top", CENTROIDS, TOP),
    "tile_results": _labels(ORDER_CELLS, 400, NESTED, CENTROIDS, TOP),
    "shared_tile_results": _results_with((ORDER_CELLS,), SHARED_FRAMES, SHARED_PAIRS),
    "tile_results_flat": _results(ORDER_CELLS, 4),
    "tile_results_embeddings": _results(VECTOR_CELLS, 4),
    "default_eps_results": _results(ORDER_CELLS, 400),
    "message_results": _results(ORDER_CELLS, 4),
    "damaged_results": _results_with(
        DAMAGED,
        FRAMES,
        PAIRS,
        then=f"SELECT * REPLACE (nullif(print_id, '') AS print_id) FROM ({RESULTS})",
    ),
    "reject_counts": _with(
        ORDER_CELLS,
        FRAMES,
        then="""
SELECT CASE batch_id % 9 WHEN 1 THEN 'no_payload' WHEN 2 THEN 'bad_payload' WHEN 3 THEN 'no_tile'
         WHEN 4 THEN 'end_marker' END AS reject_reason, count(*) AS records
FROM frames GROUP BY ALL""",
    ),
    "stream_results": _results(ORDER_CELLS, 4),
    "stream_late_results": _results_with((ORDER_CELLS,), LATE_FRAMES, PAIRS),
    "stream_late_side": _results_with(
        (ORDER_CELLS, APPENDED),
        TIMELY_FRAMES,
        PAIRS,
        RESULTS.replace("t.count\nFROM", "t.count, false AS is_late\nFROM")
        + """
UNION ALL
SELECT batch_id, NULL, print_id, tile_id, layer, NULL, NULL, NULL, NULL, NULL, true FROM marked WHERE is_late""",
    ),
    "stream_tied_results": _results_with(
        (ORDER_CELLS, DIGESTS),
        TIED_FRAMES,
        PAIRS,
        RESULTS.replace("SELECT f.batch_id,", "SELECT f.batch_id - 4 * (f.layer % 2) AS batch_id,", 1).replace(
            "f.layer,", "f.layer - f.layer % 2 AS layer,", 1
        ),
    ),
    "stream_closed_layers": _with(
        VECTOR_CELLS,
        then="""
SELECT print_id, layer, CAST(count(DISTINCT tile_id) AS INTEGER) AS tiles,
       count(*) FILTER (temp > 65000) AS saturated, 'watermark' AS closed_by
FROM cells WHERE layer <= (SELECT max(layer) - 2 FROM cells) GROUP BY print_id, layer""",
    ),
    "tile_partition": """
SELECT event_id,
       CAST(CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 15
                 ELSE user_id % 16 END AS INTEGER) AS tile_partition
FROM events""",
    "placed_tiles": _with(
        ORDER_CELLS,
        FRAMES,
        then="""
SELECT print_id, tile_id, layer, batch_id, tile_id % 16 AS tile_partition FROM frames""",
    ),
    "halo_blocks": _with(
        ORDER_CELLS,
        *TO_GRID,
        then="""
SELECT g.*, CAST(b.block AS INTEGER) AS block, g.y // 8 = b.block AS in_core
FROM grid g JOIN range(4) b(block)
  ON g.y BETWEEN b.block * 8 - 4 AND b.block * 8 + 7 + 4""",
    ),
}
ORACLE["stream_counts"] = ORACLE["reject_counts"]
ORACLE["compressed_messages"] = ORACLE["decoded_messages"]
ORACLE["log_stream_results"] = ORACLE["stream_results"]
