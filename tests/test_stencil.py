from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import flagged, frames_df, random_images
from pyspark.sql import functions as F

from layerscan.operators.bands import _scan_layer_batches, outliers, split_bands
from layerscan.operators.layers import arrival_seq
from layerscan.operators.pixels import (
    candidate_pixels,
    densify,
    frames_from_pixels,
    pixel_rows,
    saturated_count,
)
from layerscan.operators.stencil import (
    diamond_sums,
    neighbour_join,
    neighbour_means,
    neighbour_pairs,
    offset_profile,
    outlier_rows,
    stencil_offsets,
    with_means,
)
from layerscan.params import Params
from layerscan.schema import FRAME


def constant(value, n=3, side=16):
    return [np.full((side, side), value) for _ in range(n)]


def hot(base, value, where, n=3):
    images = constant(base, n)
    images[-1] = images[-1].copy()
    images[-1][where] = value
    return images


CASES = {
    "flat-40000": (constant(40000), 84),
    "flat-34000": (constant(34000), 36),
    "flat-64999": (constant(64999), 124),
    "flat-65000": (constant(65000), 0),
    "flat-5000": (constant(5000), 0),
    "block": (hot(20000, 60000, np.s_[6:10, 6:10]), 20),
    "spike": (hot(20000, 64000, np.s_[8, 8]), 4),
    "two layers": (constant(40000, 2), 0),
}


def numbered(images):
    return [
        (name, 0, layer, 10 * i + layer, image)
        for i, (name, stack) in enumerate(images.items())
        for layer, image in enumerate(stack)
    ]


@pytest.fixture(scope="module")
def case_frames(spark):
    frames = numbered({name: stack for name, (stack, _) in CASES.items()})
    return arrival_seq(frames_df(spark, frames)).cache()


def test_counts_of_hand_made_images(case_frames):
    found = {r[0]: r[1] for r in outliers(case_frames).groupBy("print_id").count().collect()}
    assert {name: found.get(name, 0) for name in CASES} == {n: c for n, (_, c) in CASES.items()}


def test_deviation_values(case_frames):
    flat = {
        (r.x, r.y): r.deviation
        for r in outliers(case_frames).filter("print_id = 'flat-40000'").collect()
    }
    assert flat[0, 0] == pytest.approx(7052.63, abs=0.01)
    assert flat[1, 8] == pytest.approx(6561.40, abs=0.01)
    assert (0, 8) not in flat
    block = {
        (r.x, r.y) for r in outliers(case_frames).filter("print_id = 'block'").collect()
    }
    assert {(1, 1), (1, 14), (14, 1), (14, 14), (6, 6), (9, 9)} <= block


def test_all_forms_agree_with_the_definition(spark):
    stacks = {f"r{seed}": random_images(seed, 5, 14, 19) for seed in range(3)}
    frames = arrival_seq(frames_df(spark, numbered(stacks))).cache()
    expected = sorted(
        (name, seq, x, y, close, outer)
        for name, stack in stacks.items()
        for seq in range(3, 6)
        for x, y, close, outer in flagged(stack[seq - 3 : seq])
    )
    assert len(expected) > 50
    columns = ("print_id", "seq", "x", "y", "close_mean", "outer_mean")

    def rows(df):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    small = Params(band_rows=5, chunk_layers=2, bucket_frames=2)
    assert rows(outliers(frames)) == expected
    assert rows(outliers(frames, small)) == expected
    assert rows(outlier_rows(pixel_rows(frames), small)) == expected
    joined = with_means(neighbour_join(pixel_rows(frames)))
    assert rows(joined.filter("deviation > 6000")) == expected


def test_images_of_different_size_in_one_key(spark):
    shapes = [(9, 12), (14, 7), (9, 12), (6, 20), (17, 17), (9, 12), (21, 5), (9, 12)]
    stack = [random_images(i, 1, h, w)[0] for i, (h, w) in enumerate(shapes)]
    frames = arrival_seq(frames_df(spark, numbered({"p": stack})))
    expected = sorted(
        (seq, x, y)
        for seq in range(3, len(stack) + 1)
        for x, y, *_ in flagged(stack[seq - 3 : seq])
    )
    for rows in (4, 128):
        params = Params(band_rows=rows, chunk_layers=2)
        found = outliers(frames, params).select("seq", "x", "y").collect()
        assert sorted(tuple(r) for r in found) == expected


def test_other_distances(spark):
    stack = random_images(4, 4, 11, 11)
    params = Params(distance_factor=1, outlier_thresh=4000.0)
    frames = arrival_seq(frames_df(spark, numbered({"p": stack})))
    expected = sorted((x, y) for x, y, *_ in flagged(stack[1:], params))
    found = outliers(frames, params).filter("seq = 4").select("x", "y").collect()
    assert sorted(tuple(r) for r in found) == expected


def test_threshold_pixels(spark):
    image = np.array([[5000, 5001, 64999, 65000, 65001]])
    pixels = pixel_rows(arrival_seq(frames_df(spark, [("p", 0, 0, 0, image)])))
    assert sorted(r.temp for r in candidate_pixels(pixels).collect()) == [5001, 64999]
    assert [r.saturated for r in saturated_count(pixels).collect()] == [1]


def test_offsets(spark):
    kinds = {r.kind: r["count"] for r in stencil_offsets(spark).groupBy("kind").count().collect()}
    assert kinds == {"close": 19, "outer": 60}
    assert (Params().close_cells, Params().outer_cells) == (19, 60)


def test_offset_profile_counts_the_grid(spark):
    frames = arrival_seq(frames_df(spark, numbered({"p": constant(40000, side=8)})))
    profile = {
        (r.layer_offset, r.dx, r.dy): (r.pixels, r.on_grid)
        for r in offset_profile(pixel_rows(frames)).collect()
    }
    assert profile[0, 0, 0] == (64, 64)
    assert profile[0, 4, 0] == (64, 32)
    assert profile[2, -1, 1] == (64, 49)


def test_pixels_and_frames_are_inverse(spark):
    frames = frames_df(spark, [("p", 0, i, i, a) for i, a in enumerate(random_images(1, 3, 6, 9))])
    pixels = pixel_rows(frames)
    back = frames_from_pixels(pixels, 9, 6)
    assert back.exceptAll(frames).count() == 0
    sparse = pixels.filter("temp > 12000")
    dense = densify(sparse, 9, 6)
    assert dense.count() == 3 * 54
    assert dense.filter("temp > 0").exceptAll(sparse.select(dense.columns)).count() == 0
    assert densify(sparse, 9, 6, margin=4).count() == 3 * 130


def test_bands_hold_a_halo(spark):
    frames = arrival_seq(frames_df(spark, [("p", 0, 0, 0, np.zeros((20, 3)))]))
    bands = split_bands(frames, Params(band_rows=8)).orderBy("band")
    found = bands.select("band", "top", F.expr("length(rows) div 6")).collect()
    assert [tuple(r) for r in found] == [(0, 0, 12), (1, 4, 16), (2, 12, 8)]


def sparse_pixels(spark):
    """Pixels with a hole, one that comes twice, a negative place and a null key, over block edges."""
    rows = [
        (key, 0, seq, seq, seq, x, y, 6000 + 100 * seq + 10 * x + y)
        for key in ("p", None)
        for seq in (1, 2, 3, 4)
        for x in range(-2, 12)
        for y in range(9)
        if (x, y, seq) != (3, 3, 2)
    ]
    rows += [("p", 0, 2, 2, 2, 5, 5, 7000), ("p", 0, 3, 3, 3, None, 4, 8000)]
    schema = "print_id string, tile_id int, layer int, batch_id int, seq int, x int, y int, temp int"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


def test_neighbours_meet_in_blocks(spark, capsys):
    """Pairs equal a nested loop over the rows, and none of them is shuffled."""
    rows, pixels = sparse_pixels(spark)
    params, offsets = Params(band_rows=5, chunk_layers=2), stencil_offsets(spark).collect()
    at = {}
    for r in rows:
        if r[0] is not None and r[5] is not None:
            at.setdefault((r[0], r[4], r[5], r[6]), []).append(r[7])
    expected = Counter(
        (*r[:7], o.kind, o.layer_offset, o.dx, o.dy, temp)
        for r in rows
        if r[4] >= 3
        for o in offsets
        for temp in at.get((r[0], r[4] - o.layer_offset, r[5] if r[5] is None else r[5] + o.dx, r[6] + o.dy), [None])
    )
    pairs = neighbour_pairs(pixels, params)
    assert Counter(tuple(r) for r in pairs.collect()) == expected
    neighbour_join(pixels, params).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "hashpartitioning(print_id" in plan


def test_sums_move_packed_blocks(spark, capsys):
    """Sums of a dense grid of several blocks equal the definition; no pixel row is shuffled or sorted."""
    stack = random_images(5, 4, 13, 17)
    pixels = pixel_rows(arrival_seq(frames_df(spark, numbered({"p": stack, None: stack})))).repartition(3)
    params = Params(band_rows=6, chunk_layers=2)
    sums = diamond_sums(pixels, params)
    assert sums.columns == [*pixels.columns, *(f"d{r}" for r in range(5))]
    around = [(r, dx, dy) for r in range(5) for dx in range(-r, r + 1) for dy in range(abs(dx) - r, r - abs(dx) + 1)]
    rows = sums.collect()
    assert len(rows) == 2 * 4 * 13 * 17
    for row in rows[::7]:
        expected = [0] * 5
        for r, dx, dy in around:
            x, y = row.x + dx, row.y + dy
            expected[r] += int(stack[row.layer][y, x]) if 0 <= x < 17 and 0 <= y < 13 else 0
        assert [row[f"d{r}"] for r in range(5)] == expected
    plain = {(r.seq, r.x, r.y): (r.close_sum, r.outer_sum) for r in neighbour_join(pixels, params).filter("print_id = 'p'").collect()}
    found = neighbour_means(pixels, params)
    for name in ("p", None):
        of_print = found.filter(F.col("print_id").eqNullSafe(F.lit(name))).collect()
        assert len(of_print) == 4 * 13 * 17
        assert {k: v for r in of_print if (k := (r.seq, r.x, r.y)) in plain for v in [(r.close_sum, r.outer_sum)]} == plain
    found.explain()
    plan = capsys.readouterr().out.split("MapInArrow")
    # Above the step that packs, only packed rows are exchanged and sorted.
    assert len(plan) > 3 and all("Window" not in part or "cells" in part for part in plan)


def test_dense_grid_of_packed_images(spark, capsys):
    """Pixels that come twice, off the grid, without place or key, in no order; pixel rows are not aggregated."""
    rows = [("p", 0, 1, 1, 0, 0, 9), ("p", 0, 1, 1, 0, 0, 7), ("p", 0, 1, 1, 2, 1, -5), ("p", 0, 1, 1, 7, 1, 3)]
    rows += [("p", 0, 1, 1, 7, 1, 4), ("p", 0, 1, 1, None, 1, 8), (None, None, 1, None, 1, 1, 6), ("q", 0, 1, 1, 1, 0, None)]
    schema = "print_id string, tile_id int, layer int, batch_id int, x int, y int, temp int"
    dense = densify(spark.createDataFrame(rows, schema).repartition(4), 3, 2)
    expected = Counter()
    for image in {r[:4] for r in rows}:
        mine = {}
        for r in rows:
            if r[:4] == image:
                mine.setdefault(r[4:6], []).append(r[6] or 0)
        grid = {(x, y) for x in range(3) for y in range(2)}
        expected.update((*image, *at, max([*mine.get(at, []), *[0][: at in grid]])) for at in grid | set(mine))
    assert Counter(tuple(r) for r in dense.collect()) == expected
    dense.explain()
    assert "HashAggregate" not in capsys.readouterr().out


def test_scan_holds_a_part_of_a_batch():
    """A batch of many bands is scanned and sent in parts."""
    names = [*FRAME, "band", "own", "group", "height", "width", "top", "rows"]
    rows = [dict(zip(names, ["p", 0, 0, i, i + 1, 0, True, 1, 2, 2, 0, bytes(8)])) for i in range(1000)]
    parts = list(_scan_layer_batches(iter([pa.RecordBatch.from_pylist(rows)]), Params()))
    assert max(p.num_rows for p in parts) <= 256
    assert pa.Table.from_batches(parts).column("seq").to_pylist() == list(range(1, 1001))
