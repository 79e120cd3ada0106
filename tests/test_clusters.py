import random

import numpy as np
import pyarrow as pa
import pytest
from brute import clusters
from hypothesis import given, settings
from hypothesis import strategies as st

from layerscan.operators.clusters import cluster_centroids, largest_clusters, swap_axes
from layerscan.operators.components import smallest_reachable, whole_groups
from layerscan.operators.dbscan import dbscan
from layerscan.operators.neighbours import cell_side, eps_join, mark_core, near_cells
from layerscan.operators.results import nest_centroids
from layerscan.params import Params

SCHEMA = "print_id string, tile_id int, seq int, x int, y int"


def points_df(spark, sets):
    rows = [("p", 0, n, x, y) for n, points in enumerate(sets) for x, y in points]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def random_sets(seed, n, side, most):
    rng = random.Random(seed)
    everywhere = [(x, y) for x in range(side) for y in range(side)]
    return [rng.sample(everywhere, rng.randrange(0, most)) for _ in range(n)]


def expected_labels(sets, eps, min_pts):
    out = {}
    for n, points in enumerate(sets):
        for members in clusters(points, eps, min_pts):
            core = [
                p
                for p in members
                if sum(q != p and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps for q in points)
                >= min_pts
            ]
            label = min((y << 32) + x for x, y in core)
            out.update({(n, *p): label for p in members})
    return out


def found_labels(df):
    rows = df.collect()
    found = {(r.seq, r.x, r.y): r.cluster_id for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(
    "eps, side, most, block",
    [(2.0, 24, 160, 64), (5.5, 60, 220, 64), (20.0, 200, 330, 64), (3.0, 40, 420, 4)],
)
def test_labels_match_the_sequential_definition(spark, eps, side, most, block):
    sets = random_sets(int(eps), 8, side, most)
    params = Params(dbscan_eps=eps, block_cells=block)
    found = found_labels(dbscan(points_df(spark, sets), params))
    expected = expected_labels(sets, eps, params.dbscan_min_pts)
    assert found == expected
    assert len(set(expected.values())) > 3


def test_crowded_image_and_long_chain(spark):
    """A full square, a chain through many blocks and a lonely group of five."""
    square = [(x, y) for x in range(30) for y in range(30)]
    chain = [(x, 100 + d) for x in range(0, 300) for d in (0, 1)]
    five = [(500, 500 + i) for i in range(5)]
    params = Params(dbscan_eps=3.0, block_cells=5)
    found = found_labels(dbscan(points_df(spark, [square + chain + five]), params))
    assert found == {
        **{(0, *p): 0 for p in square},
        **{(0, *p): 100 << 32 for p in chain},
    }


def test_minimum_excludes_the_point_itself(spark):
    five = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0)]
    labels = dbscan(points_df(spark, [five, [*five, (2, 1)]]), Params(dbscan_eps=3.0))
    assert cluster_centroids(labels).select("seq", "count").collect() == [(1, 6)]


def test_border_point_between_two_clusters(spark):
    left = [(x, y) for x in (0, 1, 2) for y in (10, 11)]
    right = [(x, y) for x in (6, 7, 8) for y in (10, 11)]
    border = (4, 9)
    params = Params(dbscan_eps=2.3)
    labels = found_labels(dbscan(points_df(spark, [[*left, *right, border]]), params))
    near_left = labels[0, 0, 10]
    assert labels[0, 6, 10] != near_left
    assert labels.get((0, *border)) in (None, near_left)
    assert labels == expected_labels([[*left, *right, border]], 2.3, 5)


def test_no_points(spark):
    assert dbscan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_core_marks_and_pairs(spark):
    sets = random_sets(3, 4, 30, 200)
    for eps in (2.0, 4.0, 20.0):
        pairs = {
            (n, *p, *q)
            for n, points in enumerate(sets)
            for p in points
            for q in points
            if p != q and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps
        }
        df = points_df(spark, sets)
        joined = eps_join(df, eps).select("seq", "x", "y", "near_x", "near_y").collect()
        assert len(joined) == len(pairs) and {tuple(r) for r in joined} == pairs
        counts = {}
        for n, x, y, *_ in pairs:
            counts[n, x, y] = counts.get((n, x, y), 0) + 1
        marks = {(r.seq, r.x, r.y): r.is_core for r in mark_core(df, eps, 5).collect()}
        assert marks == {
            (n, *p): counts.get((n, *p), 0) >= 5 for n, points in enumerate(sets) for p in points
        }


@given(st.floats(0.5, 40))
@settings(max_examples=200, deadline=None)
def test_cells_fit_the_radius(eps):
    side = cell_side(eps)
    assert 2 * (side - 1) ** 2 <= eps * eps * (1 + 1e-12)
    near = set(near_cells(side, eps))
    assert (0, 0) in near
    reach = int(eps) + 1
    for dx in range(reach + 1):
        for dy in range(reach + 1):
            if dx * dx + dy * dy <= eps * eps:
                assert ((side - 1 + dx) // side, (side - 1 + dy) // side) in near


EDGES = st.lists(
    st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=60
)


@given(EDGES)
@settings(max_examples=200, deadline=None)
def test_components_of_random_graphs(edges):
    group, a, b = (np.array(v) for v in zip(*edges))
    expected = {(g, n): n for g, *e in edges for n in e}
    for _ in expected:
        for g, u, v in edges:
            expected[g, u] = expected[g, v] = min(expected[g, u], expected[g, v])
    of, nodes, labels = smallest_reachable(group, a, b)
    assert dict(zip(zip(of.tolist(), nodes.tolist()), labels.tolist())) == expected


@given(EDGES, st.lists(st.integers(1, 9), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_groups_stay_whole(rows, sizes):
    rows = sorted(rows)
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["k1", "k2", "v"])
    batches, at = [], 0
    for size in [*sizes, len(rows)]:
        batches += table.slice(at, size).to_batches()
        at += size
    parts = list(whole_groups(iter(batches), 2))
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == rows
    keys = [{(r["k1"], r["k2"]) for r in p.to_pylist()} for p in parts]
    assert sum(map(len, keys)) == len(set.union(*keys))


def test_ten_largest_with_ties(spark):
    sizes = [3, 9, 5, 5, 5, 7, 1, 8, 5, 2, 6, 4]
    rows = [("p", 0, 1, float(i), 7.0, n, i) for i, n in enumerate(sizes)]
    centroids = spark.createDataFrame(
        rows, "print_id string, tile_id int, seq int, cx double, cy double, count int, cluster_id long"
    )
    kept = largest_clusters(centroids).orderBy("rank").select("cluster_id", "count").collect()
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))[:10]
    assert [tuple(r) for r in kept] == [(i, sizes[i]) for i in order]
    nested = nest_centroids(swap_axes(largest_clusters(centroids))).collect()
    assert [tuple(c) for c in nested[0].centroids] == [(7.0, float(i), sizes[i]) for i in order]
