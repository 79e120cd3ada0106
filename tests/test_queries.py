"""Registered queries against their reference SQL; all of them: compare.py."""

from pathlib import Path

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries
from layerscan.plans.oracle import ORACLE
from layerscan.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables here")

CHOSEN = [
    "reject_split",
    "typed_records",
    "event_window3",
    "keyless_window3",
    "layer_window",
    "stencil_offsets",
    "diamond_sums",
    "neighbour_means",
    "outlier_pixels",
    "outlier_bands",
    "eps_neighbours",
    "dbscan_blocks",
    "core_points",
    "top10_clusters",
    "tile_results",
    "tile_results_flat",
    "shared_tile_results",
    "damaged_results",
    "reject_counts",
    "stream_results",
    "stream_late_results",
    "placed_tiles",
    "halo_blocks",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_registry():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["neighbour_sums_plain", "stencil_offsets", "layer_window", "arrival_seq"])
def test_no_broadcast_of_pixels_or_images(spark, name, capsys):
    queries()[name](spark, SF_DIR).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_entry(spark):
    assert entry(spark).count() == 400


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None
