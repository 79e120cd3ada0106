import random

from pyspark.sql import functions as F

from layerscan.operators.layers import arrival_seq, layer_window
from layerscan.params import Params


def arrivals(spark, n=200, seed=5):
    """One busy tile with a third of all records, others with few."""
    rng = random.Random(seed)
    rows = [
        ("p", 0 if rng.random() < 0.34 else rng.randrange(1, 12), 1000 - b, b) for b in range(n)
    ]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "print_id string, tile_id int, layer int, batch_id int")


def expected_seq(rows):
    seen, out = {}, {}
    for _, tile, _, batch in sorted(rows, key=lambda r: r[3]):
        seen[tile] = seen.get(tile, 0) + 1
        out[tile, batch] = seen[tile]
    return out


def test_arrival_order_across_buckets(spark):
    rows, df = arrivals(spark)
    for bucket in (1, 7, 256):
        found = arrival_seq(df.repartition(5), Params(bucket_frames=bucket)).collect()
        assert {(r.tile_id, r.batch_id): r.seq for r in found} == expected_seq(rows)


def test_repeated_records_get_their_own_place(spark):
    df = spark.createDataFrame(
        [("p", 0, 0, 1), ("p", 0, 0, 1), ("p", 0, 0, 2)],
        "print_id string, tile_id int, layer int, batch_id int",
    )
    assert sorted(r.seq for r in arrival_seq(df).collect()) == [1, 2, 3]


def test_window_across_chunks(spark):
    rows, df = arrivals(spark)
    order = {}
    for _, tile, _, batch in sorted(rows, key=lambda r: r[3]):
        order.setdefault(tile, []).append(batch)
    expected = {
        (tile, b): tuple(batches[i - n] if i >= n else None for n in (1, 2))
        for tile, batches in order.items()
        for i, b in enumerate(batches)
    }
    for chunk in (1, 3, 64):
        params = Params(chunk_layers=chunk)
        windows = layer_window(arrival_seq(df, params), ["batch_id"], params)
        found = windows.select(
            "tile_id", "batch_id", F.col("earlier_1.batch_id"), F.col("earlier_2.batch_id")
        ).collect()
        assert {(r[0], r[1]): (r[2], r[3]) for r in found} == expected
        assert len(found) == len(rows)


def test_a_missing_row_is_not_replaced_by_an_older_one(spark):
    df = spark.createDataFrame(
        [("p", 0, 1, 5), ("p", 0, 3, 7), ("p", 0, 4, 8)],
        "print_id string, tile_id int, seq int, value int",
    )
    found = layer_window(df, ["value"]).select("seq", "earlier_1.value", "earlier_2.value")
    assert sorted(tuple(r) for r in found.collect()) == [(1, None, None), (3, None, 5), (4, 7, None)]


def test_keys_choose_the_window(spark):
    rows = [(p, 0, i, 2 * i + (p == "b")) for p in "ab" for i in range(4)]
    df = spark.createDataFrame(rows, "print_id string, tile_id int, layer int, batch_id int")
    assert max(r.seq for r in arrival_seq(df).collect()) == 4
    assert max(r.seq for r in arrival_seq(df, Params(key_cols=("tile_id",))).collect()) == 8
