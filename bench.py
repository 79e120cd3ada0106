"""Times the headline queries; prints one JSON line.

Settings by environment: BENCH_SF_DIR, BENCH_CPUS, and BENCH_RUNS (the best of
so many runs counts). ``frames_500px`` and ``messages_500px`` run on generated
images of realistic size, written out before the clock starts, at two sizes ten
apart; ``growth`` has their seconds per million pixels.
"""

import json
import os
import time
from pathlib import Path

from layerscan.plans.analyze import analyze
from layerscan.plans.queries import QUERIES
from layerscan.session import local_session, materialize
from layerscan.sources.messages import encode_frames
from layerscan.sources.rasters import generated_frames

HEADLINE = [
    "outlier_pixels",
    "outlier_pixels_rows",
    "neighbour_sums_plain",
    "outliers_embeddings",
    "dbscan_labels",
    "dbscan_labels_default",
    "default_eps_results",
    "message_results",
    "stream_results",
]


def seconds(run) -> float:
    start = time.time()
    run().write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "layerscan-bench")
    spark.sparkContext.setLogLevel("OFF")
    timed = {
        name: (lambda query=QUERIES[name]: query(spark, sf_dir)) for name in HEADLINE
    }
    pixels = {}
    for suffix, tiles in (("_small", 2), ("", 20)):
        frames = materialize(generated_frames(spark, 4, tiles, 500, 500), "bench-frames")
        messages = materialize(encode_frames(frames), "bench-messages")
        for name, table in (("frames_500px", frames), ("messages_500px", messages)):
            timed[name + suffix] = lambda table=table: analyze(table)
            pixels[name + suffix] = 4 * tiles * 500 * 500

    queries = {}
    for name, run in timed.items():
        once = 1 if name == "stream_results" else runs
        queries[name] = round(min(seconds(run) for _ in range(once)), 2)
    total = round(sum(queries.values()), 2)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": queries,
                "growth": {k: round(queries[k] / n * 1e6, 3) for k, n in pixels.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
