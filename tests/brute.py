"""Plain definitions of the analysis, image by image, to test against."""

import math

import numpy as np

from layerscan.params import Params
from layerscan.schema import FRAME_SCHEMA


def frames_df(spark, frames):
    """``frames``: (print_id, tile_id, layer, batch_id, 2-D array) tuples."""
    rows = [
        (p, t, layer, b, a.shape[1], a.shape[0], bytearray(a.astype("<u2").tobytes()))
        for p, t, layer, b, a in frames
    ]
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def sample(image, x, y):
    inside = 0 <= y < image.shape[0] and 0 <= x < image.shape[1]
    return int(image[y, x]) if inside else 0


def flagged(window, params=Params()):
    """(x, y, close mean, outer mean) of the newest image; window oldest first."""
    newest = window[-1]
    reach = params.reach
    found = []
    for y in range(newest.shape[0]):
        for x in range(newest.shape[1]):
            if not params.empty_thresh < newest[y, x] < params.saturation_thresh:
                continue
            sums, cells = [0, 0], [0, 0]
            for back in range(params.window_size):
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        distance = abs(dx) + abs(dy) + back
                        if distance > reach:
                            continue
                        ring = int(distance > params.distance_factor)
                        sums[ring] += sample(window[-1 - back], x + dx, y + dy)
                        cells[ring] += 1
            close, outer = sums[0] / cells[0], sums[1] / cells[1]
            if abs(close - outer) > params.outlier_thresh:
                found.append((x, y, close, outer))
    return found


def clusters(points, eps, min_pts):
    """Sequential clustering in row-major order: list of lists of (x, y)."""
    points = sorted(points, key=lambda p: (p[1], p[0]))

    def near(p):
        return [q for q in points if q != p and math.dist(p, q) <= eps]

    state, out = {}, []
    for p in points:
        if p in state:
            continue
        seeds = near(p)
        if len(seeds) < min_pts:
            state[p] = "noise"
            continue
        members = [p]
        state[p] = "in"
        for q in seeds:
            if state.get(q) != "in":
                more = near(q) if q not in state else []
                if len(more) >= min_pts:
                    seeds += [r for r in more if r not in seeds]
                members.append(q)
                state[q] = "in"
        out.append(members)
    return out


def results(frames, params=Params()):
    """(batch_id, 0, print, tile, layer, saturated, centroids) of every frame."""
    history, out = {}, []
    columns = ("print_id", "tile_id")
    for p, t, layer, b, image in sorted(frames, key=lambda f: (f[3], f[2])):
        key = tuple(v for c, v in zip(columns, (p, t)) if c in params.key_cols)
        window = history.setdefault(key, [])
        window.append(image)
        centroids = []
        if len(window) >= params.window_size:
            points = [f[:2] for f in flagged(window[-params.window_size :], params)]
            for c in clusters(points, params.dbscan_eps, params.dbscan_min_pts):
                cx = sum(x for x, _ in c) / len(c)
                cy = sum(y for _, y in c) / len(c)
                centroids.append((cy, cx, len(c)))
            centroids.sort(key=lambda c: -c[2])
        saturated = int((image > params.saturation_thresh).sum())
        out.append((b, 0, p, t, layer, saturated, centroids[: params.top_k]))
    return out


def collected(results_df):
    """Collected results in the form of ``results``."""
    rows = results_df.orderBy("batch_id", "print_id").collect()
    return [(*r[:6], [tuple(c) for c in r["centroids"]]) for r in rows]


def random_images(seed, n, height, width):
    """Images with blocks of heat, so that clusters and gaps appear."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        image = rng.integers(9000, 16000, (height, width))
        for _ in range(4):
            y, x = rng.integers(0, height), rng.integers(0, width)
            image[y : y + rng.integers(2, 7), x : x + rng.integers(2, 7)] = rng.choice(
                [0, 52000, 64000, 65000, 65535]
            )
        out.append(image)
    return out
