"""Simplification and clipping of many lines at once against one line, segment by segment."""

import random

import numpy as np
import pytest

from waymesh.functions import geometry as G


def simplified(points, tolerance):
    if len(points) < 3:
        return list(points)
    (ax, ay), (bx, by) = points[0], points[-1]
    dx, dy = bx - ax, by - ay
    norm = dx * dx + dy * dy
    away = []
    for x, y in points[1:-1]:
        t = min(max(((x - ax) * dx + (y - ay) * dy) / norm, 0), 1) if norm else 0
        away.append(np.hypot(x - ax - t * dx, y - ay - t * dy))
    far = int(np.argmax(away)) + 1
    if away[far - 1] <= tolerance:
        return [points[0], points[-1]]
    return simplified(points[: far + 1], tolerance)[:-1] + simplified(points[far:], tolerance)


def clipped(points, box):
    out, joined = [], False
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        t0, t1 = 0.0, 1.0
        for p, d, low, high in ((ax, bx - ax, box[0], box[2]), (ay, by - ay, box[1], box[3])):
            for room, speed in ((p - low, -d), (high - p, d)):
                if speed > 0:
                    t1 = min(t1, room / speed)
                elif speed < 0:
                    t0 = max(t0, room / speed)
                elif room < 0:
                    t0 = 2.0
        if t0 > t1 or (t0 == t1 and len(points) > 2):
            joined = False
            continue
        a, b = ((ax, ay) if t0 == 0 else (ax + t0 * (bx - ax), ay + t0 * (by - ay))), ((bx, by) if t1 == 1 else (ax + t1 * (bx - ax), ay + t1 * (by - ay)))
        if joined and t0 == 0:
            out[-1].append(b)
        else:
            out.append([a, b])
        joined = t1 == 1
    return out


def some_lines(seed, n=80):
    rng = random.Random(seed)
    grid = lambda: (rng.randint(-4, 4), rng.randint(-4, 4))
    free = lambda: (rng.uniform(-4, 4), rng.uniform(-4, 4))
    return [[rng.choice([grid, free])() for _ in range(rng.randint(0, 12))] for _ in range(n)]


def arrays(lines):
    return np.array([p for v in lines for p in v], float).reshape(-1, 2), np.array([len(v) for v in lines])


@pytest.mark.parametrize("seed", range(6))
def test_simplify(seed):
    lines = some_lines(seed)
    limits = np.array([random.Random(seed + i).choice([0, 0.5, 1.7, 100]) for i in range(len(lines))])
    points, sizes = arrays(lines)
    keep = np.split(G.simplify_lines(points, sizes, limits), np.cumsum(sizes)[:-1])
    for v, k, limit in zip(lines, keep, limits):
        assert [p for p, stays in zip(v, k) if stays] == simplified(v, limit)


@pytest.mark.parametrize("seed", range(6))
def test_clip(seed):
    lines = some_lines(seed)
    rng = random.Random(seed)
    boxes = [rng.choice([(-2, -2, 2, 2), (-1.5, -3, 0.5, 3), (1, 1, 1, 4)]) for _ in lines]
    out, of_part, of_line = G.clip_lines(*arrays(lines), np.array(boxes, float))
    parts = iter(np.split(out, np.cumsum(of_part)[:-1]) if len(of_part) else [])
    for v, box, n in zip(lines, boxes, of_line):
        got = [next(parts) for _ in range(n)]
        want = clipped(v, box)
        assert len(got) == len(want) and all(np.allclose(g, w, atol=1e-12) and len(g) == len(w) for g, w in zip(got, want))


def test_as_columns(spark):
    lines = [[(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], [], None, [(1, 1)], [(-9, 0), (9, 0)]]
    df = spark.createDataFrame([(i, None if v is None else [{"x": float(x), "y": float(y)} for x, y in v]) for i, v in enumerate(lines)], f"id long, v {G.LINE}").repartition(2)
    from pyspark.sql import functions as F

    rows = {r.id: r for r in df.select("id", G.simplify(F.col("v"), F.lit(0.1)).alias("s"), G.clip(F.col("v"), F.lit(-1.0), F.lit(-1.0), F.lit(2.0), F.lit(2)).alias("c")).collect()}
    plain = lambda v: v and [(p.x, p.y) for p in v]
    assert [plain(rows[i].s) for i in range(5)] == [[(0, 0), (2, 0), (3, 5), (4, 0)], [], None, [(1, 1)], [(-9, 0), (9, 0)]]
    assert [[len(p) for p in rows[i].c] for i in range(5)] == [[3], [], [], [], [2]] and plain(rows[4].c[0]) == [(-1, 0), (2, 0)]
