"""Clicks on roads and overlays, against distances worked out point by point."""

import math
import random

import pytest

from waymesh.functions.geometry import LINE
from waymesh.operators import clicks

SHAPE = f"fid long, geometry struct<gtype:string,parts:array<{LINE}>>"


def line(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def metres(x, y, parts):
    best, kx = None, math.cos(math.radians(y)) * 111320.0
    for part in parts:
        v = [((p["x"] - x) * kx, (p["y"] - y) * 111320.0) for p in part]
        for (ax, ay), (bx, by) in zip(v, v[1:] or v):
            dx, dy = bx - ax, by - ay
            t = min(max(-(ax * dx + ay * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
            d = math.hypot(ax + t * dx, ay + t * dy)
            best = d if best is None else min(best, d)
    return best


@pytest.mark.parametrize(("cell", "reach"), [(0.01, 300), (0.0007, 60), (3.0, 5000)])
def test_nearest_line(spark, cell, reach):
    rng = random.Random(cell)
    lines = [(i, line(*[(rng.uniform(-0.02, 0.02), 60 + rng.uniform(-0.02, 0.02)) for _ in range(rng.randint(1, 4))])) for i in range(40)]
    lines += [(100, []), (101, None), (102, line((0.5, 60), (0.5, 60)))]
    points = [(i, rng.uniform(-0.025, 0.025), 60 + rng.uniform(-0.025, 0.025)) for i in range(80)] + [(200, None, 60.0), (201, 0.5, 60.0), (202, 10.0, 10.0), (202, 10.0, 10.0)]
    got = clicks.nearest_line(spark.createDataFrame(points, "click_id long, x double, y double"), spark.createDataFrame(lines, f"fid long, vertices {LINE}"), reach, cell)
    want = {}
    for i, x, y in points:
        if x is not None:
            near = min(((d, f) for f, v in lines if v for d in [metres(x, y, [v])] if d <= reach), default=None)
            if near:
                want[i] = (near[1], round(near[0], 6))
    assert {r.click_id: (r.fid, round(r.metres, 6)) for r in got.collect()} == want and len(want) > 20
    with pytest.raises(ValueError):
        clicks.nearest_line(got, got, 0)


def test_precedence(spark):
    roads = spark.createDataFrame([(1, line((0, 0), (1, 0))), (2, line((0, 0.00005), (1, 0.00005)))], f"fid long, vertices {LINE}")
    square = lambda x, y, s: line((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))
    zones = spark.createDataFrame([(5, ("Polygon", [square(0.2, -0.1, 0.2), square(0.25, -0.05, 0.1)])), (6, ("MultiPolygon", [square(0.35, -0.1, 0.2), square(2, 2, 1)]))], SHAPE)
    rivers = spark.createDataFrame([(8, ("MultiLineString", [line((0.5, -1), (0.5, 1)), line((5, 5), (6, 6))]))], SHAPE)
    stops = spark.createDataFrame([(7, ("MultiPoint", [line((0.6, 0), (0.9, 0.5))])), (3, ("Point", [line((0.6, 0.00001))]))], SHAPE)
    places = {
        0: (0.1, 0.00001),  # a road alone
        1: (0.22, 0.00001),  # a road in a zone
        2: (0.3, 0.0),  # a road, in the hole of a zone
        3: (0.22, 0.05),  # a zone, off the roads
        4: (0.6, 0.0),  # a stop over a road
        5: (0.5, 0.00004),  # a river over a road, in a zone
        6: (0.38, 0.0),  # a road in two zones: the smaller fid
        7: (0.9, 0.5),  # a stop
        8: (3.0, 3.0),  # nothing
        9: (2.5, 2.5),  # in the second part of a zone
        10: (0.3, 0.0),  # in a hole, off the roads
    }
    places[10] = (0.3, 0.02)
    at = spark.createDataFrame([(i, *p) for i, p in places.items()], "click_id long, x double, y double")
    layers = [clicks.ClickLayer("zones", zones, under=True), clicks.ClickLayer("rivers", rivers), clicks.ClickLayer("stops", stops, reach_m=3)]
    got = {r.click_id: (r.hit, r.layer, r.fid, [tuple(o) for o in r.overlays]) for r in clicks.click(at, roads, layers, cell=0.05).collect()}
    assert got == {
        0: ("road", "roads", 1, []),
        1: ("road", "roads", 1, [("zones", 5)]),
        2: ("road", "roads", 1, []),
        3: ("under", "zones", 5, []),
        4: ("over", "stops", 7, []),
        5: ("over", "rivers", 8, []),
        6: ("road", "roads", 1, [("zones", 5)]),
        7: ("over", "stops", 7, []),
        9: ("under", "zones", 6, []),
    }
    assert {r.click_id: r.hit for r in clicks.click(at, roads).collect()} == dict.fromkeys((0, 1, 2, 4, 5, 6), "road")
    assert clicks.click(at.limit(0), roads, layers).collect() == []
