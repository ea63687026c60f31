"""Geometry as array<struct<x, y>> (a line), with higher-order functions; numpy only where a line is reshaped.

The numpy parts are UDFs over Arrow batches: simplification and clipping work on all lines of a batch at once, parts of lines, offsets
and buffers line by line.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE_TYPE = T.ArrayType(POINT_TYPE)
LINES_TYPE = T.ArrayType(LINE_TYPE)
GEOMETRY_TYPE = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("parts", LINES_TYPE)])
LINE = "array<struct<x:double,y:double>>"
LINES = f"array<{LINE}>"
WORLD = 20037508.342789244  # half the width of the web-mercator square, metres
DEGREE_M = 111320.0
PIXEL_M = 156543.03392


def line(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def steps(v: Column) -> Column:
    """Lengths of a line's segments."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))

    return let(v, pairs)


def length(v: Column) -> Column:
    return F.aggregate(steps(v), F.lit(0.0), lambda total, d: total + d)


def bounds(v: Column) -> Column:
    def box(w: Column) -> Column:
        xs, ys = F.transform(w, lambda p: p["x"]), F.transform(w, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))

    return let(v, box)


def is_finite(v: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda p: ok(p["x"]) & ok(p["y"]))


def node_key(c: Column) -> Column:
    """A coordinate rounded to six decimals, half to even, as millionths: an exact join key."""
    return F.bround(c * 1e6, 0).cast("bigint")


def mercator_x(lon: Column) -> Column:
    return lon * (WORLD / 180.0)


def mercator_y(lat: Column) -> Column:
    lat = F.least(F.greatest(lat, F.lit(-89.9)), F.lit(89.9))
    return F.log(F.tan((lat + 90.0) * (math.pi / 360.0))) * (WORLD / math.pi)


def lon_of(x: Column) -> Column:
    return x / WORLD * 180.0


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y * (math.pi / WORLD))) - math.pi / 2)


def to_mercator(v: Column) -> Column:
    return F.transform(v, lambda p: F.struct(mercator_x(p["x"]).alias("x"), mercator_y(p["y"]).alias("y")))


def from_mercator(v: Column) -> Column:
    return F.transform(v, lambda p: F.struct(lon_of(p["x"]).alias("x"), lat_of(p["y"]).alias("y")))


#: The GRS 80 ellipsoid's third flattening and rectifying radius, and the series of the inverse transverse
#: Mercator projection (Krueger, 1912) to the third order; UTM's scale and false origin.
_N = 1 / (2 * 298.257222101 - 1)
_RADIUS = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def from_utm(v: Column, meridian: float, south: bool) -> Column:
    """Longitude and latitude of a line in a zone of UTM, to a millimetre within the zone."""

    def point(p: Column) -> Column:
        up = (p["y"] - (UTM_SOUTH if south else 0.0)) / (UTM_SCALE * _RADIUS)
        right = (p["x"] - UTM_EAST) / (UTM_SCALE * _RADIUS)
        xi, eta = up, right
        for i, b in enumerate(_BETA, 1):
            xi = xi - b * F.sin(2 * i * up) * F.cosh(2 * i * right)
            eta = eta - b * F.cos(2 * i * up) * F.sinh(2 * i * right)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi
        for i, d in enumerate(_DELTA, 1):
            lat = lat + d * F.sin(2 * i * chi)
        return F.struct((F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + meridian).alias("x"), F.degrees(lat).alias("y"))

    return F.transform(v, point)


def local_metres(v: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east and north of (lon0, lat0), for short distances."""
    kx = F.cos(F.radians(lat0)) * DEGREE_M
    return F.transform(v, lambda p: F.struct(((p["x"] - lon0) * kx).alias("x"), ((p["y"] - lat0) * DEGREE_M).alias("y")))


def from_local(v: Column, lon0: Column, lat0: Column) -> Column:
    kx = F.cos(F.radians(lat0)) * DEGREE_M
    return F.transform(v, lambda p: F.struct(F.bround(p["x"] / kx + lon0, 6).alias("x"), F.bround(p["y"] / DEGREE_M + lat0, 6).alias("y")))


def metres_per_pixel(lat: Column, zoom: float) -> Column:
    return F.cos(F.radians(lat)) * (PIXEL_M / 2**zoom)


def mid_vertex(v: Column) -> Column:
    return F.element_at(v, F.floor(F.size(v) / 2).cast("int") + 1)


# -- numpy ----------------------------------------------------------------------------------------------------------


def flat(v: Column) -> Column:
    """A line as x0, y0, x1, y1, ...: the form in which lines go to numpy and back without a Python object per vertex."""
    return F.flatten(F.transform(v, lambda p: F.array(p["x"], p["y"])))


def unflat(c: Column) -> Column:
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / 2).cast("int") - 1), lambda i: F.struct(F.get(w, 2 * i).alias("x"), F.get(w, 2 * i + 1).alias("y")))
    return let(c, lambda w: F.when(F.size(w) > 0, pairs(w)).otherwise(F.array().cast(LINE)))


def _points(value) -> np.ndarray:
    if len(value) and isinstance(value[0], dict):
        value = [(p["x"], p["y"]) for p in value]
    return np.asarray(value, float).reshape(-1, 2)


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of some counts: the group of each member, and its number within the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - (np.cumsum(counts) - counts)[group]


def mercator_points(points: np.ndarray) -> np.ndarray:
    """to_mercator of many points."""
    lat = np.clip(points[:, 1], -89.9, 89.9)
    return np.stack([points[:, 0] * (WORLD / 180.0), np.log(np.tan((lat + 90.0) * (math.pi / 360.0))) * (WORLD / math.pi)], axis=1)


def simplify_lines(points: np.ndarray, sizes: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Douglas and Peucker, 1973, on many lines at once: which points stay. sizes: points of each line.

    Each round looks at all stretches of all lines that are still open, and opens the two halves of those whose farthest
    point is beyond the tolerance; so rounds are as many as the deepest line needs."""
    keep = np.zeros(len(points), bool)
    lines = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)[lines] - 1
    a, b, limit = ends - sizes[lines] + 1, ends, np.asarray(tolerance, float)[lines]
    keep[a] = keep[b] = True
    while len(a := a[(wide := b - a > 1)]):
        b, limit = b[wide], limit[wide]
        of, nth = _each(b - a - 1)
        at = a[of] + 1 + nth
        d, inner = (points[b] - points[a])[of], points[at] - points[a][of]
        norm = (d * d).sum(axis=1)
        t = np.divide((inner * d).sum(axis=1), norm, out=np.zeros(len(at)), where=norm > 0).clip(0, 1)
        away = np.hypot(*(inner - t[:, None] * d).T)
        begin = np.cumsum(b - a - 1) - (b - a - 1)
        most = np.maximum.reduceat(away, begin)
        far = np.minimum.reduceat(np.where(away == most[of], at, len(points)), begin)
        split = most > limit
        keep[far[split]] = True
        a, b, limit = np.concatenate((a[split], far[split])), np.concatenate((far[split], b[split])), np.concatenate((limit[split], limit[split]))
    return keep


def simplify_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    return points[simplify_lines(points, np.array([len(points)]), np.array([tolerance]))]


def clip_lines(points: np.ndarray, sizes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of many lines within a rectangle each (Liang and Barsky, 1984): points, the points of each part, the parts of each
    line. boxes: a row (minx, miny, maxx, maxy) for each line. A line that only touches its rectangle in one point has no part
    unless it is a single segment."""
    sides = np.maximum(sizes - 1, 0)
    line, nth = _each(sides)
    first = (np.cumsum(sizes) - sizes)[line] + nth
    p, q = points[first], points[first + 1]
    d, box = q - p, boxes[line]
    t0, t1 = np.zeros(len(p)), np.ones(len(p))
    for axis in (0, 1):
        for edge, sign in ((box[:, axis], -1.0), (box[:, axis + 2], 1.0)):
            room, speed = sign * (edge - p[:, axis]), sign * d[:, axis]
            at = np.divide(room, speed, out=np.zeros(len(p)), where=speed != 0)
            t1 = np.where(speed > 0, np.minimum(t1, at), t1)
            t0 = np.where(speed < 0, np.maximum(t0, at), np.where((speed == 0) & (room < 0), 2.0, t0))
    seen = np.flatnonzero((t0 < t1) | ((t0 == t1) & (sizes[line] == 2)))
    p, q, d, t0, t1, line = p[seen], q[seen], d[seen], t0[seen], t1[seen], line[seen]
    a = np.where(t0[:, None] == 0, p, p + t0[:, None] * d)
    b = np.where(t1[:, None] == 1, q, p + t1[:, None] * d)
    new = np.ones(len(seen), bool)  # does not go on where the side before it ended
    new[1:] = (seen[1:] != seen[:-1] + 1) | (line[1:] != line[:-1]) | (t0[1:] > 0) | (t1[:-1] < 1)
    place = np.cumsum(1 + new) - 1
    out = np.empty((int(new.sum()) + len(seen), 2))
    out[place] = b
    out[place[new] - 1] = a[new]
    part = np.cumsum(new) - 1
    of_part = 1 + np.bincount(part) if len(part) else np.zeros(0, np.int64)
    return out, of_part, np.bincount(line[new], minlength=len(sizes))


def clip_points(points: np.ndarray, box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The parts of one line within a rectangle."""
    out, parts, _ = clip_lines(points, np.array([len(points)]), np.array([box], float))
    return np.split(out, np.cumsum(parts)[:-1]) if len(parts) else []


def _mitres(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many lines their points without repeated ones, how many each has, and which way a shift to the left moves each point
    (mitred corners). A line without length has no points."""
    line, nth = _each(sizes)
    keep = nth == 0
    step = np.diff(points, axis=0, prepend=points[:1])
    keep |= np.hypot(*step.T) > 0
    long = np.bincount(line[keep], minlength=len(sizes)) > 1
    keep &= long[line]
    points, line = points[keep], line[keep]
    sizes = np.bincount(line, minlength=len(sizes))
    if not len(points):
        return points, sizes, points
    d = np.diff(points, axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):  # what lies between two lines isn't used
        normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    i = np.arange(len(points))
    first, last = np.ones(len(points), bool), np.ones(len(points), bool)
    first[1:] = last[:-1] = line[1:] != line[:-1]
    before, after = normal[np.where(first, i, i - 1)], normal[np.where(last, i - 1, i)]
    bend = 1 + (before * after).sum(axis=1)
    return points, sizes, (before + after) / np.maximum(bend, 0.1)[:, None]


def offset_lines(points: np.ndarray, sizes: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Many lines shifted to their left, each by its distance: points, and how many each line has."""
    points, sizes, mitre = _mitres(points, sizes)
    return points + np.repeat(distance, sizes)[:, None] * mitre, sizes


def buffer_lines(points: np.ndarray, sizes: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closed outlines of ribbons of width 2*half with flat ends along many lines."""
    points, sizes, mitre = _mitres(points, sizes)
    shift = np.repeat(half, sizes)[:, None] * mitre
    left, right = points + shift, points - shift
    rings = np.where(sizes > 0, 2 * sizes + 1, 0)
    line, nth = _each(rings)
    n, start = sizes[line], (np.cumsum(sizes) - sizes)[line]
    back = (nth >= n) & (nth < 2 * n)
    at = start + np.where(back, 2 * n - 1 - nth, nth % np.maximum(2 * n, 1))
    return np.where(back[:, None], right[at], left[at]), rings


def offset_points(points: np.ndarray, distance: float) -> np.ndarray:
    """The line shifted to its left by distance, with mitred corners."""
    return offset_lines(points, np.array([len(points)]), np.array([distance]))[0]


def buffer_points(points: np.ndarray, half: float) -> np.ndarray:
    """The closed outline of a ribbon of width 2*half with flat ends."""
    return buffer_lines(points, np.array([len(points)]), np.array([half]))[0]


def part_of(points: np.ndarray, along: np.ndarray, start: float, end: float) -> np.ndarray:
    """The part of a line between two distances along it; along: the distance of each point."""
    at = np.array([start, end])
    ends = np.stack([np.interp(at, along, points[:, 0]), np.interp(at, along, points[:, 1])], axis=1)
    return np.concatenate((ends[:1], points[np.searchsorted(along, start, "right") : np.searchsorted(along, end, "left")], ends[1:]))


def distances(points: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))))


def distances_of_lines(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """distances of many lines. Lines of as many points are summed together, each on its own from its start."""
    out = np.zeros(len(points))
    step = np.hypot(*np.diff(points, axis=0, prepend=points[:1]).T)
    begin = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 1]):
        at = begin[sizes == n][:, None] + np.arange(1, n)
        out[at] = np.cumsum(step[at], axis=1)
    return out


def parts_of_lines(points: np.ndarray, sizes: np.ndarray, along: np.ndarray, line: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """part_of for many parts of many lines: points, and how many each part has. line: that of each part."""
    n, of = len(line), _each(sizes)[0]
    # Where starts and ends come among the points of their line; of equal distances, ends that leave a point out come first.
    owner = np.concatenate((of, line, line, line))
    value = np.concatenate((along, start, end, end))
    rank = np.repeat((1, 2, 2, 0), (len(along), n, n, n))
    order = np.lexsort((rank, value, owner))
    passed = np.empty(len(order), np.int64)
    passed[order] = np.cumsum(order < len(along))
    after_start, after_end, before_end = np.split(passed[len(along) :], 3)
    begin, last = (np.cumsum(sizes) - sizes)[line], np.cumsum(sizes)[line] - 1

    def between(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        j = np.clip(after - 1, begin, last)
        k = np.minimum(j + 1, last)
        gap = along[k] - along[j]
        slope = np.divide(points[k] - points[j], gap[:, None], out=np.zeros((n, 2)), where=gap[:, None] > 0)
        return np.where(((at <= along[j]) | (j == last))[:, None], points[j], slope * (at - along[j])[:, None] + points[j])

    inner = np.maximum(before_end - after_start, 0)
    out_sizes = inner + 2
    part, nth = _each(out_sizes)
    at = np.minimum(after_start[part] + nth - 1, len(points) - 1)
    out = points[np.maximum(at, 0)]
    out[nth == 0] = between(start, after_start)
    out[nth == out_sizes[part] - 1] = between(end, after_end)
    return out, out_sizes


PAIRS = 1 << 20  # of sides that are compared at once


def are_simple(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of many closed outlines have no two sides that cross. All pairs of sides of an outline, some of them at a time: for
    outlines of one slice."""
    out = np.ones(len(sizes), bool)
    begin = np.cumsum(sizes) - sizes
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    for n in np.unique(sizes[sizes > 1]):
        alike = np.flatnonzero(sizes == n)
        rings, sides = max(1, PAIRS // int(n - 1) ** 2), max(1, PAIRS // int(n - 1))
        for first in range(0, len(alike), rings):
            some = alike[first : first + rings]
            ring = points[begin[some][:, None] + np.arange(n)]
            c, d = ring[:, None, :-1], ring[:, None, 1:]
            for at in range(0, int(n) - 1, sides):
                a, b = ring[:, at : min(at + sides, n - 1), None], ring[:, at + 1 : min(at + sides, n - 1) + 1, None]
                crossing = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
                out[some] &= ~crossing.any(axis=(1, 2))
    return out


def is_simple(ring: np.ndarray) -> bool:
    return bool(are_simple(ring, np.array([len(ring)]))[0])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _substring(lines: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([part_of(p := _points(v), distances(p), a, b).ravel() if v is not None and len(v) else v for v, a, b in zip(lines, start, end)])


def _from_arrow(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The points of all lines, and how many each has; null lines have none."""
    flat = lines.flatten()
    return np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1), pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _to_arrow(points: np.ndarray, sizes: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(sizes), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]), mask=null)


@F.arrow_udf(LINE_TYPE)
def _simplify(lines: pa.Array, tolerance: pa.Array) -> pa.Array:
    points, sizes = _from_arrow(lines)
    keep = simplify_lines(points, sizes, tolerance.to_numpy(zero_copy_only=False))
    line, _ = _each(sizes)
    return _to_arrow(points[keep], np.bincount(line[keep], minlength=len(sizes)), lines.is_null())


@F.arrow_udf(LINES_TYPE)
def _clip(lines: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    points, sizes = _from_arrow(lines)
    out, of_part, of_line = clip_lines(points, sizes, np.stack([c.to_numpy(zero_copy_only=False) for c in (minx, miny, maxx, maxy)], axis=1))
    return pa.ListArray.from_arrays(_offsets(of_line), _to_arrow(out, of_part))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _offset(lines: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([offset_points(_points(v), d).ravel() for v, d in zip(lines, distance)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _ribbon(lines: pd.Series, half: pd.Series) -> pd.Series:
    return pd.Series([buffer_points(_points(v), h).ravel() for v, h in zip(lines, half)])


def simplify(v: Column, tolerance: Column) -> Column:
    return _simplify(v.cast(LINE), tolerance.cast("double"))


def substring(v: Column, start: Column, end: Column) -> Column:
    """The part of a line between two distances along it."""
    return unflat(_substring(flat(v), start, end))


def clip(v: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The parts of a line within a rectangle."""
    return _clip(v.cast(LINE), *[c.cast("double") for c in (minx, miny, maxx, maxy)])


def offset(v: Column, distance: Column) -> Column:
    """The line shifted to its left."""
    return unflat(_offset(flat(v), distance))


def ribbon(v: Column, half: Column) -> Column:
    """The outline of a ribbon along a line."""
    return unflat(_ribbon(flat(v), half))


def _read_wkb(data: bytes) -> tuple[str, list[np.ndarray]]:
    """(type, parts) of a line, a multi-line, a point or a polygon; each part as x0, y0, x1, y1, ..."""
    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}

    def one(at: int) -> tuple[str, list[np.ndarray], int]:
        order = "<" if data[at] else ">"
        code = int(np.frombuffer(data, order + "u4", 1, at + 1)[0])
        at += 9 if code & 0x20000000 else 5
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = code & 0xFF
        if 1000 <= (code & 0xFFFF) < 4000:
            dims, kind = 2 + ((code & 0xFFFF) // 1000 == 3) + 1, (code & 0xFFFF) % 1000

        def run(at: int, n: int) -> tuple[np.ndarray, int]:
            xy = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)
            return xy[:, :2].ravel(), at + 8 * n * dims

        count = lambda at: int(np.frombuffer(data, order + "u4", 1, at)[0])
        if kind == 1:
            part, at = run(at, 1)
            return names[kind], [part], at
        if kind == 2:
            part, at = run(at + 4, count(at))
            return names[kind], [part], at
        parts, n = [], count(at)
        at += 4
        for _ in range(n):
            if kind == 3:
                part, at = run(at + 4, count(at))
                parts.append(part)
            else:
                _, more, at = one(at)
                parts += more
        return names[kind], parts, at

    return one(0)[:2]


def _read_wkt(text: str) -> tuple[str, list[np.ndarray]]:
    head, _, rest = text.partition("(")
    kind = {n.upper(): n for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}[head.split()[0].upper()]
    parts = []
    for part in rest.replace("(", "|").replace(")", "|").split("|"):
        if part.strip(" ,"):
            parts.append(np.array([p.split()[:2] for p in part.strip(" ,").split(",")], float).ravel())
    return kind, parts


def _decoded(values: Iterator, reader) -> pd.DataFrame:
    rows = []
    for v in values:
        try:
            rows.append(reader(v) if v is not None else (None, None))
        except (ValueError, KeyError, IndexError):
            rows.append((None, None))  # dropped later with the other unusable geometries
    return pd.DataFrame(rows, columns=["gtype", "parts"])


_FLAT_TYPE = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.DoubleType())))])


@F.pandas_udf(_FLAT_TYPE)
def _wkb(values: pd.Series) -> pd.DataFrame:
    return _decoded(values, lambda v: _read_wkb(bytes(v)))


@F.pandas_udf(_FLAT_TYPE)
def _wkt(values: pd.Series) -> pd.DataFrame:
    return _decoded(values, _read_wkt)


def _geometry(flat_parts: Column) -> Column:
    return let(flat_parts, lambda g: F.struct(g["gtype"].alias("gtype"), F.transform(g["parts"], unflat).alias("parts")))


def from_wkb(c: Column) -> Column:
    return _geometry(_wkb(c))


def from_wkt(c: Column) -> Column:
    return _geometry(_wkt(c))
