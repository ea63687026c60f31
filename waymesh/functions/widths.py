"""Line widths in pixels by class and zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the road model.
Z_ORDER = {
    "motorway": 9, "trunk": 8, "primary": 7, "secondary": 6, "tertiary": 5, "unclassified": 4, "residential": 4, "road": 4, "busway": 4, "raceway": 5,
    "living_street": 3, "pedestrian": 2, "service": 1.5, "track": 1.1, "footway": 1, "path": 1, "cycleway": 1, "bridleway": 1, "corridor": 1, "steps": 0.9,
    "platform": 0.5, "construction": 0,
}
GROUP = {
    "motorway": "major", "trunk": "major", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary", "unclassified": "residential",
    "residential": "residential", "road": "residential", "busway": "residential", "raceway": "tertiary", "living_street": "living_street", "service": "service",
    "pedestrian": "pedestrian", "footway": "path", "path": "path", "cycleway": "path", "steps": "path", "bridleway": "path", "track": "path", "corridor": "path",
    "construction": "path",
}
CASING_RATIO = {"major": 1.17, "primary": 1.18, "secondary": 1.19, "tertiary": 1.21, "residential": 1.24, "living_street": 1.24, "service": 1.27, "pedestrian": 1.21, "path": 1.0}
RATE = {"major": 2.0, "primary": 2.0, "secondary": 2.0, "tertiary": 1.95, "residential": 1.9, "living_street": 1.9, "service": 1.9, "pedestrian": 1.85, "path": 1.3}
WIDTH = {
    "major": {8: 0.8, 10: 1.3, 12: 3.5, 13: 6, 14: 8, 15: 10, 16: 13, 17: 17, 18: 22},
    "primary": {8: 0.7, 10: 1.2, 12: 3.5, 13: 5, 14: 7, 15: 9, 16: 12, 17: 15, 18: 19},
    "secondary": {10: 0.8, 12: 2.5, 13: 4, 14: 6, 15: 8, 16: 10, 17: 13, 18: 17},
    "tertiary": {12: 2, 13: 3, 14: 4.5, 15: 6, 16: 8, 17: 11, 18: 14},
    "residential": {12: 0.5, 13: 1.5, 14: 2.5, 15: 4, 16: 6, 17: 9, 18: 13},
    "living_street": {13: 2, 14: 2.5, 15: 4, 16: 6, 17: 9, 18: 13},
    "service": {13: 0.8, 14: 1.2, 15: 2, 16: 2.8, 17: 4, 18: 5},
    "pedestrian": {13: 2, 14: 3, 15: 4, 16: 6, 17: 9, 18: 13},
    "path": {12: 0.4, 13: 0.6, 14: 0.8, 15: 1, 16: 1.4, 17: 2, 18: 2.6, 19: 3},
}
ZOOMS = tuple(range(12, 21))
LINKS = ("motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
LINK_SCALE = 0.6
OTHER = "residential"


def width_at(group: str, zoom: float) -> float:
    """Linear between the stops of a group, flat below the first, growing by its rate above the last."""
    stops = sorted(WIDTH[group].items())
    (first, low), (last, high) = stops[0], stops[-1]
    if zoom <= first:
        return float(low)
    if zoom >= last:
        return high * RATE[group] ** (zoom - last)
    (a, x), (b, y) = next((p, q) for p, q in zip(stops, stops[1:]) if zoom <= q[0])
    return x + (y - x) * (zoom - a) / (b - a)


def _base(name: str) -> tuple[str, bool]:
    return (name.removesuffix("_link"), name.endswith("_link"))


def width_table(spark: SparkSession, casing: bool = False, scale: float = 1.0) -> DataFrame:
    """(class, zoom, width): a few hundred rows, for a broadcast join on both. The class "" stands for all others."""
    rows = []
    for name in (*GROUP, *LINKS, ""):
        base, link = _base(name)
        group = GROUP.get(base, OTHER)
        for z in ZOOMS:
            w = width_at(group, z) * (CASING_RATIO[group] if casing else 1) * scale * (LINK_SCALE if link else 1)
            rows.append((name, z, round(w, 2)))
    return spark.createDataFrame(rows, "class string, zoom int, width double")


def ramp_in(zoom: Column, start: float) -> Column:
    """From 0 at start to 1 two zooms later."""
    return F.least(F.greatest((zoom - start) / 2.0, F.lit(0.0)), F.lit(1.0))


def lane_width(width: Column, twoway: Column, zoom: Column, split_zoom: float = 15, split_frac: float = 0.6) -> Column:
    """Two-way lanes narrow to split_frac of the road once they have parted."""
    f = F.round(F.lit(1.0) - (1 - split_frac) * ramp_in(zoom, split_zoom), 3)
    return F.when(twoway, width * f).otherwise(width)


def lane_offset(width: Column, twoway: Column, zoom: Column, frac: float = 0.28, start: float = 15) -> Column:
    """How far a lane of a two-way road is shifted, in pixels."""
    return F.when(twoway, F.round(width * frac * ramp_in(zoom, start), 3)).otherwise(F.lit(0.0))


def z_order(base: Column) -> Column:
    table = F.create_map(*[x for k, v in Z_ORDER.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, base), F.lit(4.0))


def draw_rank(class_name: Column, lvl: Column) -> Column:
    """Draw order: elevation first, then importance; a link lies just under its road."""
    base = F.regexp_replace(F.coalesce(class_name, F.lit("")), "_link$", "")
    link = F.when(F.coalesce(class_name, F.lit("")).endswith("_link"), F.lit(0.5)).otherwise(F.lit(0.0))
    known = F.create_map(*[x for k in (*GROUP, *LINKS) for x in (F.lit(k), F.lit(True))])
    listed = F.coalesce(F.try_element_at(known, F.coalesce(class_name, F.lit(""))), F.lit(False))
    return F.coalesce(lvl, F.lit(0)) * 1000.0 + F.when(listed, z_order(base) - link).otherwise(F.lit(4.0))
