"""What lies under a click: the nearest road within reach, and overlays over and under the roads.

Clicks meet roads and overlays by equi-joins on grid cells, of a segment's or a feature's box widened by the reach, so no
click is compared with all edges; a busy cell is a skewed key, which adaptive execution splits. Each click keeps one road and one
feature of each overlay, by aggregates that combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import DEGREE_M
from waymesh.operators.verbs import hit_test

REACH_M = 10.0  # how far from a line or a point a click still hits it
CELL = 0.01  # degrees


@dataclass(frozen=True)
class ClickLayer:
    """An overlay that takes clicks: fid and geometry. Later layers lie over earlier ones of the same side of the roads."""

    name: str
    df: DataFrame
    under: bool = False
    reach_m: float = REACH_M


def _cells(df: DataFrame, minx: Column, miny: Column, maxx: Column, maxy: Column, cell: float) -> DataFrame:
    """df once for each cell (cx, cy) that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return df.withColumn("cx", F.explode(span(minx, maxx))).withColumn("cy", F.explode(span(miny, maxy)))


def segment_metres(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance of a point from a segment, in metres on the plane through the point."""
    kx = F.cos(F.radians(py)) * DEGREE_M
    x0, y0, x1, y1 = (ax - px) * kx, (ay - py) * DEGREE_M, (bx - px) * kx, (by - py) * DEGREE_M
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    along = F.when(square > 0, F.least(F.greatest(-(x0 * dx + y0 * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x0 + along * dx, y0 + along * dy)


def nearest_line(points: DataFrame, lines: DataFrame, reach_m: float = REACH_M, cell: float = CELL, point_id: str = "click_id", fid: str = "fid", parts: Column | None = None) -> DataFrame:
    """(point_id, fid, metres): of each point (x, y in degrees) the nearest line within reach_m, ties to the smaller fid. Points
    without one give no row.

    lines: fid and parts, by default the one line in vertices; a part of one vertex is a point. Null ids count as ids, nulls
    in a place or a geometry never hit, copies of a point are one point. Distances are right to a thousandth within some
    kilometres, which bounds reach_m; within a degree of the poles nothing is found.
    """
    if not 0 < reach_m <= 5000:
        raise ValueError("reach_m must be within 0 and 5000")
    part = F.explode(F.array("vertices") if parts is None else parts)
    vertices = lines.select(F.col(fid).alias("fid"), part.alias("v")).filter(F.size("v") > 0)
    ends = F.when(F.size("v") == 1, F.array(F.struct(F.col("v")[0].alias("p"), F.col("v")[0].alias("q")))).otherwise(
        F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    )
    segments = vertices.select("fid", F.explode(ends).alias("s")).select("fid", *[F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "pq" for c in "xy"])
    segments = segments.filter(F.greatest(F.abs("py"), F.abs("qy")) < 89)
    pad = F.lit(reach_m / DEGREE_M * 1.001)
    wide = pad / F.cos(F.radians(F.least(F.greatest(F.abs("py"), F.abs("qy")) + pad, F.lit(89.5))))
    low, high = lambda c: F.least(f"p{c}", f"q{c}"), lambda c: F.greatest(f"p{c}", f"q{c}")
    spread = _cells(segments, low("x") - wide, low("y") - pad, high("x") + wide, high("y") + pad, cell)
    at = points.select(F.col(point_id).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(F.abs("y") < 89)
    at = at.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    metres = segment_metres(*map(F.col, ("x", "y", "px", "py", "qx", "qy")))
    near = at.join(spread, ["cx", "cy"]).select("id", "fid", metres.alias("metres")).filter(F.col("metres") <= reach_m)
    best = near.groupBy("id").agg(F.min(F.struct("metres", "fid")).alias("best"))
    return best.select(F.col("id").alias(point_id), F.col("best.fid").alias("fid"), F.col("best.metres").alias("metres"))


def in_areas(points: DataFrame, areas: DataFrame, cell: float = CELL, point_id: str = "click_id", fid: str = "fid") -> DataFrame:
    """(point_id, fid): of each point the area with the smallest fid that holds it. areas: fid and geometry, whose rings may be
    outer ones and holes of one or several polygons: a point is inside where an odd number of rings hold it."""
    rings = areas.select(F.col(fid).alias("fid"), F.posexplode("geometry.parts").alias("n", "ring")).filter(F.size("ring") > 3)
    rings = rings.select(F.struct("fid", "n").alias("area_id"), "ring")
    held = hit_test(rings, points.select(F.col(point_id).alias("id"), "x", "y").distinct(), cell=cell)
    odd = held.groupBy("id", "area_id.fid").agg(F.count("*").alias("n")).filter(F.col("n") % 2 == 1)
    return odd.groupBy("id").agg(F.min("fid").alias("fid")).select(F.col("id").alias(point_id), "fid")


def _hits(clicks: DataFrame, layer: ClickLayer, cell: float) -> DataFrame:
    """(click_id, fid, metres) of one overlay: in its areas, else at its lines and points."""
    kind = F.col("geometry.gtype")
    areas = in_areas(clicks, layer.df.filter(kind.endswith("Polygon")), cell).withColumn("metres", F.lit(0.0))
    others = layer.df.filter(kind.endswith("LineString") | kind.endswith("Point"))
    loose = F.when(kind.endswith("Point"), F.transform(F.flatten("geometry.parts"), lambda p: F.array(p))).otherwise(F.col("geometry.parts"))
    found = areas.unionByName(nearest_line(clicks, others, layer.reach_m, cell, parts=loose))
    return found.groupBy("click_id").agg(F.min(F.struct("metres", "fid")).alias("best")).select("click_id", "best.fid", "best.metres")


def click(clicks: DataFrame, roads: DataFrame, overlays: Sequence[ClickLayer] = (), reach_m: float = REACH_M, cell: float = CELL) -> DataFrame:
    """What each click (click_id, x, y) selects: click_id, hit (over, road or under), layer, fid, metres, and overlays, which
    lists the overlays under the click as (layer, fid), topmost first, where a road is selected.

    Overlays over the roads win, the topmost first, then the nearest road, then overlays under the roads. Clicks that hit nothing
    give no row. Roads: fid and vertices."""
    found = nearest_line(clicks, roads, reach_m, cell).select("click_id", F.lit(1).alias("side"), F.lit(0).alias("depth"), F.lit("roads").alias("layer"), "fid", "metres")
    for i, layer in enumerate(overlays):
        side = F.lit(2 if layer.under else 0)
        found = found.unionByName(_hits(clicks, layer, cell).select("click_id", side.alias("side"), F.lit(-i).alias("depth"), F.lit(layer.name).alias("layer"), "fid", "metres"))
    one = F.struct("side", "depth", "layer", "fid", "metres")
    # At most one row for each overlay and click, so the list is as long as there are overlays.
    under = F.sort_array(F.collect_list(F.when(F.col("side") != 1, one)))
    best = found.groupBy("click_id").agg(F.min(one).alias("best"), under.alias("others"))
    listed = F.transform("others", lambda o: F.struct(o["layer"].alias("layer"), o["fid"].alias("fid")))
    hit = F.element_at(F.array(F.lit("over"), F.lit("road"), F.lit("under")), F.col("best.side") + 1)
    return best.select("click_id", hit.alias("hit"), "best.layer", "best.fid", "best.metres", F.when(F.col("best.side") == 1, listed).otherwise(F.array().cast("array<struct<layer:string,fid:bigint>>")).alias("overlays"))
