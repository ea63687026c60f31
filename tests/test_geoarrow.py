"""Arrow tables with GeoArrow coordinates in both forms, their metadata, and other nested coordinates."""

import json

import pyarrow as pa
import pytest

from waymesh.sources import ingest

XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PAIR = pa.list_(pa.float64(), 2)


def table(kind, values, name=None, crs=None):
    about = {}
    if name:
        about[b"ARROW:extension:name"] = f"geoarrow.{name}".encode()
        about[b"ARROW:extension:metadata"] = json.dumps({} if crs is None else {"crs": crs}).encode()
    fields = [pa.field("highway", pa.string()), pa.field("geometry", kind, metadata=about or None)]
    return pa.table([pa.array([f"r{i}" for i in range(len(values))]), pa.array(values, kind)], schema=pa.schema(fields))


def read(spark, data, keep=False, **more):
    df = ingest.from_arrow(spark, data, **more).df if not keep else ingest.decode_geometry(spark.createDataFrame(data))
    return [None if r.geometry is None else (r.geometry.gtype, [[(p.x, p.y) for p in part] for part in r.geometry.parts]) for r in df.orderBy("highway").collect()]


LINE = [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
as_structs = lambda v: [{"x": x, "y": y} for x, y in v]


@pytest.mark.parametrize("separated", [True, False])
def test_lines(spark, separated):
    point, form = (XY, as_structs) if separated else (PAIR, lambda v: [list(p) for p in v])
    assert read(spark, table(pa.list_(point), [form(LINE), None], "linestring")) == [("LineString", [LINE])]
    assert read(spark, table(pa.list_(point), [form(LINE)])) == [("LineString", [LINE])]  # no metadata at all
    several = table(pa.list_(pa.list_(point)), [[form(LINE), form(LINE[:2])]], "multilinestring")
    assert read(spark, several) == [("MultiLineString", [LINE, LINE[:2]])]
    ring = [*LINE, LINE[0]]
    assert read(spark, table(pa.list_(pa.list_(point)), [[form(ring)], [form(LINE)]], "polygon")) == []  # areas aren't roads
    assert read(spark, table(point, [form(LINE)[0]]), keep=True) == [("Point", [[LINE[0]]])]
    assert read(spark, table(pa.list_(pa.list_(pa.list_(point))), [[[form(ring)], [form(ring)]]]), keep=True) == [("MultiPolygon", [ring, ring])]


def test_coordinate_systems(spark):
    there = [(111319.49079327357, 0.0), (222638.98158654713, 0.0)]
    for crs in ({"id": {"authority": "EPSG", "code": 3857}}, "EPSG:3857"):
        (kind, (line,)), = read(spark, table(pa.list_(XY), [as_structs(there)], "linestring", crs))
        assert kind == "LineString" and [(round(x, 9), round(y, 9)) for x, y in line] == [(1, 0), (2, 0)]
    assert read(spark, table(pa.list_(XY), [as_structs(LINE)], "linestring", "OGC:CRS84")) == [("LineString", [LINE])]
    odd = table(pa.list_(XY), [as_structs(LINE)], "linestring", {"name": "local grid"})
    with pytest.raises(ValueError, match="srid"):
        ingest.from_arrow(spark, odd)
    assert read(spark, odd, srid=4326) == [("LineString", [LINE])]


def test_renamed_columns_and_other_types(spark):
    data = table(pa.list_(XY), [as_structs(LINE)], "linestring").rename_columns(["kind", "shape_of_it"])
    data = data.replace_schema_metadata(None)
    got = ingest.from_arrow(spark, data, rename={"kind": "highway", "shape_of_it": "geometry"}).df.first()
    assert got.highway == "r0" and got.geometry.gtype == "LineString"
    with pytest.raises(ValueError, match="can't read a geometry"):
        ingest.from_arrow(spark, table(pa.list_(pa.int64()), [[1, 2]]))
