"""Inputs: anything that describes edges, as one canonical edge table.

The canonical table has a class column, geometry struct<gtype, parts> in longitude and latitude, vertices (the first
part of a line), and whatever other columns the input had. Reading is lazy; nothing passes through the driver except
objects that are there already (dicts, Arrow tables).
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from functools import singledispatch
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions import geometry as G
from waymesh.operators.filters import drop_counts, drop_non_lines, drop_unusable, require
from waymesh.session import with_dense_ids

#: Names under which a geometry column is looked for, in this order.
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "wkb", "the_geom", "wkt", "shape")
GEOGRAPHIC = frozenset({4326, 4258, 4269, 4619})  # WGS 84, ETRS89, NAD83, SWEREF 99
GEOMETRY_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


@dataclass(frozen=True)
class EdgeTable:
    df: DataFrame
    class_col: str = "highway"
    geometry: str = "geometry"


def find_geometry(df: DataFrame, name: str | None = None) -> str:
    if name is not None:
        require(df, name)
        return name
    by_lower = {c.lower(): c for c in df.columns}
    for candidate in GEOMETRY_NAMES:
        if candidate in by_lower:
            return by_lower[candidate]
    raise ValueError(f"no geometry column among {df.columns}; looked for {GEOMETRY_NAMES}")


def _native(c: Column, kind: T.DataType) -> Column | None:
    """Points, lines and lists of lines of coordinates: of structs (x, y, ...) or of lists [x, y, ...], as GeoArrow has them. None for
    other types. Two levels of lists are a line, three a multi-line; the names of polygons and points of several parts are the
    reader's to give, see from_arrow()."""
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    if isinstance(inner, T.StructType) and set(inner.names) >= {"x", "y"}:
        point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    elif isinstance(inner, T.DoubleType | T.FloatType) and depth:
        depth -= 1
        point = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    else:
        return None
    line = lambda v: F.transform(v, point)
    forms = {0: ("Point", lambda: F.array(F.array(point(c)))), 1: ("LineString", lambda: F.array(line(c))), 2: ("MultiLineString", lambda: F.transform(c, line)), 3: ("MultiPolygon", lambda: F.transform(F.flatten(c), line))}
    if depth not in forms:
        return None
    name, parts = forms[depth]
    return F.when(c.isNotNull(), F.struct(F.lit(name).alias("gtype"), parts().alias("parts")))


def _once(c: Column) -> Column:
    """c, worked out once for each row. A filter on a plain column's expression is pushed below it and works it out again, each time
    that it names it; none is pushed below a generator."""
    return F.explode(F.array(c))


def decode_geometry(df: DataFrame, name: str | None = None) -> DataFrame:
    """The geometry column as struct<gtype, parts>, from WKB bytes, WKT text, a line of vertices or the struct itself. The
    column's type decides; no row is looked at."""
    name = find_geometry(df, name)
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.BinaryType):
        g = _once(G.from_wkb(c))
    elif isinstance(kind, T.StringType):
        g = _once(G.from_wkt(c))
    elif isinstance(kind, T.StructType) and set(kind.names) >= {"gtype", "parts"}:
        g = c
    elif isinstance(kind, T.StructType) and set(kind.names) >= {"type", "coordinates"}:
        g = _once(from_geojson_geometry(c))
    elif (g := _native(c, kind)) is None:
        raise ValueError(f"can't read a geometry from {name}: {kind.simpleString()}")
    out = df.withColumn("geometry", g)
    return out if name == "geometry" else out.drop(name)


def reproject(df: DataFrame, srid: int | None) -> DataFrame:
    """To longitude and latitude. 4326 and other geographic systems within a metre of it stay as they are; 3857 and the
    zones of UTM (and national systems with UTM's projection) have closed forms; others are refused."""
    if srid in GEOGRAPHIC:
        return df
    if srid is None:
        raise ValueError("the coordinate system is unknown; give srid=")
    if srid == 3857:
        back = G.from_mercator
    elif (zone := utm_zone(srid)) is not None:
        back = lambda v: G.from_utm(v, *zone)
    else:
        raise ValueError(f"can't reproject from {srid}; supported are {sorted(GEOGRAPHIC)}, 3857 and the zones of UTM (326xx, 327xx, 258xx, 269xx, 3006)")
    g = F.col("geometry")
    return df.withColumn("geometry", F.when(g.isNotNull(), F.struct(g["gtype"].alias("gtype"), F.transform(g["parts"], back).alias("parts"))))


def utm_zone(srid: int) -> tuple[float, bool] | None:
    """(central meridian, south) of an EPSG code with UTM's projection: WGS 84, ETRS89 and NAD83 zones, and SWEREF 99 TM."""
    if srid == 3006:
        return 15.0, False
    for first, last, base, south in ((32601, 32660, 32600, False), (32701, 32760, 32700, True), (25828, 25838, 25800, False), (26901, 26923, 26900, False)):
        if first <= srid <= last:
            return 6.0 * (srid - base) - 183.0, south
    return None


def check_rows(df: DataFrame, keep_non_lines: bool = False) -> dict[str, int]:
    """How many rows there are, and how many have no usable geometry or no line; df is decoded. Warns of those that
    normalise() will drop; a table without rows, or without any row that stays, is an error. One pass over df."""
    n = drop_counts(df).first().asDict()
    lost = n["unusable"] + (0 if keep_non_lines else n["non_lines"])
    if not n["rows"]:
        raise ValueError("the table is empty")
    if lost == n["rows"]:
        raise ValueError(f"none of {n['rows']} rows has a {'usable geometry' if keep_non_lines else 'line'}")
    if n["unusable"]:
        warnings.warn(f"{n['unusable']} of {n['rows']} rows have no usable geometry and are dropped", stacklevel=3)
    if n["non_lines"] and not keep_non_lines:
        warnings.warn(f"{n['non_lines']} of {n['rows']} rows are no lines and are dropped", stacklevel=3)
    return n


def normalise(df: DataFrame, class_col: str | None = "highway", geometry: str | None = None, srid: int | None = 4326, rename: Mapping[str, str] | None = None, keep_non_lines: bool = False, check: bool = False) -> EdgeTable:
    """Any DataFrame as an edge table: renamed, decoded, without unusable geometries and non-lines, in longitude and
    latitude, NaN as null. check: rows are counted first, see check_rows(); by default nothing is computed here."""
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    if class_col is not None:  # overlays have none
        require(df, class_col)
    df = decode_geometry(df, geometry)
    if check:
        check_rows(df, keep_non_lines)
    df = drop_unusable(df)
    if not keep_non_lines:
        df = drop_non_lines(df)
    df = reproject(df, srid)
    doubles = {f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    if doubles:
        df = df.withColumns(doubles)
    return EdgeTable(df.withColumn("vertices", F.get(F.col("geometry")["parts"], F.lit(0))), class_col)


def with_ids(df: DataFrame, *order: str) -> DataFrame:
    """Adds fid: dense from 0 in the order of some columns, the rest of the row deciding ties."""
    return with_dense_ids(df, *order)


# -- GeoJSON --------------------------------------------------------------------------------------------------------

_VERTICES = "array<array<double>>"


def _vertices(c: Column) -> Column:
    return F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def from_geojson_geometry(c: Column) -> Column:
    """struct<type, coordinates as JSON text> as struct<gtype, parts>."""
    kind, text = c["type"], c["coordinates"].cast("string")
    point = F.array(F.array(F.struct(F.get(F.from_json(text, "array<double>"), F.lit(0)).alias("x"), F.get(F.from_json(text, "array<double>"), F.lit(1)).alias("y"))))
    line = F.array(_vertices(F.from_json(text, _VERTICES)))
    several = F.transform(F.from_json(text, f"array<{_VERTICES}>"), _vertices)
    deep = F.transform(F.flatten(F.from_json(text, f"array<array<{_VERTICES}>>")), _vertices)
    parts = F.when(kind == "Point", point).when(kind.isin("LineString", "MultiPoint"), line).when(kind.isin("MultiLineString", "Polygon"), several).when(kind == "MultiPolygon", deep)
    return F.when(kind.isNotNull(), F.struct(kind.alias("gtype"), parts.alias("parts")))


def geojson_features(obj) -> list[dict]:
    """The features of a collection, a feature, a geometry, a list of features, a saved spec, or an object with
    __geo_interface__."""
    if hasattr(obj, "__geo_interface__") and not isinstance(obj, Mapping):
        obj = obj.__geo_interface__
    if isinstance(obj, Mapping):
        obj = obj["geojson"] if isinstance(obj.get("geojson"), Mapping) else obj
        if "features" in obj:
            return list(obj["features"])
        if obj.get("type") == "Feature":
            return [dict(obj)]
        if obj.get("type") in GEOMETRY_TYPES:
            return [{"type": "Feature", "geometry": dict(obj), "properties": {}}]
    elif isinstance(obj, list | tuple):
        return list(obj)
    raise TypeError("not GeoJSON: a collection, a feature, a geometry, a list of features or a spec is expected")


#: What a JSON value's type is read as. Numbers with decimals are doubles, and what differs from row to row is text.
_JSON_TYPES = (("OBJECT<", "STRUCT<"), (r"DECIMAL\(\d+, ?\d+\)", "DOUBLE"), (r"\bFLOAT\b", "DOUBLE"), (r"\b(?:VOID|VARIANT)\b", "STRING"))


def json_schema(text: Column, rows: DataFrame) -> T.StructType:
    """The common schema of JSON objects: one aggregate, no row leaves the JVM."""
    ddl = rows.agg(F.schema_of_variant_agg(F.try_parse_json(text))).first()[0] or "VOID"
    for pattern, kind in _JSON_TYPES:
        ddl = re.sub(pattern, kind, ddl)
    kind = T.StructType.fromDDL(f"v {ddl}")["v"].dataType
    return kind if isinstance(kind, T.StructType) else T.StructType()


def _from_feature_rows(rows: DataFrame, properties: T.StructType | str | None = None) -> DataFrame:
    """rows: one feature as JSON text in value. Properties become columns; properties is their schema, or it is found in a
    pass over all rows."""
    text = F.get_json_object("value", "$.properties")
    schema = json_schema(text, rows) if properties is None else T.StructType.fromDDL(properties) if isinstance(properties, str) else properties
    names = [c for c in schema.names if c != "geometry"]
    parsed = rows.select(F.from_json(text, schema).alias("p") if names else F.lit(None).alias("p"), F.get_json_object("value", "$.geometry.type").alias("t"), F.get_json_object("value", "$.geometry.coordinates").alias("c"))
    geometry = from_geojson_geometry(F.struct(F.col("t").alias("type"), F.col("c").alias("coordinates")))
    return parsed.select(*[F.col(f"p.`{c}`").alias(c) for c in names], _once(geometry).alias("geometry"))


def from_geojson(spark: SparkSession, obj, class_col: str | None = "highway", srid: int = 4326, rename: Mapping[str, str] | None = None, keep_non_lines: bool = False) -> EdgeTable:
    rows = spark.createDataFrame([(json.dumps(f),) for f in geojson_features(obj)], "value string")
    return normalise(_from_feature_rows(rows), class_col, "geometry", srid, rename, keep_non_lines)


def read_geojson(spark: SparkSession, path: str, class_col: str = "highway", rename: Mapping[str, str] | None = None, lines: bool = False, properties: T.StructType | str | None = None) -> EdgeTable:
    """A GeoJSON file, or one feature a line (lines), which Spark can split. A file that isn't in lines is one row, so it
    must be under 2 GB. properties: the schema of the features' properties, which saves the pass that finds it."""
    if lines:
        rows = spark.read.text(path).filter(F.trim("value") != "")
    else:
        text = spark.read.text(path, wholetext=True)
        one = F.coalesce(F.get_json_object("value", "$.geojson.features"), F.get_json_object("value", "$.features"), F.concat(F.lit("["), F.col("value"), F.lit("]")))
        rows = text.select(F.explode(F.from_json(one, "array<string>")).alias("value"))
    return normalise(_from_feature_rows(rows, properties), class_col, "geometry", 4326, rename)


def read_edges(spark: SparkSession, path: str, class_col: str = "highway", geometry: str | None = None, srid: int | None = 4326, rename: Mapping[str, str] | None = None, layer: str | None = None) -> EdgeTable:
    """A file or folder by its ending: parquet, orc, csv, json lines, GeoJSON, shapefile or GeoPackage (with a layer). The latter
    two say which coordinate system they are in."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end == "shp":
        from waymesh.sources.shapefile import read_shapefile

        return read_shapefile(spark, path, class_col, rename=rename)
    if end == "gpkg":
        from waymesh.sources.geopackage import read_geopackage

        return read_geopackage(spark, path, class_col, layer, rename=rename)
    if end in ("geojson", "geojsonl", "geojsons"):
        return read_geojson(spark, path, class_col, rename, lines=end != "geojson")
    if end == "csv":
        df = spark.read.csv(path, header=True)
    elif end in ("json", "jsonl", "ndjson"):
        df = spark.read.json(path)
    elif end == "orc":
        df = spark.read.orc(path)
    else:
        df = spark.read.parquet(path)
    return normalise(df, class_col, geometry, srid, rename)


def from_sql(spark: SparkSession, query: str, class_col: str = "highway", geometry: str | None = None, srid: int | None = 4326, rename: Mapping[str, str] | None = None) -> EdgeTable:
    """A table's name or a query over the session's catalog."""
    df = spark.table(query) if query.replace(".", "").replace("_", "").isalnum() else spark.sql(query)
    return normalise(df, class_col, geometry, srid, rename)


#: GeoArrow's names of geometry types.
GEOARROW = {"point": "Point", "linestring": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon"}


def _geoarrow(field: pa.Field, srid: int | None) -> tuple[str | None, int | None]:
    """(geometry type, EPSG number) that a field's GeoArrow metadata give; None where they give none. With srid the metadata's own
    coordinate system isn't looked at."""
    about = field.metadata or {}
    name = about.get(b"ARROW:extension:name", b"").decode()
    if not name.startswith("geoarrow."):
        return None, None
    crs = json.loads(about.get(b"ARROW:extension:metadata") or b"{}").get("crs")
    if isinstance(crs, dict):
        crs = f"{crs.get('id', {}).get('authority')}:{crs.get('id', {}).get('code')}"
    if crs is None or srid is not None:
        return GEOARROW.get(name.removeprefix("geoarrow.")), None
    if crs == "OGC:CRS84":
        crs = "EPSG:4326"
    known = re.fullmatch(r"EPSG:(\d+)", str(crs))
    if known is None:
        raise ValueError(f"the coordinate system {str(crs)[:80]!r} isn't known; give srid=")
    return GEOARROW.get(name.removeprefix("geoarrow.")), int(known[1])


def from_arrow(spark: SparkSession, table: pa.Table, class_col: str = "highway", geometry: str | None = None, srid: int | None = None, rename: Mapping[str, str] | None = None) -> EdgeTable:
    """An Arrow table with GeoArrow coordinates, WKB or WKT. The coordinate system is srid if given, else what GeoArrow's metadata
    say, else longitude and latitude; so does the geometry type, where the coordinates' nesting leaves it open."""
    df = spark.createDataFrame(table)
    name = find_geometry(df if not rename else df.withColumnsRenamed(dict(rename)), geometry)
    back = {v: k for k, v in (rename or {}).items()}
    field = table.schema.field(back.get(name, name))
    gtype, own = _geoarrow(field, srid)
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    if gtype is not None:
        df = decode_geometry(df, name)
        g = F.col("geometry")
        # Nesting tells lines of points from lists of lines; the metadata tell rings from lines, and several points from a line.
        df = df.withColumn("geometry", F.when(g.isNotNull(), F.struct(F.lit(gtype).alias("gtype"), g["parts"].alias("parts"))))
        name = "geometry"
    return normalise(df, class_col, name, srid or own or 4326)


@singledispatch
def as_edges(data, spark: SparkSession, **options) -> EdgeTable:
    """An edge table from a DataFrame, an Arrow table, a path, GeoJSON, or an edge table as it is."""
    return from_geojson(spark, data, **options)


@as_edges.register
def _(data: EdgeTable, spark: SparkSession, **options) -> EdgeTable:
    return data


@as_edges.register
def _(data: DataFrame, spark: SparkSession, **options) -> EdgeTable:
    return normalise(data, **options)


@as_edges.register
def _(data: pa.Table, spark: SparkSession, **options) -> EdgeTable:
    return from_arrow(spark, data, **options)


@as_edges.register(str)
@as_edges.register(Path)
def _(data: str | Path, spark: SparkSession, **options) -> EdgeTable:
    return read_edges(spark, str(data), **options)


def overlay_kind(df: DataFrame) -> DataFrame:
    """One row: kind (fill, line or circle) by the first geometry, in fid order where there is one."""
    t = F.col("geometry")["gtype"]
    kind = F.when(t.endswith("Polygon"), "fill").when(t.endswith("LineString"), "line").when(t.endswith("Point"), "circle")
    order = F.col("fid") if "fid" in df.columns else F.monotonically_increasing_id()
    found = df.select(kind.alias("kind"), order.alias("at")).filter("kind is not null")
    return found.agg(F.coalesce(F.min_by("kind", "at"), F.lit("fill")).alias("kind"))


#: How an overlay is drawn where its owner says nothing.
OVERLAY = {"color": "#6aa9ff", "radius": 6.0, "width": 2.0, "fill": 0.15, "circle": 0.85, "line": 0.9, "outline": 0.9}


def overlay_style(df: DataFrame, name: str, position: int = 0, color: str | None = None, opacity: float | None = None, width: float | None = None, radius: float | None = None, outline: str | None = None, kind: str | None = None, under: bool = False) -> DataFrame:
    """(overlay, position, under, kind, color, opacity, width, radius, outline, outline_opacity, geometry) of each feature.
    All features of an overlay are drawn alike, as its first one asks for; width is that of lines and outlines."""
    kinds = overlay_kind(df) if kind is None else df.sparkSession.createDataFrame([(kind,)], "kind string")
    fill = F.lit(color or OVERLAY["color"])
    drawn = F.col("kind")
    share = F.lit(float(opacity)) if opacity is not None else F.when(drawn == "fill", OVERLAY["fill"]).when(drawn == "circle", OVERLAY["circle"]).otherwise(OVERLAY["line"])
    only = lambda kind, value: F.when(drawn == kind, value)
    return df.select("geometry").crossJoin(F.broadcast(kinds)).select(
        F.lit(name).alias("overlay"),
        F.lit(position).alias("position"),
        F.lit(under).alias("under"),
        "kind",
        fill.alias("color"),
        share.cast("double").alias("opacity"),
        F.when(drawn != "circle", F.lit(float(OVERLAY["width"] if width is None else width))).alias("width"),
        only("circle", F.lit(float(OVERLAY["radius"] if radius is None else radius))).alias("radius"),
        only("fill", F.lit(outline) if outline else fill).alias("outline"),
        only("fill", F.lit(OVERLAY["outline"])).alias("outline_opacity"),
        "geometry",
    )
