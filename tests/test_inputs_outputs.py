"""Inputs in all their forms, filters, styles, settings, palettes, tiles and documents."""

import gzip
import json
import random
import sqlite3
import struct
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymesh import cli
from waymesh.functions import geometry as G
from waymesh.functions import ramp
from waymesh.operators import filters, profile, styling, tiles, verbs
from waymesh.operators.styling import CategoricalStyler, ClassStyler, NumericStyler
from waymesh.plans import flow
from waymesh.plans.flow import build
from waymesh.sources import basemaps, ingest, palettes, settings, sinks
from waymesh.streaming import styles as streams

LINES = {"primary": [[18.0, 59.0], [18.1, 59.1]], "service": [[18.1, 59.1], [18.2, 59.1], [18.3, 59.0]]}
FEATURES = [{"type": "Feature", "properties": {"highway": k, "aadt": 100 * i}, "geometry": {"type": "LineString", "coordinates": v}} for i, (k, v) in enumerate(LINES.items())]


def wkb(line, order="<"):
    return (b"\1" if order == "<" else b"\0") + struct.pack(order + "II", 2, len(line)) + b"".join(struct.pack(order + "dd", *p) for p in line)


def ends(table):
    return sorted((r.highway, len(r.vertices), r.vertices[0].x, r.vertices[-1].y) for r in table.df.collect())


WANT = sorted((k, len(v), v[0][0], v[-1][1]) for k, v in LINES.items())


def test_geometries_are_parsed_once(spark, tmp_path):
    """Filters on the geometry don't parse it again: one expression for each of four nestings, Point's coordinates twice."""
    (tmp_path / "x.geojsonl").write_text("\n".join(map(json.dumps, FEATURES)))
    plan = ingest.read_geojson(spark, str(tmp_path / "x.geojsonl"), lines=True, properties="highway string").df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 3 and plan.count("from_json(") == 6
    wkt = spark.createDataFrame([("a", "LINESTRING (1 2, 3 4)"), ("b", None), ("c", "POINT (1 2)")], "highway string, wkt string")
    once = ingest.decode_geometry(wkt)._jdf.queryExecution().optimizedPlan().toString()
    every = ingest.normalise(wkt).df
    assert every._jdf.queryExecution().optimizedPlan().toString().count("LINESTRING") == once.count("LINESTRING")
    assert [r.highway for r in every.collect()] == ["a"] and ingest.decode_geometry(wkt).count() == 3


def test_every_input_gives_the_same_table(spark, tmp_path):
    rows = list(LINES.items())
    collection = {"type": "FeatureCollection", "features": FEATURES}
    assert ends(ingest.as_edges(collection, spark)) == WANT
    assert ends(ingest.as_edges(FEATURES, spark)) == WANT
    assert ends(ingest.as_edges({"geojson": collection, "legend": None}, spark)) == WANT
    (tmp_path / "x.geojson").write_text(json.dumps(collection))
    assert ends(ingest.as_edges(str(tmp_path / "x.geojson"), spark)) == WANT
    (tmp_path / "x.geojsonl").write_text("\n".join(map(json.dumps, FEATURES)))
    assert ends(ingest.as_edges(str(tmp_path / "x.geojsonl"), spark)) == WANT
    table = pa.table({"highway": [k for k, _ in rows], "geom": pa.array([wkb(rows[0][1]), wkb(rows[1][1], ">")], pa.binary())})
    edges = ingest.as_edges(table, spark)
    assert ends(edges) == WANT and ends(ingest.as_edges(edges, spark)) == WANT
    wkt = spark.createDataFrame([(k, "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in v) + ")") for k, v in rows], "highway string, wkt string")
    assert ends(ingest.as_edges(wkt, spark)) == WANT
    wkt.createOrReplaceTempView("roads_for_test")
    assert ends(ingest.from_sql(spark, "roads_for_test")) == WANT
    assert ends(ingest.from_sql(spark, "SELECT * FROM roads_for_test WHERE highway = 'service'")) == WANT[1:]
    renamed = ingest.normalise(wkt.withColumnRenamed("highway", "kind"), rename={"kind": "highway"})
    assert ends(renamed) == WANT


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "net.gpkg")
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
        INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 'LINESTRING', 4326, 0, 0), ('more', 'geom', 'LINESTRING', 4326, 0, 0);
        CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, highway TEXT, aadt REAL, lit BOOLEAN);
        CREATE TABLE more (fid INTEGER PRIMARY KEY, geom BLOB, highway TEXT);""")
    head = lambda envelope: b"GP\0" + bytes([envelope << 1 | 1]) + struct.pack("<i", 4326) + b"\0" * (32 if envelope else 0)
    for i, (k, v) in enumerate(LINES.items()):
        con.execute("INSERT INTO roads VALUES (?, ?, ?, ?, ?)", (i, head(i) + wkb(v), k, 1.5, i))
    con.execute("INSERT INTO roads VALUES (9, NULL, 'gone', NULL, NULL)")
    con.commit()
    con.close()
    edges = ingest.as_edges(path, spark)
    assert ends(edges) == WANT and [(r.fid, r.aadt, r.lit) for r in edges.df.orderBy("fid").collect()] == [(0, 1.5, False), (1, 1.5, True)]
    assert ingest.read_edges(spark, path, layer="more").df.count() == 0


def test_unusable_geometries_go(spark):
    rows = [("a", wkb(LINES["primary"])), ("b", None), ("c", wkb([[float("nan"), 1.0], [2.0, 3.0]])), ("d", b"\1" + struct.pack("<Idd", 1, 1.0, 2.0)), ("e", b"junk")]
    df = spark.createDataFrame(rows, "highway string, geometry binary")
    assert [r.highway for r in ingest.normalise(df).df.collect()] == ["a"]
    assert sorted(r.highway for r in ingest.normalise(df, keep_non_lines=True).df.collect()) == ["a", "d"]
    assert ingest.overlay_kind(ingest.normalise(df.filter("highway = 'd'"), keep_non_lines=True).df).first().kind == "circle"


def test_errors_say_what_there_is(spark):
    df = spark.createDataFrame([("x", 1)], "kind string, geometry int")
    for call in (lambda: ingest.normalise(df), lambda: ingest.normalise(df, class_col="kind"), lambda: ingest.find_geometry(df.drop("geometry")), lambda: ingest.reproject(df, 2154), lambda: ingest.reproject(df, None)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(TypeError):
        ingest.geojson_features(3)


def test_web_mercator_comes_back(spark):
    line = [[18.0, 59.0], [18.1, 59.1]]
    df = spark.createDataFrame([("a", [{"x": x, "y": y} for x, y in line])], f"highway string, geometry {G.LINE}")
    there = df.withColumn("geometry", G.to_mercator(F.col("geometry")))
    back = ingest.normalise(there, srid=3857).df.first().vertices
    assert [[round(p.x, 9), round(p.y, 9)] for p in back] == line


def test_filters(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["primary", "Primary_link", " service ", None])], "fid long, highway string")
    ids = lambda **k: [r.fid for r in filters.filter_classes(df, "highway", **k).orderBy("fid").collect()]
    assert ids(include=["PRIMARY"]) == [0, 1] and ids(include=["primary"], match_links=False) == [0]
    assert ids(exclude=["service"]) == [0, 1, 3] and ids(include=[]) == [] and ids(include=[""]) == [3]
    assert filters.filter_classes(df, "highway") is df
    with pytest.raises(ValueError):
        filters.require(df, "nothing")


def test_class_style_rules(spark):
    df = spark.createDataFrame([("primary", None, None), ("primary_link", None, None), ("what", None, None), ("service", "yes", None), ("service", None, "yes")], "highway string, tunnel string, bridge string")
    rows = styling.bake(df, ClassStyler(tunnel_col="tunnel", bridge_col="bridge")).collect()
    assert (rows[0]["__rs_fill"], rows[0]["__rs_w"], rows[0]["__rs_op"]) == ("#FF9100", 4.5, 0.9)
    assert rows[1]["__rs_w"] == pytest.approx(3.15) and rows[1]["__rs_class"] == "primary"
    assert rows[2]["__rs_fill"] == "#FFFFFF"
    assert rows[3]["__rs_dash"] == "4,4" and rows[3]["__rs_op"] == pytest.approx(0.405)
    assert rows[4]["__rs_casing"] == "#000000" and rows[4]["__rs_cw"] == pytest.approx(2.5)
    own = {"a": palettes.LineStyle("#111111", 1.0), "b_link": palettes.LineStyle("#222222", 2.0)}
    rows = styling.bake(spark.createDataFrame([("B_link",), ("zz",)], "highway string"), ClassStyler(palette=own, normalize_links=False)).collect()
    assert [r["__rs_fill"] for r in rows] == ["#222222", "#111111"]
    with pytest.raises(ValueError):
        styling.bake(df, ClassStyler(palette="none such"))


def test_numeric_style_takes_the_range_of_the_rows_at_hand(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "v double")
    rows = [r["__rs_fill"] for r in styling.bake(df, NumericStyler("v", ("#000000", "#ffffff"))).collect()]
    assert rows == ["#000000", "#ffffff", "#cccccc", "#cccccc"]
    assert [r["__rs_fill"] for r in styling.bake(df.filter("v = 3"), NumericStyler("v", ("#000000", "#ffffff"))).collect()] == ["#000000"]
    assert NumericStyler("v").legend(df)["ramp"][0] == "#440154" and ramp.sample("viridis", 3)[-1] == "#fde725"
    with pytest.raises(ValueError):
        ramp.ramp_stops("no such ramp")


def test_options_fall_back_to_the_base_fill(spark):
    df = spark.createDataFrame([(0, "primary", 5.0), (1, "service", None)], "fid long, highway string, aadt double")
    base, meta = styling.bake_options(df, {"Class": ClassStyler(), "Traffic": NumericStyler("aadt", vmin=0, vmax=10)})
    rows = base.orderBy("fid").collect()
    assert rows[1]["__rs_fill__1"] == rows[1]["__rs_fill"] and [m["prop"] for m in meta] == ["__rs_fill", "__rs_fill__1"]
    own, _ = styling.bake_options(df, {"Class": ClassStyler(), "Traffic": NumericStyler("aadt", vmin=0, vmax=10, missing="self")})
    assert own.orderBy("fid").collect()[1]["__rs_fill__1"] == "#cccccc"
    assert verbs.color_field(base, ["Class", "Traffic"], "Traffic") is not None


def test_user_styler_is_checked(spark):
    df = spark.createDataFrame([("a",)], "highway string")
    with pytest.raises(ValueError):
        styling.bake(df, styling.build_styler(style=lambda d: d))
    assert styling.build_styler(color_by="x", colors="self").color_column == "x"
    assert isinstance(styling.build_styler(color_by="x", colors={}), CategoricalStyler) and isinstance(styling.build_styler(color_by="x"), NumericStyler)


def test_colour_table_last_row_counts(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    table = spark.createDataFrame([("1", "#a", 0), ("1", "#b", 1), ("2", "", 2)], "id string, color string, n int")
    assert [r.c for r in styling.join_colors(df, "id", table, order="n", into="c").orderBy("id").collect()] == ["#b", "", None]
    with pytest.raises(ValueError):
        styling.join_colors(df, "id", table, color="hue")


def test_settings_layers(tmp_path):
    (tmp_path / settings.FILE_NAME).write_text(json.dumps({"slot_m": 50, "tiles": {"maxzoom": 12}}))
    (tmp_path / "env.json").write_text(json.dumps({"slot_m": 70}))
    (tmp_path / "bad.json").write_text("{")
    where = {"home": tmp_path / "none", "cwd": tmp_path, "environment": {settings.ENVIRONMENT: str(tmp_path / "env.json")}}
    s = settings.resolve({"fill_opacity": 0.5}, {"slot_m": 80}, **where)
    assert (s.slot_m, s.fill_opacity, s.tiles["maxzoom"], s.tiles["minzoom"]) == (80, 0.5, 12, 6)
    assert settings.resolve(**where).slot_m == 70 and settings.DEFAULT.slot_m == 100
    where["environment"] = {settings.ENVIRONMENT: str(tmp_path / "bad.json")}
    assert settings.resolve(**where).slot_m == 50
    with pytest.raises(ValueError):
        settings.merged(settings.DEFAULT, {"nothing": 1})


def test_palettes(spark, tmp_path):
    bare = {"x": {"fill": "#1", "width": 2, "casing_dark": "#2", "dash": [1, 2]}}
    _, styles = palettes.palette_from_dict(bare)
    assert styles["x"].casing == "#2" and styles["x"].dash == (1, 2)
    palettes.register_palette("mine", styles)
    palettes.save_palette(spark, "mine", "mine", str(tmp_path / "p"))
    assert palettes.load_palette(spark, str(tmp_path / "p"), register=True) == styles
    for bad in ({"x": {"fill": "", "width": 1}}, {"x": {"fill": "#1", "width": -1}}, {"x": {"fill": "#1", "width": 1, "colour": 2}}):
        with pytest.raises(ValueError):
            palettes.palette_from_dict(bad)
    assert len(basemaps.tile_urls(basemaps.get_basemap("positron"))) == 4
    assert basemaps.get_basemap({"name": "T", "url": "http://t/{z}"}).label == "T"
    with pytest.raises(ValueError):
        basemaps.get_basemap("none such")


def test_queries_can_only_compare():
    for bad in ("reflect('java.lang.System', 'exit', 1)", "exists (select 1)", "a = 1; drop", "x -- y"):
        with pytest.raises(ValueError):
            verbs.predicate(bad)


def test_predicates(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", None), (2, "select", 3)], "fid long, name string, n int")
    ids = lambda q: [r.fid for r in verbs.query(df, q).orderBy("fid").collect()]
    assert ids("p.n > 0") == [0, 2] and ids("!(p.n == 1)") == [2] and ids("NAME = \"select\" OR (n IN (1))") == [0, 2] and ids("p.n != 3 && p.name !== 'b'") == [0]


def test_simplify_clip_offset():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float)
    assert len(G.simplify_points(line, 0.1)) == 4 and len(G.simplify_points(line, 0.0)) == 5
    parts = G.clip_points(np.array([[-1, 1], [3, 1], [3, 3], [1, 3], [1, -1]], float), (0, 0, 2, 2))
    assert [p.tolist() for p in parts] == [[[0, 1], [2, 1]], [[1, 2], [1, 0]]]
    assert np.allclose(G.offset_points(np.array([[0, 0], [1, 0], [1, 1]], float), 0.1), [[0, 0.1], [0.9, 0.1], [0.9, 1]])
    assert np.allclose(G.buffer_points(np.array([[0, 0], [2, 0]], float), 1), [[0, 1], [2, 1], [2, -1], [0, -1], [0, 1]])


def read_tile(data):
    """{layer: [(id, {key: value}, n geometry numbers)]}."""

    def fields(b):
        at = 0
        while at < len(b):
            n = shift = 0
            while True:
                n |= (b[at] & 127) << shift
                shift += 7
                at += 1
                if b[at - 1] < 128:
                    break
            wire = n & 7
            if wire == 1:
                yield n >> 3, b[at : at + 8]
                at += 8
                continue
            v = shift = 0
            while True:
                v |= (b[at] & 127) << shift
                shift += 7
                at += 1
                if b[at - 1] < 128:
                    break
            if wire == 2:
                yield n >> 3, b[at : at + v]
                at += v
            else:
                yield n >> 3, v

    out = {}
    for _, layer in fields(gzip.decompress(data)):
        got = list(fields(layer))
        name = next(v for k, v in got if k == 1).decode()
        keys = [v.decode() for k, v in got if k == 3]
        values = [next(fields(v)) for k, v in got if k == 4]
        features = []
        for k, v in got:
            if k == 2:
                f = dict(fields(v))
                tags = list(f.get(2, b""))
                features.append((f.get(1), {keys[a]: values[b][1] for a, b in zip(tags[::2], tags[1::2])}, f[4]))
        out[name] = features
    return out


def test_tiles(spark):
    rows = [(i, "primary" if i % 2 else "service", "x", [{"x": 18.0 + i * 0.001, "y": 59.0}, {"x": 18.0005 + i * 0.001, "y": 59.0}, {"x": 18.0005 + i * 0.001, "y": 59.0004}]) for i in range(40)]
    df = styling.bake(spark.createDataFrame(rows, f"fid long, highway string, secret string, vertices {G.LINE}"), ClassStyler())
    options = {"minzoom": 13, "maxzoom": 15, "extent": 4096, "buffer_px": 80}
    cells = tiles.tile_rows(df, "highway", ["highway"], {"service": 15}, options)
    built = {(r.z, r.x, r.y): read_tile(bytes(r.tile)) for r in tiles.build_tiles([cells, tiles.tile_rows(df.select("fid", "highway", "vertices"), None, layer="labels", options=options, whole=True)]).collect()}
    assert {z for z, _, _ in built} == {13, 14, 15}
    for (z, _, _), layers in built.items():
        assert set(layers) == {"roads", "labels"}
        for fid, props, drawing in layers["roads"]:
            assert "secret" not in props and props["highway"] == rows[fid or 0][1].encode() and len(drawing) > 3
            assert z == 15 or rows[fid or 0][1] == "primary"
    assert {f for layers in built.values() for f, _, _ in layers["roads"]} == set(range(40))
    side = tiles.sidecar(df.withColumn("geometry", F.struct(F.lit("LineString").alias("gtype"), F.array("vertices").alias("parts"))).drop("vertices"))
    joined = cells.filter("z = 15").join(side.select("fid", "mid"), "fid").select("fid", "mid").distinct().collect()
    assert len(joined) == 40 and all(r.mid.y == 59.0 for r in joined)


def test_clipped_parts_lie_in_the_padded_tile(spark):
    df = spark.createDataFrame([(0, "primary", [{"x": 17.0, "y": 58.9}, {"x": 18.0, "y": 59.3}, {"x": 19.0, "y": 58.7}])], f"fid long, highway string, vertices {G.LINE}")
    rows = tiles.tile_rows(df, "highway", options={"minzoom": 9, "maxzoom": 10, "extent": 4096, "buffer_px": 80})
    size = 2 * G.WORLD / 2.0 ** F.col("z")
    pad = size * (80 / 4096) + 1e-6
    p = rows.select("z", "x", "y", F.explode(F.flatten("parts")).alias("p"))
    outside = p.filter((F.col("p.x") < F.col("x") * size - G.WORLD - pad) | (F.col("p.x") > (F.col("x") + 1) * size - G.WORLD + pad) | (F.col("p.y") > G.WORLD - F.col("y") * size + pad) | (F.col("p.y") < G.WORLD - (F.col("y") + 1) * size - pad))
    assert p.count() > 10 and outside.count() == 0


def test_spec_round_trip(spark, tmp_path):
    edges = ingest.as_edges(FEATURES, spark).df
    spec = sinks.to_spec(edges, options={"Class": ClassStyler(), "AADT": NumericStyler("aadt")}, tooltip=["aadt", "none"])
    assert spec["bounds"] == [[59.0, 18.0], [59.1, 18.3]] and spec["tooltip"] == ["aadt"] and len(spec["geojson"]["features"]) == 2
    assert spec["color_options"][1]["legend"]["vmax"] == 100.0
    sinks.save_spec(spark, spec, str(tmp_path / "spec"))
    assert ends(ingest.as_edges(sinks.load_spec(spark, str(tmp_path / "spec")), spark)) == WANT
    with pytest.raises(ValueError):
        sinks.to_spec(edges, most_rows=1)
    big = edges.withColumn("edge_id", F.lit((1 << 53) + 1))
    assert f'"edge_id":"{(1 << 53) + 1}"' in sinks.geojson_rows(big).first().value


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.geojsonl").write_text("\n".join(map(json.dumps, FEATURES)))
    source = str(tmp_path / "in.geojsonl")
    assert cli.main([source, str(tmp_path / "out"), "--exclude", "service"], spark) == 0
    assert [r.highway for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["primary"]
    for kind in ("geojsonl", "spec", "tiles"):
        assert cli.main([source, str(tmp_path / kind), "-f", kind], spark) == 0
    styled = [source, str(tmp_path / "one"), "-f", "geojson", "--color-by", "highway", "--colors", '{"primary": "#010203"}']
    assert cli.main(styled, spark) == 0
    one = sinks.load_spec(spark, str(tmp_path / "one"))
    assert one["type"] == "FeatureCollection" and {f["properties"]["highway"]: f["properties"]["__rs_fill"] for f in one["features"]} == {"primary": "#010203", "service": "#cccccc"}
    numbers = [source, str(tmp_path / "wide"), "-f", "spec", "--color-by", "aadt", "--cmap", "YlOrRd_09", "--width-by", "1", "5", "--basemap", "satellite", "--tooltip", "aadt"]
    assert cli.main(numbers, spark) == 0
    wide = sinks.load_spec(spark, str(tmp_path / "wide"))
    assert wide["basemap"]["key"] == "satellite" and wide["tooltip"] == ["aadt"] and sorted(f["properties"]["__rs_w"] for f in wide["geojson"]["features"]) == [1.0, 5.0]
    assert cli.main([source, str(tmp_path / "x"), "--class-col", "nope"], spark) == 2 and "nope" in capsys.readouterr().err


def test_profiles(spark):
    df = spark.createDataFrame([(i, i % 3, f"n{i}", "ab"[i % 2], float(i)) for i in range(40)], "edge_id long, lanes int, name string, side string, speed double")
    assert profile.eligible_columns(df) == ["lanes", "speed", "side"]
    assert profile.colour_option(df, "lanes")["colors"].keys() == {0, 1, 2} and profile.colour_option(df, "speed")["vmin"] == pytest.approx(0.78)
    assert profile.colour_option(df.withColumn("none", F.lit(None).cast("string")), "none") is None
    assert profile.class_breaks(df.filter("lanes = 9"), "speed") == [] and profile.class_breaks(df, "lanes", "natural_breaks", 3) == [0.0, 1.0, 2.0]
    assert profile.natural_breaks([1, 2, 3, 50, 51, 100], [1] * 6, 3) == [3.0, 51.0, 100.0]
    assert spark.range(1).select(profile.length_label(F.lit(1500.0)).alias("x"), profile.length_label(F.lit(999.4)).alias("y")).first() == ("1.5 km", "999 m")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("primary", 1.0), ("service", 2.0)], "highway string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("highway string, v double").parquet(str(tmp_path / "in"))
    q = streams.style_stream(stream, ClassStyler(), "highway", exclude=["service"]).writeStream.format("memory").queryName("styled").start()
    q.processAllAvailable()
    q.stop()
    assert [r["__rs_fill"] for r in spark.table("styled").collect()] == ["#FF9100"]
    with pytest.raises(ValueError):
        streams.style_stream(stream, NumericStyler("v"), "highway")


def test_whole_flow(spark):
    features = [{"type": "Feature", "properties": {"highway": h, "edge_id": f"e{i}", "name": "S", "bridge": b}, "geometry": {"type": "LineString", "coordinates": v}} for i, (h, b, v) in enumerate([("primary", None, [[18.0, 59.0], [18.01, 59.0]]), ("primary", "yes", [[18.01, 59.0], [18.02, 59.0]]), ("path", None, [[18.0, 59.0], [18.0, 59.01]])])]
    zone = {"type": "Feature", "properties": {"zone": 1}, "geometry": {"type": "Polygon", "coordinates": [[[18.0, 59.0], [18.1, 59.0], [18.1, 59.1], [18.0, 59.0]]]}}
    net = flow.build(spark, features, exclude=["path"], color_table={"e0": "#123456"}, overlays={"zones": zone})
    rows = net.edges.orderBy("fid").collect()
    assert [r["__rs_fill"] for r in rows] == ["#123456", "#bbbbbb"] and [r.lvl for r in rows] == [0, 1] and [r.fid for r in rows] == [0, 1]
    assert net.panel().collect()[0]["class"] == "primary" and net.extent().first().maxx == 18.02
    assert net.slots().count() > 5 and {r.fid for r in net.decks().collect()} == {1}
    assert net.tiles().count() > 3 and net.sidecar().count() == 2
    assert [(r.name, r.kind) for r in net.overlay_catalog(spark).collect()] == [("zones", "fill")]
    both = flow.build(spark, features, options={"Class": ClassStyler(), "Id": CategoricalStyler("edge_id", {"e0": "#1"})})
    assert [o["name"] for o in both.options] == ["Class", "Id"] and both.edges.filter("edge_id = 'e0'").first()["__rs_fill__1"] == "#1"
    assert styling.resolve_one(spark, "primary_link", bridge=True)["__rs_casing"] == "#000000"


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_are_dense_and_no_row_is_lost(spark, tmp_path, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(400_000).selectExpr("id", "id % 7 AS k", "'x' AS same", "repeat('ab', CAST(id % 50 AS INT)) AS pay", "id * 1.5 AS v")
        for order in (["k"], ["same"], ["k", "pay"]):
            path = str(tmp_path / f"ids-{adaptive}-{'-'.join(order)}")
            ingest.with_ids(df, *order).write.parquet(path)
            got = spark.read.parquet(path)
            assert tuple(got.agg(F.count("*"), F.count_distinct("fid"), F.min("fid"), F.max("fid"), F.count_distinct("id")).first()) == (400_000, 400_000, 0, 399_999, 400_000)
            pairs = got.select("fid", F.struct(*order).alias("o")).withColumn("before", F.lag("o").over(W.orderBy("fid")))
            assert pairs.filter("before > o").isEmpty()
        again = ingest.with_ids(df.repartition(7), "same").select("id", F.col("fid").alias("other"))
        assert spark.read.parquet(str(tmp_path / f"ids-{adaptive}-same")).join(again, "id").filter("fid <> other").isEmpty()
        assert ingest.with_ids(df.limit(0), "k").collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_running_total_of_one_long_chain(spark):
    df = spark.range(20_000).selectExpr("CAST(NULL AS STRING) AS name", "id", "id % 3 AS v", "CAST(id AS STRING) AS pay").unionByName(spark.range(5).selectExpr("'b' AS name", "id", "CAST(NULL AS LONG) AS v", "'p' AS pay")).repartition(5)
    got = {(r.name, r.id): r.running for r in profile.running_total(df, "name", "id", "v").collect()}
    assert len(got) == 20_005 and all(got["b", i] is None for i in range(5))
    assert all(got[None, i] == 3 * (i // 3) + (0, 1, 3)[i % 3] for i in range(20_000))


def utm(lon, lat, meridian, south):
    """Snyder's series of the transverse Mercator projection."""
    a, e2 = 6378137.0, 0.00669438002290
    f, ep = np.radians(lat), 0.00669438002290 / (1 - 0.00669438002290)
    n, t, c, x = a / np.sqrt(1 - e2 * np.sin(f) ** 2), np.tan(f) ** 2, ep * np.cos(f) ** 2, np.radians(lon - meridian) * np.cos(f)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * f - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * np.sin(2 * f) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * np.sin(4 * f) - 35 * e2**3 / 3072 * np.sin(6 * f))
    east = 0.9996 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep) * x**5 / 120) + 500_000
    north = 0.9996 * (m + n * np.tan(f) * (x**2 / 2 + (5 - t + 9 * c + 4 * c**2) * x**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep) * x**6 / 720))
    return float(east), float(north + (10_000_000 if south else 0))


def test_utm(spark):
    for srid, meridian, lon, lat in ((32633, 15, 18.0686, 59.3293), (3006, 15, 12.5, 68.1), (32723, -45, -43.2105, -22.9519), (25832, 9, 9.0, 48.0)):
        x, y = utm(lon, lat, meridian, lat < 0)
        df = spark.createDataFrame([("a", ("LineString", [[(x, y), (x + 1, y)]]))], "highway string, geometry struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>")
        p = ingest.normalise(df, srid=srid).df.first().vertices[0]
        assert abs(p.x - lon) < 1e-7 and abs(p.y - lat) < 1e-7
    with pytest.raises(ValueError, match="reproject"):
        ingest.normalise(df, srid=27700)


def test_checked_input(spark):
    line, point = ("LineString", [[(1.0, 2.0), (2.0, 3.0)]]), ("Point", [[(1.0, 2.0)]])
    kind = "highway string, geometry struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>"
    with pytest.warns(UserWarning, match="1 of 3 rows are no lines"), pytest.warns(UserWarning, match="no usable geometry"):
        table = ingest.normalise(spark.createDataFrame([("a", line), ("b", point), ("c", None)], kind), check=True)
    assert table.df.count() == 1
    for rows in ([], [("b", point)]):
        with pytest.raises(ValueError):
            ingest.normalise(spark.createDataFrame(rows, kind), check=True)


def test_spec_arguments(spark):
    edges = ingest.normalise(spark.createDataFrame([("primary", 5, "p", ("LineString", [[(18.0, 59.0), (18.1, 59.1)]])), ("service", 1 << 60, "q", ("LineString", [[(18.0, 59.0), (18.2, 59.1)]]))], "highway string, aadt long, k string, geometry struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>")).df
    spec = sinks.to_spec(edges, color_by="k", colors={"p": "#010203"}, basemap="satellite", basemaps=["osm", "blank"])
    assert [f["properties"]["__rs_fill"] for f in spec["geojson"]["features"]] == ["#010203", "#cccccc"]
    assert [f["properties"]["aadt"] for f in spec["geojson"]["features"]] == [5, str(1 << 60)]
    assert [m["key"] for m in spec["basemaps"]] == ["satellite", "osm", "blank"] and spec["basemap"]["satellite"]
    spec = sinks.to_spec(edges, options=[{"name": "Class"}, {"name": "K", "color_by": "k", "colors": {"q": "#040506"}, "missing": "self"}], palette="mono")
    assert [o["name"] for o in spec["color_options"]] == ["Class", "K"] and [f["properties"]["__rs_fill__1"] for f in spec["geojson"]["features"]] == ["#cccccc", "#040506"]
    assert [m["key"] for m in sinks.to_spec(edges)["basemaps"]] == list(basemaps.SWITCHER)


def test_a_colour_table_without_order_must_have_one_row_for_each_id(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    once = spark.createDataFrame([(1, "#a"), (3, "#c")], "id long, color string")
    assert [r.c for r in styling.join_colors(df, "id", once, into="c").orderBy("id").collect()] == ["#a", None]
    with pytest.raises(Exception, match="several colours"):
        styling.join_colors(df, "id", once.unionByName(once), into="c").collect()


def test_layers_of_tiles(spark):
    rows = [("primary", "Main", [(18.0 + i * 0.003, 59.0), (18.0015 + i * 0.003, 59.0004), (18.003 + i * 0.003, 59.0)]) for i in range(4)]
    df = spark.createDataFrame([(c, n, ("LineString", [v])) for c, n, v in rows], "highway string, name string, geometry struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>")
    zone = {"type": "Feature", "properties": {"zone": 7}, "geometry": {"type": "Polygon", "coordinates": [[[18.0, 58.9], [18.5, 58.9], [18.5, 59.0], [18.0, 58.9]]]}}
    poi = {"type": "Feature", "properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [18.001, 59.0005]}}
    small = replace(settings.DEFAULT, tiles={**settings.DEFAULT.tiles, "minzoom": 12, "maxzoom": 13})
    net = build(spark, df, overlays={"zones": zone, "pois": poi}, settings=small)
    layers = {}
    for r in net.tiles().collect():
        for name, features in read_tile(r.tile).items():
            layers.setdefault(name, {}).setdefault(r.z, []).extend(features)
    assert set(layers) == {"roads", "names", "arrows", "zones", "pois"}
    assert set(layers["names"]) == {13} and set(layers["roads"]) == set(layers["zones"]) == {12, 13}
    assert {f[1]["zone"] for f in layers["zones"][12]} == {14}  # zigzag of 7
    box = net.tile_extent().first()
    assert (box.minx, box.miny, box.maxx) == (18.0, 58.9, 18.5)
    styles = {r.overlay: (r.kind, r.color, r.opacity, r.radius, r.outline) for r in net.overlay_styles().collect()}
    assert styles == {"zones": ("fill", "#6aa9ff", 0.15, None, "#6aa9ff"), "pois": ("circle", "#6aa9ff", 0.85, 6.0, None)}


def test_numbers_in_tiles():
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.integers(0, 300, 50), rng.integers(0, 1 << 40, 50), [0, 127, 128, (1 << 62)]))
    assert tiles._varints(values) == b"".join(tiles._varint(int(v)) for v in values)
    assert [int(z) for z in tiles._zigzags(np.array([0, -1, 1, -2, 2147483647]))] == [tiles._zigzag(n) for n in (0, -1, 1, -2, 2147483647)]


def plain_drawing(parts, shape):
    """A feature's drawing, value by value."""
    if shape == 1:
        points = [p for part in parts for p in part]
        out, at = [len(points) << 3 | 1] if points else [], (0, 0)
        for p in points:
            out += [tiles._zigzag(p[0] - at[0]), tiles._zigzag(p[1] - at[1])]
            at = p
        return b"".join(map(tiles._varint, out))
    out, at = [], (0, 0)
    for part in parts:
        part = [p for i, p in enumerate(part) if i == 0 or p != part[i - 1]]
        if shape == 3 and len(part) > 1 and part[0] == part[-1]:
            part = part[:-1]
        if len(part) < shape:
            continue
        for i, p in enumerate(part):
            out += ([9] if i == 0 else [len(part) - 1 << 3 | 2] if i == 1 else []) + [tiles._zigzag(p[0] - at[0]), tiles._zigzag(p[1] - at[1])]
            at = p
        out += [15] if shape == 3 else []
    return b"".join(map(tiles._varint, out))


@pytest.mark.parametrize("seed", range(5))
def test_drawings_of_many_features(seed):
    rng = random.Random(seed)
    features = []
    for _ in range(60):
        parts = [[(rng.randint(-2, 2), rng.choice([0, 0, 1, 5000])) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(0, 3))]
        features.append((rng.choice([1, 2, 3]), [p + p[:1] if rng.random() < 0.5 else p for p in parts]))
    points = np.array([p for _, parts in features for part in parts for p in part], np.int64).reshape(-1, 2)
    sizes = np.array([len(part) for _, parts in features for part in parts], np.int64)
    got = tiles._drawings(points, sizes, np.array([len(parts) for _, parts in features]), np.array([s for s, _ in features]))
    assert got == [plain_drawing(parts, shape) for shape, parts in features]
    none = np.zeros(0, np.int64)
    assert tiles._drawings(none.reshape(-1, 2), none, np.array([0, 0]), np.array([1, 2])) == [b"", b""]


def test_crossed_outlines():
    assert G.is_simple(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], float))
    assert not G.is_simple(np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], float))
