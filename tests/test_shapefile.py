"""Shapefiles made by hand and by our writer, read back by ranges of records."""

import struct
from datetime import date

import numpy as np
import pyarrow as pa
import pytest

from waymesh.sources import ingest, shapefile


def points(*xy):
    return b"".join(struct.pack("<2d", *p) for p in xy)


def several(kind, parts, more=b""):
    every = [p for part in parts for p in part]
    first, at = [], 0
    for part in parts:
        first.append(at)
        at += len(part)
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), at) + struct.pack(f"<{len(parts)}i", *first) + points(*every) + more


def save(folder, name, kind, shapes, fields, rows, prj=None, cpg=None, gaps=b""):
    """gaps: bytes between records, which readers have to skip. rows: raw bytes of each value, None: deleted."""
    body, index = b"", b""
    for i, s in enumerate(shapes):
        body += gaps
        index += struct.pack(">2i", (100 + len(body)) // 2, len(s) // 2)
        body += struct.pack(">2i", i + 1, len(s) // 2) + s
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    (folder / f"{name}.shp").write_bytes(head(100 + len(body)) + body)
    (folder / f"{name}.shx").write_bytes(head(100 + len(index)) + index)
    described = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in fields)
    table = b"".join((b"*" if r is None else b" ") + (b" " * sum(f[2] for f in fields) if r is None else b"".join(v.ljust(f[2]) for v, f in zip(r, fields))) for r in rows)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 99, 1, 1, len(rows), 33 + len(described), 1 + sum(f[2] for f in fields)) + described + b"\r" + table + b"\x1a")
    for ending, text in ((".prj", prj), (".cpg", cpg)):
        if text:
            (folder / f"{name}{ending}").write_text(text)


FIELDS = [("highway", "C", 12, 0), ("lanes", "N", 5, 0), ("width", "N", 8, 2), ("speed", "F", 10, 3), ("lit", "L", 1, 0), ("since", "D", 8, 0)]


def plain(g):
    return None if g is None else (g.gtype, [[(p.x, p.y) for p in part] for part in g.parts])


@pytest.mark.parametrize(("step", "gaps"), [(50_000, b""), (2, b""), (1, b"\0" * 9000)])
def test_lines_and_attributes(spark, tmp_path, monkeypatch, step, gaps):
    monkeypatch.setattr(shapefile, "SLICE", step)
    z = struct.pack("<2d", 0, 9) + struct.pack("<3d", 1, 2, 3)
    shapes = [several(3, [[(1, 2), (3, 4)]]), several(13, [[(1, 2), (3, 4), (5, 6)]], z), several(3, [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]]), struct.pack("<i", 0), several(3, [[(7, 7), (8, 8)]]), struct.pack("<i2d", 1, 5, 6)]
    rows = [
        (b"primary", b"    2", b"    3.25", b"1.5e2", b"T", b"20240229"),
        ("Straße".encode(), b"*****", b"", b"", b"?", b""),
        (b"", b"   -1", b"   -0.50", b"nan?", b"n", b"00000000"),
        (b"null shape", b"", b"", b"", b"", b""),
        None,
        (b"point", b"7", b"", b"", b"y", b""),
    ]
    save(tmp_path, "roads", 3, shapes, FIELDS, rows, cpg="UTF-8", gaps=gaps)
    df, srid = shapefile.read_table(spark, str(tmp_path / "roads.shp"))
    assert srid == 4326 and [f.dataType.simpleString() for f in df.schema][:6] == ["string", "bigint", "double", "double", "boolean", "date"]
    got = {r.highway: (r.lanes, r.width, r.speed, r.lit, r.since, plain(r.geometry)) for r in df.collect()}
    assert got == {
        "primary": (2, 3.25, 150.0, True, date(2024, 2, 29), ("LineString", [[(1, 2), (3, 4)]])),
        "Straße": (None, None, None, None, None, ("LineString", [[(1, 2), (3, 4), (5, 6)]])),
        None: (-1, -0.5, None, False, None, ("MultiLineString", [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]])),
        "null shape": (None,) * 6,
        "point": (7, None, None, True, None, ("Point", [[(5, 6)]])),
    }
    edges = ingest.as_edges(str(tmp_path / "roads.shp"), spark)
    assert sorted(str(r.highway) for r in edges.df.collect()) == ["None", "Straße", "primary"]


def test_other_shapes(spark, tmp_path):
    outer, hole, second = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 0), (20, 5), (25, 5), (20, 0)]
    shapes = [several(5, [outer, hole]), several(25, [outer, second]), struct.pack("<i4di", 8, 0, 0, 0, 0, 2) + points((1, 1), (2, 2))]
    save(tmp_path, "areas", 5, shapes, [("n", "N", 3, 0)], [(b"1",), (b"2",), (b"3",)])
    got = {r.n: plain(r.geometry) for r in shapefile.read_shapefile(spark, str(tmp_path), class_col=None, keep_non_lines=True).df.collect()}
    assert got[1] == ("Polygon", [outer, hole]) and got[2] == ("MultiPolygon", [outer, second]) and got[3] == ("MultiPoint", [[(1, 1), (2, 2)]])


def test_systems(spark, tmp_path):
    assert shapefile.srid_of(shapefile.WGS84) == 4326
    assert shapefile.srid_of('PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984",DATUM[]]]') == 32633
    assert shapefile.srid_of('PROJCS["ETRS_1989_UTM_Zone_32N",GEOGCS["GCS_ETRS_1989"]]') == 25832 and shapefile.srid_of('PROJCS["WGS_1984_UTM_Zone_3S",GEOGCS[]]') == 32703
    assert shapefile.srid_of('PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984"]]') == 3857 and shapefile.srid_of('PROJCS["SWEREF99_TM",GEOGCS[]]') == 3006
    assert shapefile.srid_of('PROJCS["Lambert"]') is None and shapefile.srid_of("") is None
    metres = several(3, [[(111319.49079327357, 0), (222638.98158654713, 0)]])
    save(tmp_path, "m", 3, [metres], [("highway", "C", 5, 0)], [(b"x",)], prj='PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984"]]')
    row = ingest.read_edges(spark, str(tmp_path / "m.shp")).df.first()
    assert [(round(p.x, 9), round(p.y, 9)) for p in row.vertices] == [(1, 0), (2, 0)]
    save(tmp_path, "u", 3, [metres], [("highway", "C", 5, 0)], [(b"x",)], prj='PROJCS["Lambert",GEOGCS["GCS_WGS_1984"]]')
    with pytest.raises(ValueError, match="EPSG"):
        shapefile.read_table(spark, str(tmp_path / "u.shp"))
    assert shapefile.read_table(spark, str(tmp_path / "u.shp"), 3857)[1] == 3857
    with pytest.raises(ValueError, match="differ"):
        shapefile.read_table(spark, str(tmp_path))


def test_written_files_are_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "FILE_ROWS", 7)
    line = [{"x": 1.5, "y": 2.25}, {"x": 3.0, "y": -4.0}]
    rows = [(i, "é" * (i % 3) or None, i / 3, i % 2 == 0, date(2020, 1, 1 + i), None if i == 4 else ("MultiLineString", [line, line[::-1]]) if i == 5 else ("LineString", [line])) for i in range(20)]
    schema = f"fid long, name string, share double, flag boolean, day date, geometry {shapefile._GEOMETRY}"
    df = spark.createDataFrame(rows, schema).coalesce(2)
    names = shapefile.write_shapefiles(df, str(tmp_path / "out"))
    assert len(names) == 4 and len(list((tmp_path / "out").iterdir())) == 20
    got = shapefile.read_table(spark, str(tmp_path / "out"))[0].select(*df.columns).orderBy("fid").collect()
    assert got == df.orderBy("fid").collect()
    with pytest.raises(ValueError, match="can't hold"):
        shapefile.write_shapefiles(df.withColumnRenamed("name", "a_long_name"), str(tmp_path / "no"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no shapefile"):
        shapefile.read_table(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(("to", "texts"), [
    ("long", ["7", "  -12", "007", "-", "5-", "1 2", "", "*****", "+3", "0x1F", "1_0"]),
    ("double", ["1.", ".5", "1e5", "-1.5E2", "1e", "-0", "nan", "1e999", "", "inf", "+2.5", "1.2.3"]),
    ("string", ["a ", " \0b\0", "", "  ", "\tc", "d\0e", "Straße"]),
])
@pytest.mark.parametrize("encoding", ["UTF-8", "latin-1", "cp437", "utf-16"])
def test_attributes_at_once_are_those_one_by_one(to, texts, encoding):
    rows = [t.encode().ljust(9, pad) for t in texts for pad in (b" ", b"\0")]
    want = [shapefile._value(r, "C" if to == "string" else "N", to, encoding) for r in rows]
    for some in [range(len(rows)), *([i] for i in range(len(rows)))]:  # together, and each alone
        raw = np.frombuffer(b"".join(rows[i] for i in some), np.uint8).reshape(len(some), 9)
        got = shapefile._values(raw, "C" if to == "string" else "N", to, encoding).to_pylist()
        assert list(map(repr, got)) == [repr(want[i]) for i in some]


def test_lines_are_read_and_written_at_once(tmp_path, monkeypatch):
    """No Python call for each row or point."""
    for name in ("_shape", "_value"):
        monkeypatch.setattr(shapefile, name, lambda *_: pytest.fail("row by row"))
    lines = [None if i % 5 == 3 else {"gtype": "LineString", "parts": [[{"x": i, "y": 1.5}, {"x": 2.0, "y": i / 3}]]} for i in range(300)]
    lines[7] = {"gtype": "MultiLineString", "parts": [[{"x": 1.0, "y": 2.0}], [], [{"x": 3.0, "y": 4.0}, {"x": 5.0, "y": 6.0}]]}
    rows = pa.record_batch([pa.array(range(300)), pa.array([f"n{i}" if i % 3 else None for i in range(300)]), pa.array(lines, shapefile.GEOMETRY)], ["fid", "name", "geometry"])
    columns = [("fid", *shapefile._WRITTEN["bigint"]), ("name", *shapefile._WRITTEN["string"])]
    ((name,),) = [m.column("name").to_pylist() for m in shapefile._writer(str(tmp_path), columns)(iter([rows.slice(0, 100), rows.slice(100)]))]
    about = shapefile.describe(str(tmp_path / f"{name}.shp"))
    batch = pa.record_batch([pa.array([shapefile.json.dumps(about)]), pa.array([0]), pa.array([300])], ["file", "first", "n"])
    got = pa.Table.from_batches(list(shapefile._reader(about["columns"])(iter([batch]))))
    assert got.to_pylist() == rows.to_pylist()
    box = struct.unpack_from("<4d", (tmp_path / f"{name}.shp").read_bytes(), 36)
    assert box == (0.0, 0.0, 299.0, 299 / 3)
    with pytest.raises(ValueError, match="more than 254 bytes"):
        list(shapefile._writer(str(tmp_path), columns[1:])(iter([pa.record_batch([pa.array(["x" * 255]), rows.column("geometry").slice(0, 1)], ["name", "geometry"])])))


def test_damage(spark, tmp_path):
    save(tmp_path, "a", 3, [several(3, [[(1, 2), (3, 4)]])], [("n", "N", 3, 0)], [(b"1",), (b"2",)])
    with pytest.raises(ValueError, match="1 geometries and 2 rows"):
        shapefile.read_table(spark, str(tmp_path / "a.shp"))
    (tmp_path / "b.shp").write_bytes(b"not a shapefile at all")
    with pytest.raises(ValueError, match="not a shapefile"):
        shapefile.read_table(spark, str(tmp_path / "b.shp"))
