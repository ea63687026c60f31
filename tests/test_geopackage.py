"""GeoPackages by ranges of row ids, of several files, of views, and from bytes."""

import sqlite3
import struct

import pytest

from waymesh.sources import geopackage


def line(i):
    return struct.pack("<BIIdddd", 1, 2, 2, i, 0.0, i + 0.5, 1.0)


def make(path, ids, extra="", srs=4326):
    con = sqlite3.connect(path)
    con.executescript(f"""
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
        INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 'LINESTRING', {srs}, 0, 0), ('seen', 'geom', 'LINESTRING', {srs}, 0, 0);
        CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, highway TEXT {extra});
        CREATE VIEW seen AS SELECT fid, geom, highway FROM roads WHERE fid % 2 = 0;""")
    con.executemany("INSERT INTO roads (fid, geom, highway) VALUES (?, ?, ?)", [(i, b"GP\0\1" + struct.pack("<i", 4326) + line(i), f"class {i % 3}") for i in ids])
    con.commit()
    con.close()


def ids_of(spark, path, layer=None):
    df = geopackage.read_geopackage(spark, str(path), layer=layer).df
    rows = df.collect()
    assert all(r.vertices[0].x == r.fid and r.highway == f"class {r.fid % 3}" for r in rows)
    return df, sorted(r.fid for r in rows)


def test_ranges_of_row_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geopackage, "SLICE", 10)
    monkeypatch.setattr(geopackage, "BATCH", 3)
    ids = [*range(-5, 30), 95, 99, 100, 101]
    make(tmp_path / "a b#.gpkg", ids)
    df, found = ids_of(spark, tmp_path / "a b#.gpkg")
    assert found == ids and df.rdd.getNumPartitions() == 11
    assert ids_of(spark, tmp_path, "seen")[1] == [i for i in ids if i % 2 == 0]  # a view has no row ids: one task
    make(tmp_path / "c.gpkg", range(200, 260))
    make(tmp_path / "empty.gpkg", [])
    assert ids_of(spark, tmp_path)[1] == [*ids, *range(200, 260)]


def test_files_that_differ(spark, tmp_path):
    make(tmp_path / "a.gpkg", [1])
    make(tmp_path / "b.gpkg", [2], ", more REAL")
    with pytest.raises(ValueError, match="differ"):
        geopackage.read_table(spark, str(tmp_path))
    with pytest.raises(Exception, match="no layer"):
        geopackage.read_table(spark, str(tmp_path / "a.gpkg"), "rivers")


def test_from_bytes(spark, tmp_path, monkeypatch):
    """As for files that have no local path."""
    make(tmp_path / "a.gpkg", range(25))
    monkeypatch.setattr(geopackage, "store_of", lambda path: (None, path))
    assert ids_of(spark, tmp_path)[1] == list(range(25))
