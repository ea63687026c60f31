"""PMTiles archives: tile numbers, directories, and whole archives written and read back."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_inputs_outputs import read_tile
from waymesh import cli
from waymesh.operators import tiles
from waymesh.sources import archive

TILE = "z int, x long, y long, tile binary"


def test_numbers_follow_the_hilbert_curve():
    assert archive._numbers([0, 1, 1, 1, 1, 2, 12], [0, 0, 0, 1, 1, 0, 3423], [0, 0, 1, 1, 0, 0, 1763]).tolist() == [0, 1, 2, 3, 4, 5, 19078479]
    z, x, y = np.array([(z, x, y) for z in range(6) for x in range(1 << z) for y in range(1 << z)]).T
    n = archive._numbers(z, x, y)
    assert sorted(n.tolist()) == list(range(len(n)))
    assert all((a == b).all() for a, b in zip(archive._places(n), (z, x, y)))
    order = np.argsort(n)
    step = abs(np.diff(x[order])) + abs(np.diff(y[order]))
    assert (step[np.diff(z[order]) == 0] == 1).all()


def test_directories():
    rng = np.random.default_rng(1)
    numbers, runs, sizes = np.cumsum(rng.integers(1, 9, 5000)), rng.integers(0, 5, 5000), rng.integers(1, 90_000, 5000)
    offsets = np.cumsum(sizes) - sizes
    offsets[100], offsets[3000:3005] = 5, 77
    assert all((a == b).all() for a, b in zip(archive.read_directory(archive.write_directory(numbers, runs, sizes, offsets)), (numbers, runs, sizes, offsets)))
    assert [len(a) for a in archive.read_directory(archive.write_directory([], [], [], []))] == [0] * 4
    with pytest.raises(ValueError):
        archive.read_directory(gzip.compress(bytes([3, 1, 1])))


def some_tiles(seed, n):
    rng = random.Random(seed)
    places = {(z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in (rng.randrange(9) for _ in range(n))}
    return [(*p, gzip.compress(rng.choice([b"sea", b"land", rng.randbytes(rng.randrange(1, 3000))]), mtime=0)) for p in places]


@pytest.mark.parametrize(("n", "leaf", "known"), [(1, 4096, 9), (400, 4096, 1 << 16), (3000, 40, 1 << 16), (3000, 700, 2)])
def test_round_trip(spark, monkeypatch, tmp_path, n, leaf, known):
    monkeypatch.setattr(archive, "LEAF", leaf)
    monkeypatch.setattr(archive, "LEAVES", 30)
    monkeypatch.setattr(archive, "KNOWN", known)
    monkeypatch.setattr(archive, "COPY", 5000)
    rows = some_tiles(n, n)
    path = str(tmp_path / "some.pmtiles")
    header = archive.write_archive(spark.createDataFrame([*rows], TILE).repartition(5), path, bounds=(-10.5, 1, 20, 30.25), layers=["roads", "names"], metadata={"name": "x"})
    got = archive.read_archive(spark, path)
    assert sorted((r.z, r.x, r.y, bytes(r.tile)) for r in got.collect()) == sorted(rows)
    again, about = archive.read_metadata(path)
    assert again == header and about == {"vector_layers": [{"id": "roads", "fields": {}}, {"id": "names", "fields": {}}], "name": "x"}
    assert header["n_tiles"] == len(rows) and header["n_entries"] <= len(rows) and header["n_contents"] >= len({r[3] for r in rows})
    assert (header["west"], header["north"], header["min_zoom"], header["max_zoom"]) == (-10.5, 30.25, min(r[0] for r in rows), max(r[0] for r in rows))
    assert header["root_bytes"] + archive.HEADER.size <= 16_384 and (header["leaves_bytes"] > 0) == (n > leaf)
    assert [p.name for p in tmp_path.iterdir()] == ["some.pmtiles"]


def test_equal_neighbours_are_one_entry(spark, tmp_path):
    rows = [(5, x, y, b"sea") for x in range(32) for y in range(32)]
    header = archive.write_archive(spark.createDataFrame(rows, TILE).coalesce(1), str(tmp_path / "sea.pmtiles"))
    assert header["n_tiles"] == 1024 and header["n_entries"] <= 8 and header["tiles_bytes"] <= 24
    assert header["west"] == -180 and header["east"] == 180 and 85 < header["north"] < 85.1
    assert sorted((r.x, r.y) for r in archive.read_archive(spark, str(tmp_path / "sea.pmtiles")).collect()) == sorted((x, y) for _, x, y, _ in rows)


def test_what_can_not_be_written_or_read(spark, tmp_path):
    path = str(tmp_path / "a.pmtiles")
    with pytest.raises(ValueError, match="no tiles"):
        archive.write_archive(spark.createDataFrame([(0, 0, 0, None)], TILE), path)
    with pytest.raises(ValueError, match="2 rows for 1"):
        archive.write_archive(spark.createDataFrame([(0, 0, 0, b"a"), (0, 0, 0, b"b")], TILE), path)
    (tmp_path / "b.pmtiles").write_bytes(b"x" * 200)
    with pytest.raises(ValueError):
        archive.read_metadata(str(tmp_path / "b.pmtiles"))


def test_of_a_network(spark, tmp_path):
    """Features read from the archive are those that were put into tiles."""
    rows = [(i, "primary", [(10 + i / 50, 50.0), (10 + i / 50 + 0.01, 50.01)]) for i in range(40)]
    df = spark.createDataFrame(rows, "fid long, highway string, vertices array<struct<x:double,y:double>>")
    spread = tiles.tile_rows(df, "highway", ["highway"], options={"minzoom": 4, "maxzoom": 9, "extent": 4096, "buffer_px": 80})
    archive.write_archive(tiles.build_tiles([spread]), str(tmp_path / "n.pmtiles"))
    want = {(r.z, r.x, r.y): r.ids for r in spread.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list("fid")).alias("ids")).collect()}
    got = {(r.z, r.x, r.y): sorted(f[0] or 0 for f in read_tile(bytes(r.tile))["roads"]) for r in archive.read_archive(spark, str(tmp_path / "n.pmtiles")).collect()}
    assert got == want


def test_decoded_features_are_those_that_were_encoded(spark):
    parts = [[(18.0, 59.0), (18.2, 59.1), (18.2, 59.3)], [(18.5, 59.0), (18.6, 59.0)]]
    line = lambda p: [{"x": x, "y": y} for x, y in p]
    ring = line([(18.0, 59.0), (18.4, 59.0), (18.4, 59.2), (18.0, 59.0)])
    rows = [(0, "a", 1.5, True, ("MultiLineString", [line(p) for p in parts])), (7, "\u00e9", None, False, ("Point", [line([(18.1, 59.1)])])), (9, None, -3.0, None, ("Polygon", [ring]))]
    df = spark.createDataFrame(rows, "fid long, name string, number double, flag boolean, geometry struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>")
    built = tiles.build_tiles([tiles.overlay_rows(df, "shapes", {"minzoom": 3, "maxzoom": 3, "extent": 4096, "buffer_px": 80})])
    got = {r.fid: r for r in tiles.tile_features(built).collect()}
    assert {(r.z, r.layer, r.extent) for r in got.values()} == {(3, "shapes", 4096)}
    assert [(r.layer, r.extent, r.features) for r in tiles.tile_summary(built).collect()] == [("shapes", 4096, 3)]
    assert [json.loads(got[i].props) for i in (0, 7, 9)] == [{"name": "a", "number": 1.5, "flag": True}, {"name": "\u00e9", "flag": False}, {"number": -3.0}]
    assert [(got[i].shape, [len(p) for p in got[i].parts]) for i in (0, 7, 9)] == [(2, [3, 2]), (1, [1]), (3, [4])]
    assert got[9].parts[0][0] == got[9].parts[0][-1] and all(0 <= p.x <= 4096 and 0 <= p.y <= 4096 for r in got.values() for part in r.parts for p in part)
    point = got[7].parts[0][0]  # the place it was put at, to a pixel
    x, y = (18.1 + 180) / 360, 0.5 - np.log(np.tan(np.pi / 4 + np.radians(59.1) / 2)) / (2 * np.pi)
    assert abs(point.x - (x * 8 % 1) * 4096) <= 1 and abs(point.y - (y * 8 % 1) * 4096) <= 1


def test_command_line(spark, tmp_path):
    lines = [{"type": "Feature", "properties": {"highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[18 + i / 10, 59], [18.05 + i / 10, 59.02]]}} for i in range(5)]
    (tmp_path / "in.geojsonl").write_text("\n".join(map(json.dumps, lines)))
    assert cli.main([str(tmp_path / "in.geojsonl"), str(tmp_path / "out.pmtiles"), "-f", "pmtiles"], spark) == 0
    header, _ = archive.read_metadata(str(tmp_path / "out.pmtiles"))
    assert (header["min_zoom"], header["max_zoom"]) == (6, 15)
    read = tiles.tile_features(archive.read_archive(spark, str(tmp_path / "out.pmtiles")).filter("z = 9"))
    assert {r.fid for r in read.collect()} == set(range(5))
