"""Steps that must not gather in one row, one task or one loop what grows with the data."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh import session
from waymesh.functions import geometry as G
from waymesh.operators import graph, profile, tiles
from waymesh.plans.queries import QUERIES


def test_a_full_tile_is_streamed(spark):
    point = F.struct((F.col("id") % 97 * 1000.0).alias("x"), (F.col("id") % 89 * 1000.0).alias("y"))
    rows = spark.range(5000).select(
        F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("layer"), F.col("id").alias("fid"),
        F.concat(F.lit('{"k":'), F.col("id") % 3, F.lit("}")).alias("props"), F.array(F.array(point)).alias("parts"), F.lit(1).alias("shape"),
    )
    built = tiles.build_tiles([rows])
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        [tile] = built.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [(f["layer"], f["fid"], f["props"]) for f in tiles.decode_tile(bytes(tile.tile))]
    assert found == [(layer, i, f'{{"k": {i % 3}}}') for layer, some in (("a", False), ("b", True)) for i in range(5000) if (i % 5 == 0) == some]


def test_a_large_layer_waits_in_a_file(monkeypatch):
    def packed():
        layer = tiles._Layer("roads")
        for i in range(50):
            layer.add([i], [f'{{"a":{i % 7}}}'], [1], [b"\x09\x02\x02"])
        return tiles._tile([layer], 4096), layer

    small, _ = packed()
    monkeypatch.setattr(tiles, "BODY_BYTES", 100)
    monkeypatch.setattr(tiles, "KNOWN_PROPS", 2)
    large, layer = packed()
    assert layer.body._rolled and large == small


def test_finished_half_edges_look_nothing_up(spark, monkeypatch):
    plans = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    links = spark.createDataFrame([(i, i + 1 if i % 4 < 3 else None) for i in range(40)], "h long, nxt long")
    paths, rings = graph._ranked(links)
    assert rings.isEmpty() and {(r.h, r.last, r.d) for r in paths.collect()} == {(i, i - i % 4 + 3, 3 - i % 4) for i in range(40)}
    looks_up = [[line for line in p.split("Join LeftOuter")[1].splitlines() if "Filter" in line and "isnotnull(nxt" in line] for p in plans if "Join LeftOuter" in p]
    assert looks_up and all(looks_up)


def test_chains_have_more_partitions_for_more_rows(spark, monkeypatch):
    seen = []
    cut = graph.cut
    monkeypatch.setattr(session, "PARTITION_ROWS", 10)
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(spark.conf.get("spark.sql.shuffle.partitions")), cut(df))[1])
    df = spark.range(95).select(F.col("id").alias("fid"), F.col("id").alias("a"), (F.col("id") + 1).alias("z"))
    assert {(r.fid, r.chain, r.pos, r.forward) for r in graph.chains(df).collect()} == {(i, 0, i, True) for i in range(95)}
    assert set(seen) == {"10"} and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def some_lines(seed, n):
    rng = np.random.default_rng(seed)
    lines = [rng.integers(0, 5, (rng.integers(2, 9), 2)).astype(float) for _ in range(n)]
    return rng, lines, np.concatenate(lines), np.array([len(v) for v in lines])


def test_parts_of_many_lines():
    rng, lines, points, sizes = some_lines(1, 200)
    along = G.distances_of_lines(points, sizes)
    each = [G.distances(v) for v in lines]
    assert np.array_equal(along, np.concatenate(each))
    line = rng.integers(0, len(lines), 2000)
    ends = np.array([sorted(rng.choice(each[i]) if rng.random() < 0.5 else rng.random() * each[i][-1] for _ in range(2)) for i in line])
    got, n = G.parts_of_lines(points, sizes, along, line, ends[:, 0], ends[:, 1])
    want = [G.part_of(lines[i], each[i], a, b) for i, (a, b) in zip(line, ends)]
    assert n.tolist() == [len(w) for w in want] and np.array_equal(got, np.concatenate(want))


def test_outlines_of_many_lines(monkeypatch):
    _, lines, points, sizes = some_lines(2, 300)
    half = np.linspace(0.1, 2, len(lines))
    rings, n = G.buffer_lines(points, sizes, half)
    each = [G.buffer_points(v, h) for v, h in zip(lines, half)]
    assert n.tolist() == [len(r) for r in each] and np.array_equal(rings, np.concatenate(each))
    simple = G.are_simple(rings, n)
    assert 0 < simple.sum() < len(simple)
    monkeypatch.setattr(G, "PAIRS", 7)
    assert np.array_equal(G.are_simple(rings, n), simple)


def test_quantiles_without_gathering(spark):
    for n in (0, 1, 2, 37, 101):
        df = spark.range(n).select(F.when(F.col("id") % 5 > 0, (F.col("id") * 7919 % 50).cast("double")).alias("v"))
        got = profile.robust_range(df, "v")
        assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = df.agg(F.percentile("v", 0.02).alias("vlow"), F.percentile("v", 0.98).alias("vhigh")).first()
        assert tuple(got.first()) == tuple(want)


def test_lines_are_spread_over_tiles_once(spark, sf_dir):
    built = QUERIES["tiles_encoded"](spark, sf_dir)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1 and plan.count("MapInArrow") == 2 and "Generate" not in plan and plan.count("RepartitionByExpression") == 1
    got = built.collect()
    assert len(got) == len({(r.z, r.x, r.y) for r in got}) > 100


SMALL = {"minzoom": 3, "maxzoom": 9, "extent": 4096, "buffer_px": 80}


def odd_lines(seed, n):
    """Long and short lines, lines of one point, repeated points, some beyond the map's northern edge."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, n)
    lines = [np.cumsum(rng.normal(0, 10.0 ** rng.integers(-4, 1), (k, 2)), axis=0) + (rng.uniform(-170, 170), rng.choice([-84.0, 0.0, 59.0, 85.0, 89.0])) for k in sizes]
    lines = [np.round(np.clip(v, (-180, -90), (180, 90)), rng.choice([1, 9])) for v in lines]
    return lines, np.concatenate(lines), sizes, rng.integers(3, 12, n)


def plain_features(lines, first):
    """(line, z, x, y) and parts, line by line and tile by tile."""
    out = {}
    for i, (v, z0) in enumerate(zip(lines, first)):
        if not np.isfinite(v).all():
            continue
        for z in range(z0, SMALL["maxzoom"] + 1):
            side = 2 * G.WORLD / 2.0**z
            m = G.mercator_points(v)
            if z < SMALL["maxzoom"]:
                m = G.simplify_points(m, side / 4096 / 2)
            if G.distances(m)[-1] < side / 4096 / 2:
                continue
            cell = lambda c, s=side, z=z: min(max(math.floor(c / s), 0), 2**z - 1)
            (west, south), (east, north) = m.min(axis=0), m.max(axis=0)
            pad = side * 80 / 4096
            for x in range(cell(west + G.WORLD), cell(east + G.WORLD) + 1):
                for y in range(cell(G.WORLD - north), cell(G.WORLD - south) + 1):
                    box = (x * side - G.WORLD - pad, G.WORLD - (y + 1) * side - pad, (x + 1) * side - G.WORLD + pad, G.WORLD - y * side + pad)
                    inside = west >= box[0] and south >= box[1] and east <= box[2] and north <= box[3]
                    if parts := [m] if inside else G.clip_points(m, box):
                        out[i, z, x, y] = [p.tolist() for p in parts]
    return out


@pytest.mark.parametrize("some", [1, 50, 1 << 17])
def test_lines_in_tiles(monkeypatch, some):
    lines, points, sizes, first = odd_lines(3, 40)
    points[int(sizes[0])] = lines[1][0] = (np.nan, 1.0)
    monkeypatch.setattr(tiles, "SOME_POINTS", some)
    got = {}
    for line, z, x, y, points_, of_part, parts in tiles._in_tiles(points, sizes, first, SMALL):
        cut = iter(np.split(points_, np.cumsum(of_part)[:-1]))
        for *key, n in zip(line.tolist(), z.tolist(), x.tolist(), y.tolist(), parts.tolist()):
            assert tuple(key) not in got
            got[tuple(key)] = [next(cut).tolist() for _ in range(n)]
    assert got == plain_features(lines, first) and len(got) > 200


def packed_batches(seed, n, share):
    """Features packed by some tasks, in the order in which one task would read them."""
    lines, points, sizes, first = odd_lines(seed, n)
    fid = np.random.default_rng(seed).permutation(np.arange(n) // 2 * 9)  # ids come twice
    props = np.array([f'{{"a":{i % 5},"b":"{i % 3}"}}' for i in range(n)], object)
    out = []
    for a in range(0, n, share):
        v = np.concatenate(lines[a : a + share])
        batch = pa.record_batch([pa.array(fid[a : a + share]), pa.array(props[a : a + share]), pa.array(first[a : a + share].astype(np.int32)), G._to_arrow(v, sizes[a : a + share])], ["fid", "props", "first", "line"])
        out += tiles._drawn_lines(SMALL, "roads")(iter([batch]))
    return pa.Table.from_batches(out).sort_by([(c, "ascending") for c in ("at", "layer", "bucket")])


@pytest.mark.parametrize("share", [7, 100])
def test_tiles_do_not_depend_on_how_they_were_packed(monkeypatch, share):
    tiles_of = lambda table, rows: {(r["z"], r["x"], r["y"]): r["tile"] for b in tiles._encoder(4096)(iter(table.combine_chunks().to_batches(rows))) for r in b.to_pylist()}
    want = tiles_of(packed_batches(5, 100, 100), 10000)
    monkeypatch.setattr(tiles, "BUCKET", 4)
    monkeypatch.setattr(tiles, "ROW_FEATURES", 1)
    monkeypatch.setattr(tiles, "HELD_FEATURES", 20)
    monkeypatch.setattr(tiles, "SLICE_FEATURES", 3)
    monkeypatch.setattr(tiles, "KNOWN_TABLES", 2)
    assert tiles_of(packed_batches(5, 100, share), 5) == want and len(want) > 100
    assert sum(len(tiles.decode_tile(t)) for t in want.values()) > 300
    with pytest.raises(ValueError, match="another extent"):
        list(tiles._encoder(512)(iter(packed_batches(5, 10, 10).to_batches())))


def test_packed_rows_build_the_tiles_of_tile_rows(spark):
    lines, *_ = odd_lines(7, 60)
    rows = [(i, "primary" if i % 3 else None, [(float(x), float(y)) for x, y in v]) for i, v in enumerate(lines)]
    df = spark.createDataFrame([*rows, (99, "primary", None), (98, "primary", [])], f"fid int, highway string, vertices {G.LINE}")
    built = [{(r.z, r.x, r.y): bytes(r.tile) for r in tiles.build_tiles([make(df, "highway", ["highway"], {"primary": 5}, SMALL)]).collect()} for make in (tiles.tile_rows, tiles.packed_rows)]
    assert built[0] == built[1] and len(built[0]) > 100
