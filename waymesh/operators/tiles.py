"""Vector tiles: which edges a tile holds, their geometry in it, and the encoded tile.

Everything up to the one shuffle by tile is narrow: rows are gated by class and zoom, simplified once for each zoom, dropped if
under half a pixel, and only then spread over the tiles of their box, for all lines of an Arrow batch at once. Lines whose box lies
within one padded tile skip clipping. What is shuffled are drawings, a row for the features of a batch in one tile; a tile is one
row, as large as a tile is.
"""

from __future__ import annotations

import gzip
import json
import tempfile
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions import geometry as G
from waymesh.operators.filters import min_zoom_of, tile_columns
from waymesh.session import with_dense_ids
from waymesh.sources.settings import DEFAULT


def tile_size(zoom: Column) -> Column:
    return F.lit(2 * G.WORLD) / F.pow(F.lit(2.0), zoom)


def tile_index(metres: Column, zoom: Column, axis: str) -> Column:
    """The tile that a mercator coordinate falls in, within the world. y counts from the north."""
    most = F.pow(F.lit(2.0), zoom).cast("bigint") - 1
    at = (metres + G.WORLD) if axis == "x" else (F.lit(G.WORLD) - metres)
    return F.least(F.greatest(F.floor(at / tile_size(zoom)), F.lit(0).cast("bigint")), most)


def tile_cover(df: DataFrame, zoom: Column, box: str = "box") -> DataFrame:
    """df once for each tile that its mercator box touches: a generator, not a join."""
    b = F.col(box)
    xs = F.sequence(tile_index(b["minx"], zoom, "x"), tile_index(b["maxx"], zoom, "x"))
    ys = F.sequence(tile_index(b["maxy"], zoom, "y"), tile_index(b["miny"], zoom, "y"))
    return df.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def tile_bounds(zoom: Column, x: Column, y: Column) -> Column:
    s = tile_size(zoom)
    return F.struct((x * s - G.WORLD).alias("minx"), (F.lit(G.WORLD) - (y + 1) * s).alias("miny"), ((x + 1) * s - G.WORLD).alias("maxx"), (F.lit(G.WORLD) - y * s).alias("maxy"))


def tile_rows(df: DataFrame, class_col: str | None, keep: Sequence[str] = (), min_zoom: Mapping[str, int] | None = None, options: Mapping[str, int] = DEFAULT.tiles, layer: str = "roads", whole: bool = False, lines: str = "vertices") -> DataFrame:
    """(z, x, y, layer, fid, props, parts): each edge's line in each tile, in mercator metres. whole: features aren't
    simplified or clipped, for labels."""
    if not whole:
        base = _gated(df, class_col, tile_columns(df, keep), min_zoom, options, lines)
        return base.mapInArrow(_rows_of(options, layer), T.StructType([*_CELL, T.StructField("layer", T.StringType()), base.schema["fid"], base.schema["props"], T.StructField("parts", G.LINES_TYPE)]))
    base = _gated(df, class_col, [c for c in df.columns if c not in ("fid", lines)], min_zoom, options, lines)
    base = base.select("fid", "props", "first", G.to_mercator(F.col("line")).alias("m"))
    base = base.withColumn("box", G.bounds(F.col("m")))
    last = F.lit(options["maxzoom"])
    rows = base.withColumn("z", F.explode(F.when(F.col("first") <= last, F.sequence("first", last)).otherwise(F.array().cast("array<int>"))))
    return tile_cover(rows, F.col("z")).select("z", "x", "y", F.lit(layer).alias("layer"), "fid", "props", F.array("m").alias("parts"))


def packed_rows(df: DataFrame, class_col: str | None, keep: Sequence[str] = (), min_zoom: Mapping[str, int] | None = None, options: Mapping[str, int] = DEFAULT.tiles, layer: str = "roads", lines: str = "vertices") -> DataFrame:
    """tile_rows, drawn and packed for build_tiles at once: a line becomes many features, which are never rows of their own."""
    base = _gated(df, class_col, tile_columns(df, keep), min_zoom, options, lines)
    return base.withColumn("fid", F.col("fid").cast("long")).mapInArrow(_drawn_lines(options, layer), PACKED)


def _gated(df: DataFrame, class_col: str | None, names: Sequence[str], min_zoom: Mapping[str, int] | None, options: Mapping[str, int], lines: str) -> DataFrame:
    """(fid, props, first, line): edges with their first zoom."""
    props = F.to_json(F.struct(*names)) if names else F.lit("{}")
    gate = min_zoom_of(F.col(class_col), min_zoom) if class_col and min_zoom else F.lit(0)
    return df.filter(F.size(lines) > 0).select("fid", props.alias("props"), F.greatest(gate, F.lit(options["minzoom"])).cast("int").alias("first"), F.col(lines).alias("line"))


def overlay_rows(df: DataFrame, layer: str, options: Mapping[str, int] = DEFAULT.tiles) -> DataFrame:
    """tile_rows of an overlay: features of any type, whole, in each tile that their box touches. df: geometry and
    attributes; fid is the row's number by its geometry where it has none."""
    df = df.drop("vertices").withColumn("__all", F.flatten("geometry.parts"))
    ided = df if "fid" in df.columns else with_dense_ids(df, "__all")
    names = [c for c in df.columns if c not in ("fid", "geometry", "__all")]
    rows = ided.filter(F.size("__all") > 0).select(
        "fid",
        (F.to_json(F.struct(*names)) if names else F.lit("{}")).alias("props"),
        F.col("geometry.gtype").alias("gtype"),
        F.transform("geometry.parts", G.to_mercator).alias("parts"),
        G.bounds(G.to_mercator(F.col("__all"))).alias("box"),
    )
    rows = rows.withColumn("z", F.explode(F.sequence(F.lit(options["minzoom"]), F.lit(options["maxzoom"]))))
    spread = tile_cover(rows, F.col("z"))
    return spread.select("z", "x", "y", F.lit(layer).alias("layer"), "fid", "props", "parts", shape_of(F.col("gtype")).alias("shape"))


def shape_of(gtype: Column) -> Column:
    """A tile's geometry type: 1 points, 2 lines, 3 polygons."""
    return F.when(gtype.endswith("Point"), 1).when(gtype.endswith("Polygon"), 3).otherwise(2)


def build_tiles(layers: Sequence[DataFrame], extent: int = 4096) -> DataFrame:
    """(z, x, y, tile): gzipped vector tiles from the tile_rows or packed_rows of several layers, one shuffle in all. Tasks stream over
    their features in order, so a tile is never gathered before it is encoded; zooms up to 29."""
    packed = [rows if "drawings" in rows.columns else _packed(rows, extent) for rows in layers]
    rows = packed[0]
    for more in packed[1:]:
        rows = rows.unionByName(more)
    in_order = rows.repartition("at").sortWithinPartitions("at", "layer", "bucket")
    return in_order.mapInArrow(_encoder(extent), "z int, x long, y long, tile binary")


def _packed(rows: DataFrame, extent: int) -> DataFrame:
    shape = F.coalesce("shape", F.lit(2)) if "shape" in rows.columns else F.lit(2)
    flat = rows.select(*[F.col(c).cast("long").alias(c) for c in "zxy"], "layer", F.col("fid").cast("long").alias("fid"), "props", shape.cast("long").alias("shape"), "parts")
    return flat.mapInArrow(_drawn_rows(extent), PACKED)


def tile_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("z", "x", "y", "layer").agg(F.count("*").alias("features"))


def sidecar(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(fid, props, mid, bbox) of every edge; of a multi-line the first part counts. Joins tiles by fid."""
    first = F.get(F.col(geometry)["parts"], F.lit(0))
    names = [c for c in df.columns if c not in ("fid", geometry)]
    some = F.size(first) > 0
    return df.select("fid", F.to_json(F.struct(*names)).alias("props"), F.when(some, G.mid_vertex(first)).alias("mid"), F.when(some, G.bounds(first)).alias("bbox"))


# -- spreading ------------------------------------------------------------------------------------------------------

_CELL = [T.StructField("z", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]
SOME_POINTS = 1 << 17  # of lines at zooms, or of lines in tiles, that are looked at at once


def _blocks(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours that weigh so much in all at most, or one that weighs more: where they begin and end."""
    total = np.cumsum(weights)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _points_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    points, sizes = G._from_arrow(lines)
    return points.astype(float), sizes


def _members(points: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The points of some lines, which may come again."""
    n = sizes[lines]
    shift = (np.cumsum(sizes) - sizes)[lines] - (np.cumsum(n) - n)
    return points.take(np.repeat(shift, n) + np.arange(int(n.sum())), axis=0)


def _in_tiles(points: np.ndarray, sizes: np.ndarray, first: np.ndarray, options: Mapping[str, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Lines in tiles, some at a time: the line of each feature; z, x and y of its tile; points, the points of each part, the parts of
    each feature. points: in degrees; sizes: points of each line; first: each line's first zoom. A line with a coordinate that is no
    finite number is in no tile, as it can't be drawn."""
    last, extent = options["maxzoom"], options["extent"]
    usable = np.bincount(G._each(sizes)[0][~np.isfinite(points).all(axis=1)], minlength=len(sizes)) == 0
    line, nth = G._each(np.where(usable, np.maximum(last - first + 1, 0), 0))
    zoom = first[line] + nth
    metres = G.mercator_points(points)
    for a, b in _blocks(sizes[line], SOME_POINTS):
        of, z = line[a:b], zoom[a:b]
        side = 2 * G.WORLD / 2.0**z
        tolerance = side / extent / 2
        n, m = sizes[of], _members(metres, sizes, of)
        owner = G._each(n)[0]
        coarse = (z < last) & (n > 2)
        some = np.flatnonzero(coarse[owner])
        kept = np.ones(len(m), bool)
        kept[some] = G.simplify_lines(m.take(some, axis=0), n[coarse], tolerance[coarse])
        some = np.flatnonzero(kept)
        m, owner = m.take(some, axis=0), owner[some]
        n = np.bincount(owner, minlength=len(of))
        step = np.zeros(len(m))
        step[1:] = np.hypot(m[1:, 0] - m[:-1, 0], m[1:, 1] - m[:-1, 1])
        step[np.cumsum(n) - n] = 0
        long = np.bincount(owner, weights=step, minlength=len(of)) >= tolerance
        if not long.all():
            m, n, of, z, side = m.take(np.flatnonzero(long[owner]), axis=0), n[long], of[long], z[long], side[long]
        yield from _cells(m, n, of, z, side, options)


def _cells(points: np.ndarray, sizes: np.ndarray, line: np.ndarray, z: np.ndarray, side: np.ndarray, options: Mapping[str, int]) -> Iterator[tuple[np.ndarray, ...]]:
    if not len(sizes):
        return
    begin = np.cumsum(sizes) - sizes
    west, south, east, north = (f.reduceat(c, begin) for f in (np.minimum, np.maximum) for c in (points[:, 0].copy(), points[:, 1].copy()))
    most = (1 << z) - 1
    index = lambda v: np.minimum(np.maximum(np.floor(v / side).astype(np.int64), 0), most)
    x0, x1 = index(west + G.WORLD), index(east + G.WORLD)
    y0, y1 = index(G.WORLD - north), index(G.WORLD - south)
    high_by = y1 - y0 + 1
    counts = (x1 - x0 + 1) * high_by
    for a, b in _blocks(counts * sizes, SOME_POINTS):
        total = int(counts[a:b].sum())
        some = total if b - a > 1 else max(1, SOME_POINTS // int(sizes[a]))  # of one line's tiles
        for start in range(0, total, some):
            of, nth = G._each(counts[a:b]) if b - a > 1 else (np.zeros(min(some, total - start), np.int64), np.arange(start, min(start + some, total)))
            of = of + a
            x, y, s = x0[of] + nth // high_by[of], y0[of] + nth % high_by[of], side[of]
            pad = s * (options["buffer_px"] / options["extent"])
            box = x * s - G.WORLD - pad, G.WORLD - (y + 1) * s - pad, (x + 1) * s - G.WORLD + pad, G.WORLD - y * s + pad
            inside = (west[of] >= box[0]) & (south[of] >= box[1]) & (east[of] <= box[2]) & (north[of] <= box[3])
            fits, cut = np.flatnonzero(inside), np.flatnonzero(~inside)
            if len(fits):
                yield line[of[fits]], z[of[fits]], x[fits], y[fits], _members(points, sizes, of[fits]), sizes[of[fits]], np.ones(len(fits), np.int64)
            if len(cut):
                clipped, of_part, parts = G.clip_lines(_members(points, sizes, of[cut]), sizes[of[cut]], np.stack([side_at[cut] for side_at in box], axis=1))
                cut, parts = cut[parts > 0], parts[parts > 0]
                yield line[of[cut]], z[of[cut]], x[cut], y[cut], clipped, of_part, parts


def _rows_of(options: Mapping[str, int], layer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, z, x, y, points, of_part, parts in _in_tiles(*_points_of(batch.column("line")), batch.column("first").to_numpy().astype(np.int64), options):
                lines = pa.ListArray.from_arrays(G._offsets(parts), G._to_arrow(points, of_part))
                same = [batch.column(c).take(pa.array(line)) for c in ("fid", "props")]
                yield pa.record_batch([pa.array(z.astype(np.int32)), pa.array(x), pa.array(y), pa.array([layer] * len(line), pa.string()), *same, lines], ["z", "x", "y", "layer", "fid", "props", "parts"])

    return run


# -- packing --------------------------------------------------------------------------------------------------------

#: The features of some rows in one tile and layer, whose ids agree but for the last BUCKET bits. Numbers and drawings one after
#: the other; kinds: the place of each feature's attributes in props; sizes: bytes of each drawing.
PACKED = "at long, layer string, bucket long, extent int, props array<string>, fids binary, kinds binary, shapes binary, sizes binary, drawings binary"
BUCKET = 12
DRAWN_ROWS = 4096  # of tile_rows, that are drawn at once
HELD_FEATURES, HELD_BYTES = 1 << 17, 16 << 20  # that are packed at once
ROW_FEATURES, ROW_BYTES = 10, 16  # a row has 1,024 features at most, and begins anew with each 64 KB of drawings


class _Packer:
    """Gathers features of some batches and packs them by tile."""

    def __init__(self, extent: int) -> None:
        self.extent = extent
        self.clear()

    def clear(self) -> None:
        self.texts: dict[str, int] = {}
        self.layers: dict[str, int] = {}
        self.held: list[tuple] = []
        self.features = self.bytes = 0

    @staticmethod
    def codes(known: dict[str, int], column: pa.Array) -> np.ndarray:
        named = column.cast(pa.string()).dictionary_encode()
        return np.array([known.setdefault(t, len(known)) for t in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]

    def add(self, z: np.ndarray, x: np.ndarray, y: np.ndarray, layer: np.ndarray, fid: np.ndarray, text: np.ndarray, shape: np.ndarray, points: np.ndarray, of_part: np.ndarray, parts: np.ndarray) -> None:
        side = 2 * G.WORLD / 2.0**z
        feature = np.repeat(np.repeat(np.arange(len(z)), parts), of_part)  # of each point
        west, north, side = (x * side - G.WORLD)[feature], (G.WORLD - y * side)[feature], side[feature]
        pixels = np.stack([((points[:, 0] - west) / side * self.extent).round(), ((north - points[:, 1]) / side * self.extent).round()]).astype(np.int64).T
        drawn, bounds = _drawings_at(pixels, of_part, parts, shape)
        self.held.append((z << 58 | x << 29 | y, layer, fid, text, shape, np.diff(bounds), bounds[:-1] + self.bytes, np.frombuffer(drawn, np.uint8)))
        self.features += len(z)
        self.bytes += len(drawn)

    def full(self) -> bool:
        return self.features >= HELD_FEATURES or self.bytes >= HELD_BYTES

    def packed(self) -> Iterator[pa.RecordBatch]:
        if self.features:
            at, layer, fid, text, shape, size, begin, drawn = map(np.concatenate, zip(*self.held))
            order = np.lexsort((fid, layer, at) if len(self.layers) > 1 else (fid, at))
            at, layer, fid, text, shape, size, begin = (c[order] for c in (at, layer, fid, text, shape, size, begin))
            of, nth = G._each(size)
            drawn = drawn[begin[of] + nth]
            keys = (at, layer, fid >> BUCKET, np.arange(len(at)) >> ROW_FEATURES, np.cumsum(size) >> ROW_BYTES)
            new = np.ones(len(at), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.append(np.flatnonzero(new), len(at))
            row = np.cumsum(new) - 1
            some, kind = np.unique(row * len(self.texts) + text, return_inverse=True)  # attributes that a row has
            of_row = np.searchsorted(some, np.arange(len(starts)) * len(self.texts))
            texts = pa.array(list(self.texts), pa.string()).take(pa.array(some % len(self.texts)))
            numbers = lambda values, kind: _binaries(values.astype(kind), starts * np.dtype(kind).itemsize)
            ends = np.concatenate(([0], np.cumsum(size)))
            names = pa.array(list(self.layers), pa.string())
            yield pa.record_batch(
                [
                    pa.array(at[starts[:-1]]), names.take(pa.array(layer[starts[:-1]])), pa.array(fid[starts[:-1]] >> BUCKET), pa.array(np.full(len(starts) - 1, self.extent, np.int32)),
                    pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), texts), numbers(fid, np.int64), numbers(kind - of_row[row], np.int32), numbers(shape, np.int8), numbers(size, np.int32), _binaries(drawn, ends[starts]),
                ],
                ["at", "layer", "bucket", "extent", "props", "fids", "kinds", "shapes", "sizes", "drawings"],
            )
        self.clear()


def _binaries(data: np.ndarray | bytes, bounds: np.ndarray) -> pa.Array:
    """Pieces of bytes that follow one another."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _drawn_lines(options: Mapping[str, int], layer: str):
    """Packs lines, see packed_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(options["extent"])
        for batch in batches:
            fids, first = batch.column("fid").to_numpy(), batch.column("first").to_numpy().astype(np.int64)
            text = None
            for line, z, x, y, points, of_part, parts in _in_tiles(*_points_of(batch.column("line")), first, options):
                if text is None:
                    text = packer.codes(packer.texts, batch.column("props"))
                    packer.layers[layer] = 0
                packer.add(z, x, y, np.zeros(len(z), np.int64), fids[line], text[line], np.full(len(z), 2), points, of_part, parts)
                if packer.full():
                    yield from packer.packed()
                    text = None
        yield from packer.packed()

    return run


def _drawn_rows(extent: int):
    """Packs tile_rows."""

    def lists(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
        return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(extent)
        for whole in batches:
            for start in range(0, len(whole), DRAWN_ROWS):
                batch = whole.slice(start, DRAWN_ROWS)
                z, x, y, fid, shape = (batch.column(c).to_numpy() for c in ("z", "x", "y", "fid", "shape"))
                parts, lines = lists(batch.column("parts"))
                points, of_part = _points_of(lines)
                packer.add(z, x, y, packer.codes(packer.layers, batch.column("layer")), fid, packer.codes(packer.texts, batch.column("props")), shape, points, of_part, parts)
                if packer.full():
                    yield from packer.packed()
        yield from packer.packed()

    return run


# -- encoding -------------------------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes | int) -> bytes:
    if isinstance(data, int):
        return _varint(number << 3) + _varint(data)
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _field(7, int(v))
    if isinstance(v, int):
        return _field(6, _zigzag(v))
    if isinstance(v, float):
        return b"\x19" + np.float64(v).tobytes()
    return _field(1, str(v).encode())


def _drawings(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, shapes: np.ndarray) -> list[bytes]:
    data, bounds = _drawings_at(points, sizes, parts, shapes)
    return [data[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def _drawings_at(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, shapes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The drawing of each of many features at once: one move for all points; a move and a line for each line; a closing for each
    ring. points: whole pixels; sizes: points of each part; parts: parts of each feature. Drawings follow one another in one text
    of bytes; bounds: where each begins, and the last ends.

    Points that repeat the one before are left out of lines and rings, as is a ring's last point where it is its first; a part
    that has too few points then is not drawn, and a feature without a part has an empty drawing."""
    feature = np.repeat(np.arange(len(parts)), parts)  # of each part
    # The points of a feature are one part.
    own = np.ones(len(feature), bool)
    own[1:] = (feature[1:] != feature[:-1]) | (shapes[feature[1:]] != 1)
    part = np.repeat(np.cumsum(own) - 1, sizes)  # of each point
    feature = feature[own]
    shape = shapes[feature]
    sizes = np.bincount(part, minlength=len(feature))

    px, py = points[:, 0], points[:, 1]

    def only(kept: np.ndarray) -> None:
        nonlocal px, py, part, sizes
        if not kept.all():
            some = np.flatnonzero(kept)
            px, py, part = px[some], py[some], part[some]
            sizes = np.bincount(part, minlength=len(feature))

    fresh = np.ones(len(px), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1]) | (shape[part[1:]] == 1)
    only(fresh)
    ends = np.cumsum(sizes)
    rings = np.flatnonzero((shape == 3) & (sizes > 1))
    first, last = ends[rings] - sizes[rings], ends[rings] - 1
    kept = np.ones(len(px), bool)
    kept[last[(px[last] == px[first]) & (py[last] == py[first])]] = False
    only(kept)
    only((sizes >= shape)[part])

    begins = np.ones(len(px), bool)
    of = feature[part]
    begins[1:] = of[1:] != of[:-1]
    moves = [np.where(begins, c, np.diff(c, prepend=0)) for c in (px, py)]
    drawn = np.flatnonzero(sizes)
    size, kind = sizes[drawn], shape[drawn]
    length = 1 + 2 * size + (kind > 1) + (kind == 3)
    at = np.cumsum(length) - length
    values = np.zeros(int(length.sum()), np.int64)
    values[at] = np.where(kind == 1, size << 3 | 1, 9)
    lines = kind > 1
    values[at[lines] + 3] = size[lines] - 1 << 3 | 2
    values[(at + length - 1)[kind == 3]] = 15
    nth = np.arange(len(px)) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(at, size) + 1 + 2 * nth + (np.repeat(lines, size) & (nth > 0))
    values[place], values[place + 1] = map(_zigzags, moves)

    values_to = np.concatenate(([0], np.cumsum(np.bincount(feature[drawn], weights=length, minlength=len(parts)).astype(np.int64))))
    ends = np.cumsum(sizes_of := _varint_sizes(values))
    return _varints(values, sizes_of), np.concatenate(([0], ends))[values_to]


def _varint_sizes(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    most = int(v.max()) if len(v) else 0
    for bits in range(7, 64, 7):
        if most >> bits:
            size += v >= np.uint64(1 << bits)
    return size


def _zigzags(n: np.ndarray) -> np.ndarray:
    return n << 1 ^ n >> 63


def _varints(values: np.ndarray, size: np.ndarray | None = None) -> bytes:
    """Many varints at once: seven bits a byte, the lowest first. size: their _varint_sizes, if known."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    size = _varint_sizes(v) if size is None else size
    end = np.cumsum(size)
    out = np.empty(int(end[-1]), np.uint8)
    at = end - size
    out[at] = (v & np.uint64(127)).astype(np.uint8) | ((size > 1) * np.uint8(128))
    more = np.flatnonzero(size > 1)
    for i in range(1, int(size.max())):
        more = more[size[more] > i]
        out[at[more] + i] = (v[more] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8) | ((size[more] > i + 1) * np.uint8(128))
    return out.tobytes()


BODY_BYTES = 32 << 20  # of a layer's features that are kept in memory
KNOWN_PROPS = 1 << 16  # texts whose tags a layer remembers


_LAYER = _varint(3 << 3 | 2)


class _Layer:
    """A layer in the Mapbox Vector Tile format, version 2, to which features are added in order. How long it is comes first in a
    tile, so many features wait in a temporary file."""

    def __init__(self, name: str) -> None:
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.known: dict[str, bytes] = {}  # many features say the same
        self.body = tempfile.SpooledTemporaryFile(BODY_BYTES)
        self.head = _field(15, 2) + _field(1, name.encode())
        self.body.write(self.head)

    def _tags(self, text: str) -> bytes:
        found = self.known.get(text)
        if found is None:
            out = []
            for k, v in json.loads(text).items():
                if v is not None:
                    out += [self.keys.setdefault(k, len(self.keys)), self.values.setdefault((type(v), v if not isinstance(v, dict | list) else json.dumps(v)), len(self.values))]
            if len(self.known) >= KNOWN_PROPS:
                self.known.clear()
            found = self.known[text] = _field(2, b"".join(map(_varint, out)))
        return found

    def add(self, fids: Sequence[int], props: Sequence[str], shapes: Sequence[int], drawings: Sequence[bytes]) -> None:
        """props: JSON objects; features without a drawing are left out."""
        self.body.writelines(_field(2, _field(1, fid) + self._tags(text) + _field(3, shape) + _field(4, drawing)) for fid, text, shape, drawing in zip(fids, props, shapes, drawings) if drawing)

    def tags(self, texts: Sequence[str]) -> list[bytes]:
        return list(map(self._tags, texts))

    def tail(self, extent: int) -> bytes:
        return b"".join([*(_field(3, k.encode()) for k in self.keys), *(_field(4, _value(v)) for _, v in self.values), _field(5, extent)])

    def message(self, extent: int) -> Iterator[bytes]:
        """The layer, piece by piece."""
        self.body.write(self.tail(extent))
        yield _LAYER + _varint(self.body.tell())
        self.body.seek(0)
        yield from iter(lambda: self.body.read(1 << 20), b"")
        self.body.close()


def _tile(layers: Sequence[_Layer | bytes], extent: int) -> bytes:
    """A gzipped tile; of some layers there is the whole message."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    out, crc, size = [b"\x1f\x8b\x08\0\0\0\0\0\0\xff"], 0, 0  # no name, no time, an unknown system
    for layer in layers:
        for piece in (layer,) if isinstance(layer, bytes) else layer.message(extent):
            crc, size = zlib.crc32(piece, crc), size + len(piece)
            out.append(deflate.compress(piece))
    out += [deflate.flush(), crc.to_bytes(4, "little"), (size & 0xFFFFFFFF).to_bytes(4, "little")]
    return b"".join(out)


SLICE_FEATURES = 1 << 15  # that are encoded at once; 256 bytes of drawings count as one more
OUT_BYTES = 4 << 20  # of tiles in a batch, or one tile
KNOWN_TABLES, TABLE_TEXTS = 1 << 12, 16  # of tiles with so many different attributes at most, what a task remembers


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tile, layer and bucket, so that each bucket is whole, and some SLICE_FEATURES at a time."""

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(c)[i] == b.column(c)[j] for c in ("at", "layer", "bucket"))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = _starts(batch, "at", "layer", "bucket")
        if len(starts) == 1 and held and same(held[-1], 0, batch, 0):
            held.append(batch)
        elif len(starts):
            rest = len(batch) - int(starts[-1])
            yield from _some_buckets(pa.concat_batches([*held, batch.slice(0, int(starts[-1]))]))
            held = [batch.slice(len(batch) - rest)]
    if held:
        yield from _some_buckets(pa.concat_batches(held))


def _some_buckets(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    starts = np.append(_starts(rows, "at", "layer", "bucket"), len(rows))
    weights = pc.binary_length(rows.column("shapes")).to_numpy().astype(np.int64) + (pc.binary_length(rows.column("drawings")).to_numpy() >> 8)
    for a, b in _blocks(np.diff(np.concatenate(([0], np.cumsum(weights)))[starts]), SLICE_FEATURES):
        yield rows.slice(int(starts[a]), int(starts[b] - starts[a]))


def _starts(rows: pa.RecordBatch, *names: str) -> np.ndarray:
    """The rows in which one of the columns is another than before."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        column = lambda c: rows.column(c).dictionary_encode().indices.to_numpy() if c == "layer" else rows.column(c).to_numpy()
        new[1:] = np.any([v[1:] != v[:-1] for v in map(column, names)], axis=0)
    return np.flatnonzero(new)


def _content(column: pa.Array, kind: type) -> np.ndarray:
    """All numbers of a column of binaries, one after the other."""
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, kind, int(bounds[-1] - bounds[0]) // np.dtype(kind).itemsize, int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, kind)


def _features(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of packed rows, whose tiles and layers are numbered, the features in order of group, id, attributes, shape and drawing:
    group, fid, text, shape, drawing, and the texts."""
    n = pc.binary_length(rows.column("shapes")).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    starts = np.zeros(len(rows), np.int64)
    starts[_starts(rows, "at", "layer")] = 1
    group = (np.cumsum(starts) - 1)[row]
    of_row = pc.list_value_length(rows.column("props")).to_numpy().astype(np.int64)
    named = pc.list_flatten(rows.column("props")).dictionary_encode()
    texts = named.dictionary.to_pylist()
    text = named.indices.to_numpy().astype(np.int64)[(np.cumsum(of_row) - of_row)[row] + _content(rows.column("kinds"), np.int32)]
    fid, shape, size = (_content(rows.column(c), kind).astype(np.int64) for c, kind in (("fids", np.int64), ("shapes", np.int8), ("sizes", np.int32)))
    drawing = _binaries(_content(rows.column("drawings"), np.uint8), np.concatenate(([0], np.cumsum(size))))
    later = (group[1:] > group[:-1]) | (fid[1:] > fid[:-1])
    if not later.all():
        order = np.lexsort((fid, group))
        tied = np.zeros(len(order) + 1, bool)
        tied[1:-1] = (group[order][1:] == group[order][:-1]) & (fid[order][1:] == fid[order][:-1])
        tied = order[tied[1:] | tied[:-1]]
        if len(tied):
            by = lambda values: (ranks := {v: i for i, v in enumerate(sorted(set(values)))}, np.array([ranks[v] for v in values]))[1]
            drawn = np.zeros(len(order), np.int64)
            drawn[tied] = by(drawing.take(pa.array(tied)).to_pylist())
            order = np.lexsort((drawn, shape, by(texts)[text], fid, group))
        group, fid, text, shape, drawing = group[order], fid[order], text[order], shape[order], drawing.take(pa.array(order))
    return group, fid, text, shape, drawing, texts


def _messages(fid: np.ndarray, tags: pa.Array, shape: np.ndarray, drawing: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The messages of features in a layer, one after the other, and where each begins and the last ends."""
    size = pc.binary_length(drawing).to_numpy().astype(np.int64)

    def numbers(*columns: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        values = np.stack(np.broadcast_arrays(*columns, size)[:-1], axis=1).ravel()
        return values, np.concatenate(([0], np.cumsum(_varint_sizes(values))[len(columns) - 1 :: len(columns)]))

    rest, rest_to = numbers(3 << 3, shape, 4 << 3 | 2, size)
    length = 1 + _varint_sizes(fid) + pc.binary_length(tags).to_numpy() + np.diff(rest_to) + size
    head, head_to = numbers(2 << 3 | 2, length, 1 << 3, fid)
    joined = pc.binary_join_element_wise(_binaries(_varints(head), head_to), tags, _binaries(_varints(rest), rest_to), drawing, b"")
    return memoryview(joined.buffers()[2] or b""), np.concatenate(([0], np.cumsum(np.diff(head_to) + length - 1 - _varint_sizes(fid))))


def _encoder(extent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        tables: dict[tuple, tuple[list[bytes], bytes, bytes]] = {}
        now, name, layers = None, None, []
        for rows in _whole_buckets(batches):
            if pc.any(pc.not_equal(rows.column("extent"), extent)).as_py():
                raise ValueError(f"features were packed for another extent than {extent}")
            firsts = pa.array(_starts(rows, "at", "layer"))
            places, names = rows.column("at").take(firsts).to_pylist(), rows.column("layer").take(firsts).to_pylist()
            group, fid, text, shape, drawing, texts = _features(rows)
            drawn = pc.binary_length(drawing).to_numpy() > 0  # features without a drawing are left out
            if not drawn.all():
                group, fid, text, shape, drawing = group[drawn], fid[drawn], text[drawn], shape[drawn], drawing.filter(pa.array(drawn))
            # The attributes that each layer has, in the order in which they come.
            both = group * max(len(texts), 1) + text
            new = np.ones(len(both), bool)
            new[1:] = both[1:] != both[:-1]
            some, first, nth = np.unique(both[new], return_index=True, return_inverse=True)
            order = np.argsort(first)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            own = [texts[i] for i in (some[order] % max(len(texts), 1)).tolist()]
            own_to = np.searchsorted(some[order] // max(len(texts), 1), np.arange(len(places) + 1)).tolist()
            tags: list[bytes] = []
            written: list[_Layer | tuple[list[bytes], bytes, bytes]] = []
            for i, (a, b) in enumerate(zip(own_to, own_to[1:])):
                goes_on = i == 0 and layers and places[0] == now and names[0] == name
                if not goes_on and i < len(places) - 1:
                    key = (names[i], *own[a:b])
                    found = tables.get(key)
                    if found is None:
                        fresh = _Layer(names[i])
                        found = fresh.tags(own[a:b]), fresh.head, fresh.tail(extent)
                        if len(tables) >= KNOWN_TABLES:
                            tables.clear()
                        if b - a <= TABLE_TEXTS:
                            tables[key] = found
                    tags += found[0]
                    written.append(found)
                else:  # it may go on
                    written.append(layers[-1] if goes_on else _Layer(names[i]))
                    tags += written[-1].tags(own[a:b])
            of_feature = np.repeat(place[nth], np.diff(np.append(np.flatnonzero(new), len(both))))
            data, to = _messages(fid, pa.array(tags, pa.binary()).take(pa.array(of_feature)), shape, drawing)
            bounds = to[np.searchsorted(group, np.arange(len(places) + 1))].tolist()
            for at, name_at, layer, a, b in zip(places, names, written, bounds, bounds[1:]):
                if at != now:
                    if layers:
                        yield now, _tile(layers, extent)
                    now, layers = at, []
                name = name_at
                if isinstance(layer, tuple):
                    _, head, tail = layer
                    layers.append(b"".join((_LAYER, _varint(len(head) + b - a + len(tail)), head, data[a:b], tail)))
                else:
                    layer.body.write(data[a:b])
                    if not layers or layers[-1] is not layer:
                        layers.append(layer)
        if layers:
            yield now, _tile(layers, extent)

    def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at = np.array([r[0] for r in rows], np.int64)
        return pa.record_batch([pa.array((at >> 58).astype(np.int32)), pa.array(at >> 29 & (1 << 29) - 1), pa.array(at & (1 << 29) - 1), pa.array([r[1] for r in rows], pa.binary())], ["z", "x", "y", "tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in tiles_of(batches):
            rows.append(row)
            size += len(row[1])
            if size >= OUT_BYTES or len(rows) >= 1024:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


# -- decoding -------------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a message."""

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    at = 0
    while at < len(data):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            value = varint()
            if key & 7 == 0:
                yield key >> 3, value
                continue
            size = value
        yield key >> 3, data[at : at + size]
        at += size


def _read_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)) * 7
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def _read_value(data: bytes):
    number, v = next(_fields(data))
    if number == 1:
        return v.decode()
    if number in (2, 3):
        return float(np.frombuffer(v, "<f4" if number == 2 else "<f8")[0])
    return bool(v) if number == 7 else (v >> 1) ^ -(v & 1) if number == 6 else v


def _drawn(commands: np.ndarray, shape: int) -> list[list[dict[str, int]]]:
    """The parts of a drawing, in tile pixels; rings end where they begin."""
    parts: list[list[dict[str, int]]] = []
    i = x = y = 0
    while i < len(commands):
        command, times = int(commands[i]) & 7, int(commands[i]) >> 3
        i += 1
        if command == 7:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(times):
            x += int(commands[i] >> 1) ^ -int(commands[i] & 1)
            y += int(commands[i + 1] >> 1) ^ -int(commands[i + 1] & 1)
            i += 2
            if command == 1 and (shape != 1 or not parts):
                parts.append([])
            parts[-1].append({"x": x, "y": y})
    return parts


def decode_tile(tile: bytes) -> list[dict]:
    """The features of a gzipped vector tile: layer, extent, fid, props (JSON text), shape and parts."""
    out = []
    for _, layer in _fields(gzip.decompress(tile)):
        found: dict[int, list] = {}
        for number, value in _fields(layer):
            found.setdefault(number, []).append(value)
        name, extent = found[1][0].decode(), found.get(5, [4096])[0]
        keys, values = [k.decode() for k in found.get(3, [])], [_read_value(v) for v in found.get(4, [])]
        for feature in found.get(2, []):
            f = dict(_fields(feature))
            tags = _read_varints(f.get(2, b"")).tolist()
            props = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
            out.append({"layer": name, "extent": extent, "fid": f.get(1, 0), "props": json.dumps(props, ensure_ascii=False), "shape": f.get(3, 0), "parts": _drawn(_read_varints(f.get(4, b"")), f.get(3, 0))})
    return out


_FEATURE_FIELDS = "layer string, extent int, fid bigint, props string, shape int, parts array<array<struct<x:int,y:int>>>"
_POINTS = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
_FEATURE_KINDS = {"layer": pa.string(), "extent": pa.int32(), "fid": pa.int64(), "props": pa.string(), "shape": pa.int32(), "parts": _POINTS}


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, tile in enumerate(batch.column("tile")):
            features = decode_tile(tile.as_py())
            where = [pa.array([batch.column(c)[i].as_py()] * len(features), batch.column(c).type) for c in "zxy"]
            yield pa.record_batch([*where, *(pa.array([f[name] for f in features], kind) for name, kind in _FEATURE_KINDS.items())], ["z", "x", "y", *_FEATURE_KINDS])


def tile_features(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, extent, fid, props, shape, parts): a row for each feature of gzipped vector tiles (z, x, y, tile). parts are
    in pixels of the tile, from its north-western corner. Layers without features give no rows."""
    rows = tiles.filter("tile is not null").select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "tile")
    return rows.mapInArrow(_decode_batches, f"z int, x long, y long, {_FEATURE_FIELDS}")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, tile in enumerate(batch.column("tile")):
            where = [batch.column(c)[i].as_py() for c in "zxy"]
            for _, layer in _fields(gzip.decompress(tile.as_py())):
                name, extent, features = "", 4096, 0
                for number, value in _fields(layer):
                    if number == 2:
                        features += 1
                    elif number == 1:
                        name = value.decode()
                    elif number == 5:
                        extent = value
                rows.append((*where, name, extent, features))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["z", "x", "y", "layer", "extent", "features"])


def tile_summary(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, extent, features): how many features each layer of gzipped vector tiles has; they are not decoded."""
    rows = tiles.filter("tile is not null").select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "tile")
    return rows.mapInArrow(_summaries, "z int, x long, y long, layer string, extent int, features long")
