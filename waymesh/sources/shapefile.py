"""Shapefiles: geometries (.shp), their places (.shx), attributes (.dbf) and, if there, a coordinate system (.prj).

The index has eight bytes for each record and attributes have a fixed width, so any range of records can be read by itself:
each file is cut into ranges of SLICE records, and tasks read only the bytes of theirs.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator, Mapping
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.session import cut
from waymesh.sources.files import listed, sibling, store_of
from waymesh.sources.ingest import EdgeTable, normalise

SLICE = 50_000
HEADER = 100  # bytes, of .shp and .shx
#: Fixed values of the format: the codes of geometry types without Z or M; those with Z are 10 and those with M 20 higher.
POINT, POLYLINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
#: Systems by what their definitions are called.
SYSTEMS = {"GCS_WGS_1984": 4326, "WGS 84": 4326, "GCS_ETRS_1989": 4258, "GCS_North_American_1983": 4269, "GCS_SWEREF99": 4619, "SWEREF99_TM": 3006, "SWEREF99 TM": 3006, "WGS_1984_Web_Mercator_Auxiliary_Sphere": 3857, "WGS 84 / Pseudo-Mercator": 3857}
GEOMETRY = pa.struct([("gtype", pa.string()), ("parts", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
_GEOMETRY = "struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>"


def srid_of(definition: str) -> int | None:
    """The EPSG number of a coordinate system in well-known text; None for one that isn't known."""
    found = re.findall(r'^\s*(PROJ|GEOG)C?[SR]+S?\["([^"]*)"', definition)
    if not found:
        return None
    kind, name = found[0]
    zone = re.fullmatch(r"(?:WGS_1984|WGS 84|ETRS_1989|ETRS89)(?: / |_)UTM[ _][Zz]one[ _](\d{1,2})([NS])", name)
    if kind == "PROJ" and zone and 1 <= int(zone[1]) <= 60:
        base = 25800 if name.startswith("ETRS") else 32600 if zone[2] == "N" else 32700
        return base + int(zone[1])
    return SYSTEMS.get(name)


def _fields(head: bytes) -> list[tuple[str, str, int]]:
    """(name, type, width) of each attribute."""
    out, at = [], 32
    while head[at] != 0x0D:
        out.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16]))
        at += 32
    return out


def _spark_type(kind: str, decimals: int, width: int) -> str:
    if kind == "L":
        return "boolean"
    if kind == "D":
        return "date"
    if kind == "N" and decimals == 0 and width <= 18 or kind == "I":
        return "long"
    return "double" if kind in "NFOB" else "string"


def describe(path: str) -> dict:
    """Of a .shp file its number of records, attributes (name, kind, width, Spark type), their encoding and its EPSG number."""
    store, target = store_of(path)
    with store.open_input_file(target) as f:
        if struct.unpack(">i", f.read(4))[0] != 9994:
            raise ValueError(f"{path}: not a shapefile")
    with store.open_input_file(sibling(target, ".shx")) as f:
        n = (f.size() - HEADER) // 8
    with store.open_input_file(sibling(target, ".dbf")) as f:
        start = f.read(12)
        n_rows, head_bytes, row_bytes = struct.unpack_from("<IHH", start, 4)
        f.seek(0)
        head = f.read(head_bytes)
    if n_rows != n:
        raise ValueError(f"{path}: {n} geometries and {n_rows} rows of attributes")
    columns = [(name, kind, width, _spark_type(kind, head[32 + 32 * i + 17], width)) for i, (name, kind, width) in enumerate(_fields(head))]
    side = lambda ending: _text(store, sibling(target, ending))
    definition, encoding = side(".prj"), side(".cpg")
    encoding = (encoding or "latin-1").strip()
    return {"path": path, "n": n, "columns": columns, "head_bytes": head_bytes, "row_bytes": row_bytes, "encoding": f"cp{encoding}" if encoding.isdigit() else encoding, "srid": srid_of(definition) if definition else 4326}


def _text(store, target: str) -> str | None:
    try:
        with store.open_input_file(target) as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def _signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def _shape(record: memoryview) -> dict | None:
    """A geometry's type and parts; Z and M are left out. None for a null shape."""
    kind = struct.unpack_from("<i", record)[0]
    plain = kind % 10
    if kind == 0 or kind > 28:
        return None
    points = lambda at, n: np.frombuffer(record, "<f8", 2 * n, at).reshape(n, 2)
    line = lambda p: [{"x": x, "y": y} for x, y in p.tolist()]
    if plain == POINT:
        return {"gtype": "Point", "parts": [line(points(4, 1))]}
    if plain == MULTIPOINT:
        return {"gtype": "MultiPoint", "parts": [line(points(40, struct.unpack_from("<i", record, 36)[0]))]}
    n_parts, n_points = struct.unpack_from("<2i", record, 36)
    first = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    every = points(44 + 4 * n_parts, n_points)
    parts = [every[a:b] for a, b in zip(first, first[1:])]
    if plain == POLYGON:  # outer rings run clockwise
        several = sum(_signed_area(p) < 0 for p in parts) > 1
        return {"gtype": "MultiPolygon" if several else "Polygon", "parts": list(map(line, parts))}
    return {"gtype": "LineString" if n_parts == 1 else "MultiLineString", "parts": list(map(line, parts))}


def _value(raw: bytes, kind: str, to: str, encoding: str):
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    if kind in "OB" and len(raw) == 8:
        return struct.unpack("<d", raw)[0]
    text = raw.decode(encoding, "replace").strip(" \0")
    if to == "string":
        return text or None
    if to == "boolean":
        return True if text in ("Y", "y", "T", "t") else False if text in ("N", "n", "F", "f") else None
    try:
        return date(int(text[:4]), int(text[4:6]), int(text[6:8])) if to == "date" else int(text) if to == "long" else float(text)
    except ValueError:  # blanks, or stars for a number that didn't fit
        return None


def _ragged(starts: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """starts[i], starts[i] + step, ... for sizes[i] items, one list after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes) * step, sizes) + np.arange(ends[-1] if len(ends) else 0) * step


def _at(data: np.ndarray, places: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of a kind that begin at some bytes."""
    size = np.dtype(kind).itemsize
    if len(data) < size or not len(places):
        return np.zeros(0, kind)
    return np.ndarray((len(data) - size + 1,), f"V{size}", data, 0, (1,))[places].view(kind)


def _lines(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array | None:
    """The geometries of records that are all polylines or null shapes, at once; None where there are others, or odd ones. at: where
    the records begin."""
    if len(at) and int(size.min()) < 4:
        return None
    kind = _at(data, at, "<i4")
    line = np.isin(kind, (POLYLINE, POLYLINE + 10, POLYLINE + 20))
    if not (line | (kind == 0)).all() or line.any() and int(size[line].min()) < 44:
        return None
    some = at[line]
    n_parts, n_points = (_at(data, some + k, "<i4").astype(np.int64) for k in (36, 40))
    if len(some) and (int(n_parts.min()) < 1 or int(n_points.min()) < 0 or (44 + 4 * n_parts + 16 * n_points > size[line]).any()):
        return None
    first = _at(data, _ragged(some + 44, n_parts, 4), "<i4").astype(np.int64)
    of_part = np.cumsum(n_parts) - n_parts
    ends = np.append(first[1:], 0)
    ends[of_part + n_parts - 1] = n_points
    if first[of_part].any() or (ends < first).any():
        return None
    points = _at(data, _ragged(some + 44 + 4 * n_parts, n_points, 16), "V16").view("<f8").reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    lines = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends - first))), pa.int32()), pairs)
    count = np.zeros(len(at), np.int64)
    count[line] = n_parts
    parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), lines)
    names = pa.array(np.where(count == 1, "LineString", "MultiLineString"), pa.string())
    return pa.StructArray.from_arrays([names, parts], ["gtype", "parts"], mask=pa.array(~line)).cast(GEOMETRY)


_PLAIN = {"long": b"0123456789- ", "double": b"0123456789-.eE ", "string": bytes(range(128))}


def _values(raw: np.ndarray, kind: str, to: str, encoding: str) -> pa.Array:
    """An attribute of some rows, raw (row, byte): at once where its bytes are plain, else value by value."""
    n, width = raw.shape
    raw = np.ascontiguousarray(raw)
    ascii_like = encoding.lower().replace("_", "-") in ("utf-8", "utf8", "latin-1", "iso-8859-1", "iso8859-1", "ascii", "cp1252")
    if to in _PLAIN and kind not in "IOB" and ascii_like and width and n:
        plain = np.zeros(256, bool)
        plain[list(_PLAIN[to])] = True
        if plain[raw].all():
            fixed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(raw)])
            text = pc.utf8_trim(fixed.cast(pa.string()), characters=" \0")
            text = pc.if_else(pc.equal(text, ""), None, text)
            try:
                return text.cast(_ARROW[to])
            except pa.ArrowInvalid:
                pass  # a number among them can't be read
    return pa.array([_value(r.tobytes(), kind, to, encoding) for r in raw], _ARROW[to])


_ARROW = {"boolean": pa.bool_(), "date": pa.date32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _reader(columns: list):
    names = [c for c, *_ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, a, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n"))):
                about = json.loads(file)
                yield from slice_of(about, a, n)

    def slice_of(about: dict, a: int, n: int) -> Iterator[pa.RecordBatch]:
        store, target = store_of(about["path"])
        with store.open_input_file(sibling(target, ".shx")) as f:
            f.seek(HEADER + 8 * a)
            index = np.frombuffer(f.read(8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with store.open_input_file(target) as shapes, store.open_input_file(sibling(target, ".dbf")) as rows:
            for b in range(0, n, 4096):
                some = index[b : b + 4096]
                rows.seek(about["head_bytes"] + (a + b) * about["row_bytes"])
                table = rows.read(len(some) * about["row_bytes"])
                if len(table) < len(some) * about["row_bytes"]:
                    raise ValueError(f"{about['path']}: its attributes are cut short")
                grid = np.frombuffer(table, np.uint8).reshape(len(some), about["row_bytes"])
                kept = grid[:, 0] != ord("*")  # others are deleted
                grid, some = grid[kept], some[kept]
                if not len(some):
                    continue
                low = int(some[:, 0].min())
                high = int((some[:, 0] + 8 + some[:, 1]).max())
                together = high - low <= int((some[:, 1] + 8).sum()) * 2 + 4096  # records stand in order, as a rule
                found = None
                if together:
                    shapes.seek(low)
                    data = memoryview(shapes.read(high - low))
                    if len(data) == high - low:
                        found = _lines(np.frombuffer(data, np.uint8), some[:, 0] - low + 8, some[:, 1])
                if found is None:
                    each = []
                    for at, size in some.tolist():
                        if together:
                            record = data[at - low + 8 : at - low + 8 + size]
                        else:
                            shapes.seek(at + 8)
                            record = memoryview(shapes.read(size))
                        each.append(_shape(record))
                    found = pa.array(each, GEOMETRY)
                place, values = 1, []
                for _, kind, width, to in about["columns"]:
                    values.append(_values(grid[:, place : place + width], kind, to, about["encoding"]))
                    place += width
                yield pa.record_batch([*values, found], [*names, "geometry"])

    return run


def read_table(spark: SparkSession, path: str, srid: int | None = None) -> tuple[DataFrame, int]:
    """The rows of all shapefiles at path (a file, folder or glob) with their geometry, and the EPSG number of their coordinate
    system: srid if given, else what their .prj says, longitude and latitude without one. They must agree in their
    attributes and systems.

    Deleted rows are left out; blank and unreadable values are null, null shapes a null geometry."""
    paths = [r.path for r in listed(spark, path, "*.[sS][hH][pP]").select("path").collect()]
    if not paths:
        raise ValueError(f"no shapefile at {path}")
    found = [describe(p) for p in paths]  # headers only
    if len({(json.dumps([(c[0], c[3]) for c in d["columns"]]), srid or d["srid"]) for d in found}) > 1:
        raise ValueError(f"the shapefiles at {path} differ in their attributes or coordinate systems")
    system = srid or found[0]["srid"]
    if system is None:
        raise ValueError(f"{paths[0]}: the coordinate system in its .prj isn't known; give its EPSG number")
    columns = found[0]["columns"]
    files = spark.createDataFrame([(json.dumps(d), d["n"]) for d in found], "file string, n long").filter("n > 0")
    starts = files.select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))).alias("first"))
    slices = starts.select("file", "first", F.least(F.col("n") - F.col("first"), F.lit(SLICE).cast("long")).alias("n"))
    tasks = max(1, sum(-(-d["n"] // SLICE) for d in found))
    schema = ", ".join([*(f"`{name}` {to}" for name, _, _, to in columns), f"geometry {_GEOMETRY}"])
    return slices.repartition(tasks).mapInArrow(_reader(columns), schema), system


def read_shapefile(spark: SparkSession, path: str, class_col: str | None = "highway", srid: int | None = None, rename: Mapping[str, str] | None = None, keep_non_lines: bool = False) -> EdgeTable:
    """See read_table. The shapefiles' own coordinate system counts unless srid is given."""
    df, system = read_table(spark, path, srid)
    return normalise(df, class_col, "geometry", system, rename, keep_non_lines)


# -- writing --------------------------------------------------------------------------------------------------------

#: Attribute type, width and decimals for a column's type.
_WRITTEN = {"bigint": ("N", 18, 0), "int": ("N", 11, 0), "double": ("F", 24, 15), "string": ("C", 254, 0), "boolean": ("L", 1, 0), "date": ("D", 8, 0)}
FILE_ROWS = 200_000
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def _records(geometry: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records of lines one after another, as 32-bit words; the words of each, without its head; and the boxes of those with points."""
    valid = geometry.is_valid().to_numpy(zero_copy_only=False)
    parts = geometry.filter(geometry.is_valid()).field("parts")
    n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = parts.flatten()
    n_line = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = lines.flatten()
    points = np.stack([pairs.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1).astype("<f8")
    before = np.concatenate(([0], np.cumsum(n_line)))  # points before a part
    of_part = np.cumsum(n_parts) - n_parts
    start = before[of_part]
    n_points = before[of_part + n_parts] - start
    sizes = np.ones(len(geometry), np.int64)
    sizes[valid] = 11 + n_parts + 4 * n_points
    at = np.cumsum(sizes + 2) - sizes  # where each begins, after its head of two words
    words = np.zeros(int((sizes + 2).sum()), np.int32)
    words[at - 2] = np.arange(1, len(at) + 1).astype(">i4").view("<i4")
    words[at - 1] = (2 * sizes).astype(">i4").view("<i4")
    line = at[valid]
    words[line], words[line + 9], words[line + 10] = POLYLINE, n_parts, n_points
    words[_ragged(line + 11, n_parts, 1)] = before[:-1] - np.repeat(start, n_parts)
    words[_ragged(line + 11 + n_parts, 4 * n_points, 1)] = points.view("<i4").ravel()
    full = n_points > 0
    boxes = np.zeros((int(full.sum()), 4), "<f8")
    if len(boxes):
        boxes[:, :2], boxes[:, 2:] = np.minimum.reduceat(points, start[full]), np.maximum.reduceat(points, start[full])
        words[_ragged(line[full] + 1, np.full(len(boxes), 8), 1)] = boxes.view("<i4").ravel()
    return words, sizes, boxes


def _column(values: pa.Array, kind: str, width: int, name: str) -> np.ndarray:
    """A column's attributes, (row, byte)."""
    if kind == "L":
        texts = pc.if_else(values, "T", "F")
    elif kind == "C":
        texts = values
    elif kind == "N":
        texts = values.cast(pa.string())
    else:
        texts = pa.array([None if v is None else v.strftime("%Y%m%d") if kind == "D" else repr(v) for v in values.to_pylist()], pa.string())
    data = pc.fill_null(texts, "").cast(pa.binary())
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and int(sizes.max()) > width:
        raise ValueError(f"{name}: {values[int(np.argmax(sizes > width))].as_py()!r} takes more than {width} bytes")
    out = np.full((len(values), width), ord(" "), np.uint8)
    flat = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    out.ravel()[_ragged(np.arange(len(values)) * width + (width - sizes if kind in "NF" else 0), sizes, 1)] = flat
    return out


def _writer(folder: str, columns: list[tuple[str, str, int, int]]):
    def save(store, base: str, rows: pa.Table) -> str:
        name = uuid.uuid4().hex
        *attributes, geometry = (c.combine_chunks() for c in rows.columns)
        words, sizes, boxes = _records(geometry)
        box = (*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)) if len(boxes) else (0.0,) * 4
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, POLYLINE, *box, 0, 0, 0, 0)
        starts = HEADER + 4 * (np.cumsum(sizes + 2) - sizes - 2)
        index = np.stack([starts // 2, 2 * sizes], axis=1).astype(">i4").tobytes()
        fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in columns)
        table = np.concatenate([np.full((len(sizes), 1), ord(" "), np.uint8), *(_column(v, k, w, n) for v, (n, k, w, _) in zip(attributes, columns))], axis=1).tobytes()
        about = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(sizes), 33 + len(fields), 1 + sum(c[2] for c in columns)) + fields + b"\r"
        files = {".shx": head(HEADER + len(index)) + index, ".dbf": about + table + b"\x1a", ".prj": WGS84.encode(), ".cpg": b"UTF-8", ".shp": head(HEADER + words.nbytes) + words.tobytes()}
        for ending, data in files.items():  # the .shp last: without it nothing is read
            with store.open_output_stream(posixpath.join(base, name + ending), compression=None) as f:
                f.write(data)
        return name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= FILE_ROWS:
                rows = pa.Table.from_batches(held)
                yield pa.record_batch([pa.array([save(store, base, rows.slice(0, FILE_ROWS))])], ["name"])
                held, n = rows.slice(FILE_ROWS).to_batches(), n - FILE_ROWS
        if n:
            yield pa.record_batch([pa.array([save(store, base, pa.Table.from_batches(held))])], ["name"])

    return run


def write_shapefiles(df: DataFrame, folder: str) -> list[str]:
    """Writes lines, in longitude and latitude, as shapefiles in folder, one for each task and FILE_ROWS rows. Their names; files
    of other names are those of attempts that failed, and are removed.

    df: geometry and attributes of the types in _WRITTEN, with names of at most ten bytes. Text of more than 254 bytes
    doesn't fit the format and is an error; null and empty text are both blank."""
    names = [c for c in df.columns if c not in ("geometry", "vertices")]
    bad = [c for c in names if len(c.encode()) > 10 or df.schema[c].dataType.simpleString() not in _WRITTEN]
    if bad:
        raise ValueError(f"columns that shapefiles can't hold: {bad}")
    columns = [(c, *_WRITTEN[df.schema[c].dataType.simpleString()]) for c in names]
    done = {r.name for r in cut(df.select(*names, "geometry").mapInArrow(_writer(folder, columns), "name string")).collect()}  # a row for each file
    store, base = store_of(folder)
    there = store.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
    for file in there:
        if file.base_name.partition(".")[0] not in done:
            store.delete_file(file.path)
    return sorted(done)
