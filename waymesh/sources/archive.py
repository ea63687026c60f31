"""Tile archives: all tiles of a network in one PMTiles file (version 3), written and read by many tasks.

Tiles are range-partitioned by their number along the Hilbert curve, and each task writes its share to a segment of its
own, with a run for neighbouring tiles that are equal and one copy of others that are. What a segment begins at in the
archive is a running sum over segments. Leaf directories are made by tasks from a share of the entries each. The file itself has to be
written in order: one task copies leaves and segments into it, a buffer at a time. Only the root directory, one entry
for each leaf, passes through the driver.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions import geometry as G
from waymesh.operators.tiles import _read_varints, _varints, tile_bounds
from waymesh.session import cut, shared_dir
from waymesh.sources.files import store_of

#: Fixed values of the format: its header (127 bytes) and the codes for gzip and vector tiles.
HEADER = struct.Struct("<7sB11Q6B4iB2i")
MAGIC, VERSION, GZIP, VECTOR = b"PMTiles", 3, 2, 1
ROOT_BYTES = 16_384 - HEADER.size  # header and root directory together
LEAF = 4096  # entries of a leaf directory, at least
LEAVES = 1500  # leaf directories, at most; so many entries always fit into the root
COPY = 8 << 20
KNOWN = 1 << 16  # digests of tiles that a task remembers


# -- tile numbers ---------------------------------------------------------------------------------------------------


def _numbers(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tiles of all lower zooms come first, then those of a zoom in the order of the Hilbert curve."""
    z, x, y = (np.asarray(a, np.int64) for a in (z, x, y))
    number = ((np.int64(1) << 2 * z) - 1) // 3
    x, y = x.copy(), y.copy()
    for bit in range(int(z.max(initial=0)) - 1, -1, -1):
        deep = bit < z
        side = np.int64(1) << bit
        right, low = (x & side) > 0, (y & side) > 0
        number += np.where(deep, np.where(right, 3 - low, low * 1) << 2 * bit, 0)
        nx, ny = x & side - 1, y & side - 1
        flip = ~low & right
        nx, ny = np.where(flip, side - 1 - nx, nx), np.where(flip, side - 1 - ny, ny)
        turn = deep & ~low
        x, y = np.where(turn, ny, np.where(deep, nx, x)), np.where(turn, nx, np.where(deep, ny, y))
    return number


def _places(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, x, y) of tile numbers."""
    number = np.asarray(number, np.int64)
    first = ((np.int64(1) << 2 * np.arange(31, dtype=np.int64)) - 1) // 3
    z = np.searchsorted(first, number, "right") - 1
    rest = number - first[z]
    x = y = np.zeros(len(number), np.int64)
    for bit in range(int(z.max(initial=0))):
        deep, side = bit < z, np.int64(1) << bit
        quarter = rest >> 2 * bit & 3
        right = quarter >= 2
        low = (quarter == 1) | (quarter == 2)
        nx, ny = np.where(low, x, y), np.where(low, y, x)
        flip = ~low & right
        nx, ny = np.where(flip, side - 1 - nx, nx), np.where(flip, side - 1 - ny, ny)
        x, y = np.where(deep, nx + side * right, x), np.where(deep, ny + side * low, y)
    return z, x, y


@F.pandas_udf(T.LongType())
def tile_number(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """A tile's number in an archive."""
    return pd.Series(_numbers(z.to_numpy(), x.to_numpy(), y.to_numpy()))


# -- directories ----------------------------------------------------------------------------------------------------


def write_directory(numbers: Sequence[int], runs: Sequence[int], sizes: Sequence[int], offsets: Sequence[int]) -> bytes:
    """A directory: entries in order of tile number. A run of 0 points to a leaf directory."""
    numbers, sizes, offsets = (np.asarray(a, np.int64) for a in (numbers, sizes, offsets))
    follows = np.zeros(len(numbers), bool)
    follows[1:] = offsets[1:] == offsets[:-1] + sizes[:-1]
    columns = (np.diff(numbers, prepend=0), np.asarray(runs), sizes, np.where(follows, 0, offsets + 1))
    return gzip.compress(_varints(np.array([len(numbers)])) + b"".join(map(_varints, columns)), 6, mtime=0)


def read_directory(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, runs, sizes, offsets)."""
    values = _read_varints(gzip.decompress(data))
    n = int(values[0])
    if len(values) != 4 * n + 1:
        raise ValueError("a directory of the archive is damaged")
    gaps, runs, sizes, marks = values[1:].reshape(4, n)
    # A mark of 0: right after the entry before. Sums of sizes since the last entry with an offset of its own give the rest.
    ends = np.cumsum(sizes)
    own = np.maximum.accumulate(np.where(marks > 0, np.arange(n), 0))
    offsets = marks[own] - 1 + (ends - sizes) - (ends - sizes)[own] if n else marks
    return np.cumsum(gaps), runs, sizes, offsets


# -- writing --------------------------------------------------------------------------------------------------------


def _segment_writer(folder: str):
    """Of tiles in order: entries (number, run, place within the segment, size), and the tiles themselves in a file."""
    names = ["part", "segment", "n", "number", "run", "start", "size", "fresh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        part, segment = TaskContext.get().partitionId(), uuid.uuid4().hex
        known: dict[bytes, tuple[int, int]] = {}
        rows: list[list] = []
        at = n = 0

        def batch_of(some: list[list]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 5, pa.bool_())
            return pa.record_batch([pa.array([part] * len(some), kinds[0]), pa.array([segment] * len(some)), *(pa.array(c, k) for c, k in zip(zip(*some), kinds[2:]))], names)

        with store.open_output_stream(posixpath.join(base, segment), compression=None) as out:
            for batch in batches:
                for a in range(0, batch.num_rows, 64):
                    for number, tile in zip(batch.column("number").slice(a, 64).to_pylist(), batch.column("tile").slice(a, 64).to_pylist()):
                        digest = hashlib.sha256(tile).digest()
                        held = known.get(digest)
                        if held and rows and rows[-1][3] == held[0] and rows[-1][1] + rows[-1][2] == number:
                            rows[-1][2] += 1
                            continue
                        if len(rows) >= 8192:
                            yield batch_of(rows)
                            rows = []
                        if not held:
                            if len(known) >= KNOWN:
                                known.clear()
                            out.write(tile)
                            known[digest] = (at, len(tile))
                        start, size = known[digest]
                        rows.append([n, number, 1, start, size, not held])
                        n += 1
                        at += 0 if held else size
        if rows:
            yield batch_of(rows)

    return run


def _leaf_of(table: pa.Table) -> pa.Table:
    table = table.sort_by("number")
    columns = [table.column(c).to_numpy() for c in ("number", "run", "size", "offset")]
    data = write_directory(*columns)
    return pa.table({"leaf": table.column("leaf").slice(0, 1), "number": pa.array(columns[0][:1]), "data": pa.array([data], pa.binary()), "n_bytes": pa.array([len(data)], pa.int64())})


def _assembler(path: str, folder: str, head: bytes):
    """Writes head, then the leaves and segments that come as rows, in order. The name of what it wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, target), (parts, base) = store_of(path), store_of(folder)
        name = f"{target}.{uuid.uuid4().hex}"
        size = len(head)
        with store.open_output_stream(name, compression=None) as out:
            out.write(head)
            for batch in batches:
                for data, segment in zip(batch.column("data").to_pylist(), batch.column("segment").to_pylist()):
                    if data is not None:
                        out.write(data)
                        size += len(data)
                        continue
                    with parts.open_input_stream(posixpath.join(base, segment), compression=None) as f:
                        while more := f.read(COPY):
                            out.write(more)
                            size += len(more)
        yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64())], ["name", "n_bytes"])

    return run


def write_archive(tiles: DataFrame, path: str, bounds: tuple[float, float, float, float] | None = None, layers: Sequence[str] = ("roads",), metadata: Mapping | None = None) -> dict:
    """tiles (z, x, y, tile: gzipped vector tiles, one row each) as one PMTiles file at path, which is replaced. What its header
    says.

    bounds: (west, south, east, north) of the data; by default the box of the tiles of the greatest zoom. Rows without a
    tile are left out; two rows for one tile are an error, as are no rows at all.
    """
    spark = tiles.sparkSession
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    # Written once, as a range partitioning reads its input twice.
    numbered = cut(tiles.filter("tile is not null").select("z", "x", "y", tile_number("z", "x", "y").alias("number"), "tile"))
    about = numbered.agg(F.min("z"), F.max("z"), F.count("*"), F.count_distinct("number")).first()
    low, high, n_tiles, n_different = about
    if not n_tiles:
        raise ValueError("no tiles to write")
    if n_tiles != n_different:
        raise ValueError(f"{n_tiles} rows for {n_different} tiles")
    if bounds is None:
        bounds = _box(numbered.filter(F.col("z") == high))

    schema = "part int, segment string, n long, number long, run long, start long, size long, fresh boolean"
    entries = cut(numbered.select("number", "tile").repartitionByRange("number").sortWithinPartitions("number").mapInArrow(_segment_writer(folder), schema))
    per_part = entries.groupBy("part", "segment").agg(F.count("*").alias("entries"), F.max(F.col("start") + F.col("size")).alias("bytes"), F.count_if("fresh").alias("contents"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    segments = cut(per_part.select("part", "segment", "entries", "bytes", "contents", F.coalesce(F.sum("entries").over(before), F.lit(0)).alias("entries_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before")))
    n_entries, n_bytes, n_contents = segments.agg(F.sum("entries"), F.sum("bytes"), F.sum("contents")).first()

    size = max(LEAF, -(-n_entries // LEAVES))
    places = segments.select(F.col("part").alias("p"), "entries_before", "bytes_before")
    placed = entries.join(F.broadcast(places), F.col("part") == F.col("p")).select(
        F.floor((F.col("n") + F.col("entries_before")) / size).alias("leaf"), "number", "run", "size", (F.col("start") + F.col("bytes_before")).alias("offset")
    )
    leaves = cut(placed.groupBy("leaf").applyInArrow(_leaf_of, "leaf long, number long, data binary, n_bytes long"))
    listing = leaves.select("leaf", "number", "n_bytes").orderBy("leaf").collect()  # at most LEAVES
    if len(listing) == 1 and listing[0].n_bytes <= ROOT_BYTES:
        root, leaf_bytes = bytes(leaves.first().data), 0
    else:
        sizes = [r.n_bytes for r in listing]
        leaf_bytes = sum(sizes)
        root = write_directory([r.number for r in listing], [0] * len(listing), sizes, (np.cumsum(sizes) - sizes).tolist())
    about = gzip.compress(json.dumps({"vector_layers": [{"id": name, "fields": {}} for name in layers], **(metadata or {})}, separators=(",", ":")).encode(), 6, mtime=0)
    at_meta = HEADER.size + len(root)
    at_leaves = at_meta + len(about)
    e7 = [int(v * 1e7) for v in bounds]
    header = HEADER.pack(
        *(MAGIC, VERSION, HEADER.size, len(root), at_meta, len(about), at_leaves, leaf_bytes, at_leaves + leaf_bytes, n_bytes, n_tiles, n_entries, n_contents),
        *(1, GZIP, GZIP, VECTOR, low, high, *e7, (low + high) // 2, (e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2),
    )
    pieces = segments.select(F.lit(1).alias("kind"), F.col("part").cast("long").alias("at"), F.lit(None).cast("binary").alias("data"), "segment")
    if leaf_bytes:
        pieces = pieces.unionByName(leaves.select(F.lit(0).alias("kind"), F.col("leaf").alias("at"), "data", F.lit(None).cast("string").alias("segment")))
    ordered = pieces.repartition(1).sortWithinPartitions("kind", "at").select("data", "segment")
    done = cut(ordered.mapInArrow(_assembler(path, folder, header + root + about), "name string, n_bytes long")).first()
    store, target = store_of(path)
    store.move(done.name, target)
    parts, base = store_of(folder)
    parts.delete_dir(base)
    return read_header(header)


def _box(tiles: DataFrame) -> tuple[float, float, float, float]:
    t = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    row = tiles.select(t.alias("t")).agg(F.min("t.minx").alias("a"), F.min("t.miny").alias("b"), F.max("t.maxx").alias("c"), F.max("t.maxy").alias("d"))
    return tuple(row.select(G.lon_of(F.col("a")), G.lat_of(F.col("b")), G.lon_of(F.col("c")), G.lat_of(F.col("d"))).first())


def round_trip(tiles: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What use makes of tiles that are read from an archive, which is written to the shared folder and removed afterwards."""
    path = f"{shared_dir(tiles.sparkSession)}/archive-{uuid.uuid4().hex}.pmtiles"
    write_archive(tiles, path)
    found = cut(use(read_archive(tiles.sparkSession, path)))
    store, target = store_of(path)
    store.delete_file(target)
    return found


# -- reading --------------------------------------------------------------------------------------------------------

_FIELDS = (
    "magic version root_at root_bytes metadata_at metadata_bytes leaves_at leaves_bytes tiles_at tiles_bytes n_tiles n_entries n_contents "
    "clustered directories_packed tiles_packed kind min_zoom max_zoom west south east north center_zoom center_lon center_lat"
).split()


def read_header(data: bytes) -> dict:
    """What an archive's first 127 bytes say; degrees as they are."""
    found = dict(zip(_FIELDS, HEADER.unpack(data[: HEADER.size])))
    if found.pop("magic") != MAGIC or found["version"] != VERSION:
        raise ValueError("not a PMTiles archive of version 3")
    return found | {k: found[k] / 1e7 for k in ("west", "south", "east", "north", "center_lon", "center_lat")}


def read_metadata(path: str) -> tuple[dict, dict]:
    """(header, metadata) of an archive."""
    store, target = store_of(path)
    with store.open_input_file(target) as f:
        header = read_header(f.read(HEADER.size))
        f.seek(header["metadata_at"])
        return header, json.loads(gzip.decompress(f.read(header["metadata_bytes"])))


def _tile_reader(path: str, tiles_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = store_of(path)
        with store.open_input_file(target) as f:
            for batch in batches:
                for at, n_bytes in zip(batch.column("at").to_pylist(), batch.column("n_bytes").to_pylist()):
                    f.seek(at)
                    numbers, runs, sizes, offsets = read_directory(f.read(n_bytes))
                    a = 0
                    while a < len(numbers):
                        b = a + 1  # entries that are read at once: next to each other, and not too many bytes
                        while b < len(numbers) and 0 <= offsets[b] - offsets[a] and offsets[b] + sizes[b] - offsets[a] <= COPY and b - a < 8192:
                            b += 1
                        f.seek(tiles_at + int(offsets[a]))
                        data = f.read(int((offsets[a:b] + sizes[a:b]).max() - offsets[a]))
                        rows = [(int(numbers[i]) + k, data[o : o + int(sizes[i])]) for i in range(a, b) for o in [int(offsets[i] - offsets[a])] for k in range(int(runs[i]))]
                        z, x, y = _places(np.array([n for n, _ in rows]))
                        yield pa.record_batch([pa.array(z.astype(np.int32)), pa.array(x), pa.array(y), pa.array([t for _, t in rows], pa.binary())], ["z", "x", "y", "tile"])
                        a = b

    return run


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, tile) of a PMTiles file. The driver reads the root directory; each leaf, and the tiles that it lists, is read by a
    task."""
    store, target = store_of(path)
    with store.open_input_file(target) as f:
        header = read_header(f.read(HEADER.size))
        f.seek(header["root_at"])
        _, runs, sizes, offsets = read_directory(f.read(header["root_bytes"]))
    if len(runs) and runs.max() > 0 and runs.min() == 0:
        raise ValueError("a root directory of both tiles and leaves is not read here")
    whole = [(header["root_at"], header["root_bytes"])]
    leaves = [(header["leaves_at"] + int(o), int(s)) for o, s in zip(offsets, sizes)] if len(runs) and runs.max() == 0 else whole
    rows = spark.createDataFrame(leaves, "at long, n_bytes long").repartition(len(leaves))
    return rows.mapInArrow(_tile_reader(path, header["tiles_at"]), "z int, x long, y long, tile binary")
