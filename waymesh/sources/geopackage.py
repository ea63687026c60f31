"""GeoPackage files: SQLite databases with geometry in a headed WKB.

A file that tasks can open by its path is cut into ranges of row ids, of SLICE rows where ids are dense, and each task
looks its ranges up in the file's own index. SQLite can't open a file in an object store: there each file is read by one
task, from its bytes in memory (at most the 2 GB that Spark's binary source allows); many files make many tasks.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Mapping
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.sources.files import store_of
from waymesh.sources.ingest import EdgeTable, normalise

BATCH = 10_000
SLICE = 100_000  # row ids that a task looks up at once
_ENVELOPE = (0, 32, 48, 48, 64)


def strip_header(blob: bytes | None) -> bytes | None:
    """The WKB of a GeoPackage geometry; null for other bytes and for empty geometries."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return blob[8 + _ENVELOPE[blob[3] >> 1 & 7] :]


def _open(source: bytes | str) -> sqlite3.Connection:
    """A file's bytes, or its path; a file is only read."""
    if isinstance(source, str):
        return sqlite3.connect(f"file:{quote(source)}?mode=ro&immutable=1", uri=True)
    con = sqlite3.connect(":memory:")
    con.deserialize(source)
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> str:
    d = declared.upper()
    if "BOOL" in d:
        return "boolean"
    if "INT" in d:
        return "long"
    if any(x in d for x in ("REAL", "DOUBLE", "FLOAT")):
        return "double"
    return "binary" if "BLOB" in d else "string"


def describe(source: bytes | str, layer: str | None) -> dict:
    """The layer (by default the first), its geometry column, its coordinate system, its columns, and its least and greatest row
    id (null for a view, which has none)."""
    con = _open(source)
    found = con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    pick = [f for f in found if layer in (None, f[0])]
    if not pick:
        raise ValueError(f"no layer {layer!r}; there are {[f[0] for f in found]}")
    table, geometry, srs = pick[0]
    columns = [(r[1], "binary" if r[1] == geometry else _spark_type(r[2])) for r in con.execute(f"PRAGMA table_info({_quoted(table)})")]
    try:
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
    except sqlite3.OperationalError:
        low = high = None
    con.close()
    return {"layer": table, "geometry": geometry, "srid": srs, "columns": columns, "low": low, "high": high}


def _rows(layer: dict):
    """Of files (path or content), or of the row ids from low on and below high in them."""
    names = [c for c, _ in layer["columns"]]
    where = names.index(layer["geometry"])
    flags = [i for i, (_, t) in enumerate(layer["columns"]) if t == "boolean"]
    everything = f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(layer['layer'])}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, low, high in zip(frame["source"], frame["low"], frame["high"]):
                con = _open(source if isinstance(source, str) else bytes(source))
                cursor = con.execute(everything) if pd.isna(low) else con.execute(f"{everything} WHERE rowid >= ? AND rowid < ?", (int(low), int(high)))
                while rows := cursor.fetchmany(BATCH):
                    out = []
                    for row in rows:
                        row = list(row)
                        row[where] = strip_header(row[where])
                        for i in flags:
                            row[i] = None if row[i] is None else bool(row[i])
                        out.append(row)
                    yield pd.DataFrame(out, columns=names, dtype=object)
                con.close()

    return run


def _describer(layer: str | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"source": [None if isinstance(s, bytes | bytearray) else s for s in frame["source"]], "layer": [json.dumps(describe(s if isinstance(s, str) else bytes(s), layer)) for s in frame["source"]]})

    return run


def read_table(spark: SparkSession, path: str, layer: str | None = None) -> tuple[DataFrame, dict]:
    """The rows of a layer of all files at path, which must agree in its columns and coordinate system, and its description."""
    files = spark.read.format("binaryFile").load(path)
    paths = [r.path for r in files.select("path").orderBy("path").collect()]
    none = F.lit(None).cast("long")
    if not all(isinstance(store_of(p)[0], pyarrow.fs.LocalFileSystem) for p in paths):
        contents = files.select(F.col("content").alias("source"))
        found = json.loads(contents.limit(1).mapInPandas(_describer(layer), "source string, layer string").first().layer)
        sources = contents.select("source", none.alias("low"), none.alias("high"))
    else:
        opened = spark.createDataFrame([(store_of(p)[1],) for p in paths], "source string").repartition(len(paths))
        each = [(r.source, json.loads(r.layer)) for r in opened.mapInPandas(_describer(layer), "source string, layer string").collect()]  # a row for each file
        found = each[0][1]
        if any((d["columns"], d["srid"], d["geometry"]) != (found["columns"], found["srid"], found["geometry"]) for _, d in each):
            raise ValueError(f"the files at {path} differ in their columns or coordinate systems")
        ends = spark.createDataFrame([(s, d["low"], d["high"]) for s, d in each], "source string, least long, most long")
        starts = F.when(F.col("least").isNull(), F.array(none)).otherwise(F.sequence("least", "most", F.lit(SLICE).cast("long")))
        ranges = ends.select("source", F.explode(starts).alias("low")).withColumn("high", F.col("low") + SLICE)
        sources = ranges.repartition(max(1, sum(1 if d["low"] is None else (d["high"] - d["low"]) // SLICE + 1 for _, d in each)))
    schema = ", ".join(f"`{c}` {t}" for c, t in found["columns"])
    return sources.mapInPandas(_rows(found), schema), found


def read_geopackage(spark: SparkSession, path: str, class_col: str = "highway", layer: str | None = None, srid: int | None = None, rename: Mapping[str, str] | None = None) -> EdgeTable:
    """The layer's own coordinate system counts unless srid is given."""
    df, found = read_table(spark, path, layer)
    return normalise(df, class_col, found["geometry"], srid or found["srid"], rename)
