"""Features for a page: chunks of GeoJSON, gzipped and in base64 where that is worth a step more to read them.

The same rows give the same bytes: features stand in id order and the compressed data carry no time. A chunk has a bounded number of
features, so a table of any size is packed by many tasks, and a page can load what it shows.
"""

from __future__ import annotations

import base64
import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.sources.sinks import feature_text

MIN_BYTES = 262_144  # of a chunk that is packed; smaller ones stay as they are
CHUNK = 10_000  # ids in a chunk
HELD = 4 << 20  # bytes of results that a task's Python holds at once


def _each(work: Callable[[pa.Buffer], bytes], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """work on each row's bytes. Rows are chunks of megabytes, and text is many times its blob: results leave by HELD bytes, however
    many rows a batch has."""
    for batch in batches:
        held: list[bytes | None] = []
        size = 0
        for row in batch:
            held.append(work(row.as_buffer()) if row.is_valid else None)
            size += len(held[-1] or b"")
            if size >= HELD:
                yield pa.array(held, pa.string())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.string())


@F.arrow_udf(T.StringType())
def _pack(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _each(lambda t: base64.b64encode(gzip.compress(t, 6, mtime=0)), texts)


@F.arrow_udf(T.StringType())
def _unpack(blobs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _each(lambda b: gzip.decompress(base64.b64decode(b)), blobs)


def pack(text: Column) -> Column:
    """Text as gzip in base64; null stays null."""
    return _pack(text)


def unpack(blob: Column) -> Column:
    return _unpack(blob)


def packed_features(df: DataFrame, source: str, chunk: int = CHUNK, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(source, chunk, first, n_features, n_bytes, packed, data): the FeatureCollections of df's rows, by fid, chunk ids each. n_bytes are
    those of the text, before it is packed; data is that text where packed is false.

    Ids should be dense, as with_ids deals them: gaps give smaller chunks, copies of an id larger ones. Rows without an id are an
    error, rows without a geometry have a null one."""
    fid = F.when(df["fid"].isNull(), F.raise_error(F.lit("rows without fid can't be packed"))).otherwise(df["fid"]).cast("long")
    features = df.select(fid.alias("fid"), feature_text(df).alias("value"))
    by_chunk = features.groupBy(F.floor(F.col("fid") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("fid", "value"))).alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda f: f["value"]), ","), F.lit("]}"))
    whole = by_chunk.select("chunk", F.get("f", F.lit(0))["fid"].alias("first"), F.size("f").cast("long").alias("n_features"), text.alias("text"))
    sized = whole.withColumns({"n_bytes": F.octet_length("text").cast("long"), "packed": F.octet_length("text") >= min_bytes})
    names = ["source", "chunk", "first", "n_features", "n_bytes", "packed", "data"]
    # Two branches: a Python function in a CASE would run for all rows.
    small, large = (sized.filter(c).withColumns({"source": F.lit(source), "data": data}).select(names) for c, data in ((~F.col("packed"), F.col("text")), (F.col("packed"), pack(F.col("text")))))
    return small.unionByName(large)


def packed_sidecar(side: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chunk, first, n_rows, n_bytes, data): the rows of tiles.sidecar as JSON with props, mids and bboxes, three lists side by side in
    the order of fid, packed."""
    point = lambda p: F.when(p.isNull(), "null").otherwise(F.concat(F.lit("["), F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")), F.lit("]")))
    box = lambda b: F.when(b.isNull(), "null").otherwise(F.concat(F.lit("["), F.concat_ws(",", *[b[c].cast("string") for c in ("minx", "miny", "maxx", "maxy")]), F.lit("]")))
    rows = F.struct("fid", "props", point(F.col("mid")).alias("mid"), box(F.col("bbox")).alias("bbox"))
    by_chunk = side.groupBy(F.floor(F.col("fid") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(rows)).alias("f"))
    joined = lambda name: F.array_join(F.transform("f", lambda f: f[name]), ",")
    text = F.concat(F.lit('{"props":['), joined("props"), F.lit('],"mids":['), joined("mid"), F.lit('],"bboxes":['), joined("bbox"), F.lit("]}"))
    whole = by_chunk.select("chunk", F.get("f", F.lit(0))["fid"].alias("first"), F.size("f").cast("long").alias("n_rows"), text.alias("text"))
    return whole.select("chunk", "first", "n_rows", F.octet_length("text").cast("long").alias("n_bytes"), pack(F.col("text")).alias("data"))
