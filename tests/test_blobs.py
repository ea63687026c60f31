"""Packed features and sidecars: what is unpacked is what was there, the same bytes each time."""

import base64
import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.operators import tiles
from waymesh.sources import blobs
from waymesh.sources.sinks import to_geojson

SHAPE = "struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>"


def network(spark, n=2500):
    rows = [(i, "primary" if i % 3 else None, f'"{i}" é', (1 << 53) + i if i % 2 else i, None if i == 7 else ("LineString", [[{"x": i / 7, "y": 1.0}, {"x": 2.0, "y": i / 9}]])) for i in range(n)]
    return spark.createDataFrame(rows, f"fid long, highway string, name string, big long, geometry {SHAPE}").repartition(4)


def test_features(spark):
    df = network(spark)
    got = {r.chunk: r for r in blobs.packed_features(df, "roads", chunk=1000, min_bytes=130_000).collect()}
    assert sorted(got) == [0, 1, 2] and [got[c].packed for c in (0, 1, 2)] == [True, True, False]
    assert [(got[c].source, got[c].first, got[c].n_features) for c in (0, 1, 2)] == [("roads", 0, 1000), ("roads", 1000, 1000), ("roads", 2000, 500)]
    texts = [gzip.decompress(base64.b64decode(got[c].data)).decode() if got[c].packed else got[c].data for c in (0, 1, 2)]
    assert [len(t.encode()) for t in texts] == [got[c].n_bytes for c in (0, 1, 2)]
    assert sum((json.loads(t)["features"] for t in texts), []) == to_geojson(df)["features"]
    assert len(got[0].data) < got[0].n_bytes / 4
    again = {r.chunk: r.data for r in blobs.packed_features(df.repartition(7), "roads", chunk=1000, min_bytes=130_000).collect()}
    assert again == {c: r.data for c, r in got.items()}


def test_results_leave_by_few_megabytes(spark):
    """A batch of small blobs holds a lot of text."""
    texts = pa.array([*(str(i) * 400_000 for i in range(40)), None, "é"])
    packed = pa.concat_arrays(blobs._pack.func(iter([texts])))
    assert packed.nbytes < 1 << 20
    out = list(blobs._unpack.func(iter([packed])))
    assert max(a.nbytes for a in out) < 6 << 20 and pa.concat_arrays(out).equals(texts)
    rows = spark.range(64, numPartitions=1).select("id", F.repeat(F.col("id").cast("string"), 200_000).alias("t"))
    assert rows.filter(blobs.unpack(blobs.pack(F.col("t"))).eqNullSafe(F.col("t"))).count() == 64


def test_few_rows_and_no_ids(spark):
    df = network(spark, 3)
    row = blobs.packed_features(df, "x").first()
    assert not row.packed and json.loads(row.data)["type"] == "FeatureCollection"
    assert blobs.packed_features(df.limit(0), "x").collect() == []
    with pytest.raises(Exception, match="without fid"):
        blobs.packed_features(df.withColumn("fid", F.lit(None).cast("long")), "x").collect()
    texts = spark.createDataFrame([(0, "é" * 1000), (1, ""), (2, None)], "id int, t string")
    assert texts.filter(~blobs.unpack(blobs.pack(F.col("t"))).eqNullSafe(F.col("t"))).count() == 0


def test_sidecar(spark):
    side = tiles.sidecar(network(spark, 30))
    rows = blobs.packed_sidecar(side, chunk=20).orderBy("chunk").collect()
    assert [(r.chunk, r.first, r.n_rows) for r in rows] == [(0, 0, 20), (1, 20, 10)]
    parts = [json.loads(gzip.decompress(base64.b64decode(r.data))) for r in rows]
    whole = {k: sum((p[k] for p in parts), []) for k in ("props", "mids", "bboxes")}
    assert len(whole["props"]) == 30 and whole["props"][4]["name"] == '"4" é'
    assert whole["mids"][7] is None and whole["bboxes"][7] is None
    assert whole["mids"][9] == [2.0, 1.0] and whole["bboxes"][9] == [9 / 7, 1.0, 2.0, 1.0]
