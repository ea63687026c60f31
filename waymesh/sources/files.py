"""Files that tasks open themselves, to read a range of one or to write one as it comes."""

from __future__ import annotations

import posixpath

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of the files at path, a file, folder or glob, that match pattern. Their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length").orderBy("path")


def sibling(path: str, ending: str) -> str:
    """The path with another ending."""
    return posixpath.splitext(path)[0] + ending


def remove(folder: str) -> None:
    """Deletes a folder of intermediate files."""
    store, path = store_of(folder)
    store.delete_dir(path)
