"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.session import cut, shared_dir

__all__ = ["column", "cut", "documents", "fresh_path", "id_type", "read", "remove_folder", "same_doc", "shared_dir", "with_text_hash"]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, wherever Spark can reach it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def column(df: DataFrame, name: str, dtype: str) -> Column:
    """The column as dtype. A missing column counts as all null."""
    return df[name].cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty), under the names doc_id and text, so that further columns can't clash."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(column(df, text_col, "string"), F.lit("")).alias("text"))


def with_text_hash(docs: DataFrame) -> DataFrame:
    """Adds th. Rows that agree on (doc_id, th) are the same document, so joins on the pair keep each repeated row once."""
    return docs.withColumn("th", F.xxhash64("text"))


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left.doc_id.eqNullSafe(right.doc_id) & (left.th == right.th)


def id_type(df: DataFrame, id_col: str = "doc_id") -> T.DataType:
    return df.schema[id_col].dataType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
