"""What operators need of a session."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode;
    on a cluster it is an error, as executors would not see each other's files."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf is None and sc.getCheckpointDir() is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="waymesh-checkpoint-"))
    return (conf or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


PARTITION_ROWS = 250_000


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what runs within have a partition for each PARTITION_ROWS rows where the session has fewer, so that a task's share
    doesn't grow with the table. Adaptive execution joins partitions that are small."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-rows // PARTITION_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType | T.VariantType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, columns with maps in them aside: orders rows that are otherwise tied."""
    names = [f.name for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*[df[c] for c in names]) if names else F.lit(0).cast("long")


def dealt_in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted over partitions, with __part and __n, a row's partition and its place in it, written once. Rows tied in
    order are split by a hash of the row, so that one value of the order can't fill a task; only copies of one whole row
    stay together.

    It is kept in the shared folder because two plans over a range partitioning need not agree on its bounds."""
    tie = "__tie"
    sorted_df = df.withColumn(tie, row_hash(df)).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    at = sorted_df.drop(tie).withColumn("__at", F.monotonically_increasing_id())
    return cut(at.select(*df.columns, F.shiftright("__at", 33).cast("int").alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__n")))


def with_dense_ids(df: DataFrame, *order: str, name: str = "fid") -> DataFrame:
    """Adds name: dense from 0, in the order of some columns (nulls first). One shuffle; what is collected per partition is
    one number. Rows that agree in all columns may swap ids, so ids are the same however df is partitioned."""
    dealt = dealt_in_order(df, *order)
    sizes = dealt.groupBy("__part").count()
    earlier = F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
    before = sizes.select(F.col("__part").alias("__p"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__before") + F.col("__n")).alias(name))
