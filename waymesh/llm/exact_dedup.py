"""Exact deduplication with a split of heavy hitters.

Each row is reduced to the SHA-256 of its normalised text. A Misra-Gries summary of every partition, merged by
key, names the digests that may hold more than a share PHI of all rows; there are at most about 1/PHI of them at
any size. A second pass counts those exactly and finds their winners, which are broadcast, so that their rows never
meet in one task. All other digests take the ordinary path: partial aggregation, one shuffle, and a join that
adaptive execution may split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import cut, documents

PHI = 1 / 128
COUNTERS = 1023


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def misra_gries(keys: Iterator[list], counters: int = COUNTERS) -> dict:
    """Counts of at most `counters` keys. A key's count is at most n/(counters+1) too low, never too high."""
    kept: Counter = Counter()
    for batch in keys:
        kept.update(batch)
        if len(kept) > counters:
            least = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({k: n - least for k, n in kept.items() if n > least})
    return dict(kept)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = misra_gries(b.column(0).to_pylist() for b in batches)
    yield pa.record_batch([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])


def heavy_digests(rows: DataFrame, phi: float = PHI) -> list[bytes]:
    """Every digest with over phi of the rows, and some with somewhat fewer: at most 1/(phi - 1/1024) of them."""
    total = rows.count()
    merged = rows.select("digest").mapInArrow(_summary, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    found = merged.filter(F.col("n") >= F.lit((phi - 1 / (COUNTERS + 1)) * total)).select("digest")
    return [bytes(r[0]) for r in found.collect()]


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float = PHI) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after each run of white space (space, tab to carriage return) became one space.
    The row with the smallest id stays; null ids come last. Null text counts as empty, and all empty texts are one
    group. Of repeated rows with the same id one stays. An empty table gives an empty result. Columns beyond id and
    text are ignored.
    """
    docs = documents(df, id_col, text_col)
    rows = cut(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")

    def winners(of: DataFrame) -> DataFrame:
        return of.groupBy(F.col("digest").alias("d")).agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))

    heavy = heavy_digests(rows, phi)
    out = None
    if heavy:
        hot = rows.filter(F.col("digest").isin(heavy))
        out = hot.join(F.broadcast(winners(hot)), F.col("digest") == F.col("d"))  # at most 1/(phi - 1/1024) rows
        rows = rows.filter(~F.col("digest").isin(heavy))
    rest = rows.join(winners(rows), F.col("digest") == F.col("d"))
    out = rest if out is None else out.unionByName(rest)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_groups keeps, with all their columns. The texts are shuffled once, and once more only if
    rows with one id and one text are there to be told apart."""
    found = cut(exact_groups(df, id_col, text_col))
    stay = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    keyed = df.withColumn("__key", F.sha2(normalised(text), 256))
    both = keyed.join(stay, keyed[id_col].eqNullSafe(stay["__id"]) & (keyed["__key"] == stay["__sha"]), "left_semi")
    if not found.filter("not kept and doc_id <=> keep_id").isEmpty():
        both = both.dropDuplicates([id_col, "__key"])
    return both.select(*df.columns)
