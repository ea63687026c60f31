"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Pieces are taken in order of falling length. A piece goes
to the open bin that it leaves least room in; where none has room, the bin is opened whose cost for each token it can
be expected to hold is least, given the pieces still to come. At the end every bin shrinks to the least permitted
length that holds its contents. This is done for every limit on the longest length in use, and the cheapest packing
of the group is kept, so the lengths are chosen together.

Pieces are dealt by a hash into groups of about GROUP, so the work spreads at any size and no task grows with the
table; only lengths are shuffled, never texts. Equal pieces (repeated rows) are counted first and dealt by DEAL copies at
a time, so they spread like any others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymesh.llm.common import cut, documents, id_type

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
GROUP = 8192
DEAL = 256  # copies of one piece that go to a group together
FIXED_COST = 256.0
ATTENTION = 65536.0


def cost(length: int) -> float:
    """Of one sequence: a fixed part, a part in proportion to its length, and attention, which is quadratic."""
    return FIXED_COST + length + length * length / ATTENTION


def best_fit(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """lengths: falling, none over the largest capacity. (bin, offset) of each, and the capacity that each bin opened with."""
    after = np.concatenate((np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]))
    rising = np.asarray(lengths, np.int64)[::-1]
    free: list[int] = []  # the room that some open bin has, sorted
    having: dict[int, list[int]] = {}
    bins, offsets, opened = [], [], []
    for i, n in enumerate(lengths):
        at = bisect_left(free, n)
        if at < len(free):
            room = free[at]
            b = having[room].pop()
            if not having[room]:
                del having[room]
                free.pop(at)
        else:
            best = None
            for c in capacities:
                if c >= n:
                    small = len(lengths) - int(np.searchsorted(rising, c - n, "right"))  # the first piece that fits beside it
                    fill = min(c - n, int(after[max(small, i + 1)]))
                    per_token = cost(c) / (n + fill)
                    if best is None or per_token < best[0]:
                        best = (per_token, c)
            b, room = len(opened), best[1]
            opened.append(room)
        bins.append(b)
        offsets.append(opened[b] - room)
        left = room - n
        if left:
            if left not in having:
                having[left] = []
                insort(free, left)
            having[left].append(b)
    return bins, offsets, opened


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """lengths: falling. (bin, offset) of each, and each bin's capacity: the cheapest packing over all limits."""
    best = None
    capacities = sorted(capacities)
    for top in range(len(capacities)):
        allowed = capacities[: top + 1]
        if lengths and lengths[0] > allowed[-1]:
            continue
        bins, offsets, opened = best_fit(lengths, allowed)
        used = np.bincount(bins, weights=lengths, minlength=len(opened)).astype(np.int64)
        sizes = [capacities[bisect_left(capacities, int(u))] for u in used]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = (total, bins, offsets, sizes)
    return best[1:]


def _packer(capacities: Sequence[int], id_arrow: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy()))
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        group = int(table.column("grp")[0].as_py())
        bins, offsets, sizes = pack(table.column("length").to_pylist(), capacities)
        used = np.bincount(bins, weights=table.column("length").to_numpy(), minlength=len(sizes)).astype(np.int64)
        bins = np.array(bins)
        return pa.table(
            {
                "doc_id": table.column("doc_id").cast(id_arrow),
                "start": table.column("start"),
                "length": table.column("length"),
                "bin_id": pa.array((group << 32) + bins),
                "bin_offset": pa.array(offsets, pa.int64()),
                "bin_capacity": pa.array(np.array(sizes, np.int64)[bins]),
                "bin_used": pa.array(used[bins]),
            }
        )

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, length: Column | None = None, group: int = GROUP) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, bin_id, bin_offset, bin_capacity, bin_used.

    length: tokens of a document, by default its UTF-8 bytes and one end mark. A document of more tokens than the
    largest capacity is cut into full pieces and a rest. Null and empty texts are one end mark and are packed like any
    other row, as are rows with null ids and repeated rows. An empty table gives an empty result. Columns beyond id and
    text are ignored.
    """
    docs = documents(df, id_col, text_col)
    kind = id_type(df, id_col)
    largest = max(capacities)
    sized = docs.select("doc_id", (F.octet_length("text") + 1 if length is None else length).cast("long").alias("total"))
    pieces = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(largest).cast("long"))).alias("start"))
    pieces = pieces.select("doc_id", "start", F.least(F.col("total") - F.col("start"), F.lit(largest)).cast("long").alias("length")).filter("length > 0")
    pieces = cut(pieces.groupBy("doc_id", "start", "length").agg(F.count("*").alias("n")))
    groups = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // group))
    dealt = pieces.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DEAL).cast("long"))))
    dealt = dealt.select("doc_id", "start", "length", F.least(F.col("n") - F.col("at"), F.lit(DEAL)).alias("copies"), F.pmod(F.xxhash64("doc_id", "start", "length", "at"), F.lit(groups)).alias("grp"))
    schema = f"doc_id {kind.simpleString()}, start long, length long, bin_id long, bin_offset long, bin_capacity long, bin_used long"
    return dealt.groupBy("grp").applyInArrow(_packer(tuple(capacities), to_arrow_type(kind)), schema)
