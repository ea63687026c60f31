"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Kept apart from the join, which can then split a node with very many neighbours.
    least = cut(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")))
    return both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
    hung = down.join(least, F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of long. One row for each node of an edge that isn't its component's least: u, v the least node.

    The rounds grow with the logarithm of the nodes, and go on until nothing changes; each is written to the shared folder, so the plan stays short and
    survives lost executors. Nothing but the edge count and a checksum comes to the driver. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(now)
    if not before[0]:
        return now
    while True:
        now = cut(_small_star(cut(_large_star(now))))
        after = state(now)
        if after == before:
            return now
        before = after
