"""Query verbs over an edge table with an id column: predicates to ids, ids to rows, colours, extents and search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymesh.functions.scalars import is_set
from waymesh.operators.filters import edges_by_id, is_public
from waymesh.operators.profile import extent

TOP = 30


def predicate(text: str) -> Column:
    """A condition on the columns, in SQL. Also understood: p.column, ==, &&, ||, ! and strict comparisons. Function
    calls and subqueries are refused, so a text from outside can only compare. A null comparison is false in a filter."""
    quoted = re.split(r"('(?:[^']|'')*'|\"[^\"]*\")", text)
    for i in range(0, len(quoted), 2):
        part = quoted[i]
        if m := re.search(r"\b(?!(?:and|or|not|in|between|like|is)\b)([A-Za-z_]\w*)\s*\(", part, re.I):
            raise ValueError(f"a query can't call {m[1]}")
        if re.search(r"[;`]|--|/\*|\b(select|from|union)\b", part, re.I):
            raise ValueError("a query is a single condition")
        part = re.sub(r"\bp\.(?=[A-Za-z_])", "", part)
        part = re.sub(r"!==", "<>", re.sub(r"===?", "=", part))
        part = part.replace("&&", " and ").replace("||", " or ")
        quoted[i] = re.sub(r"!(?!=)", " not ", part)
    for i in range(1, len(quoted), 2):
        if quoted[i][0] == '"':
            quoted[i] = "'" + quoted[i][1:-1].replace("'", "''") + "'"
    return F.expr("".join(quoted))


def query(df: DataFrame, where: str | Column, fid: str = "fid") -> DataFrame:
    """The ids of the rows that meet a condition."""
    return df.filter(predicate(where) if isinstance(where, str) else where).select(fid)


def keep_ids(df: DataFrame, ids: DataFrame | None, fid: str = "fid") -> DataFrame:
    """None resets. Comes on top of a class filter."""
    return df if ids is None else edges_by_id(df, ids, fid)


def recolor(df: DataFrame, ids: DataFrame | None, color: str, fid: str = "fid", fill: str = "__rs_fill") -> DataFrame:
    """Another fill for some rows."""
    if ids is None:
        return df
    hit = ids.select(F.col(ids.columns[0]).alias("__hit")).distinct()
    return df.join(hit, F.col(fid) == F.col("__hit"), "left").withColumn(fill, F.when(F.col("__hit").isNotNull(), F.lit(color)).otherwise(F.col(fill))).drop("__hit")


def highlight(df: DataFrame, ids: DataFrame, fid: str = "fid") -> DataFrame:
    hit = ids.select(F.col(ids.columns[0]).alias("__hit")).distinct()
    return df.join(hit, F.col(fid) == F.col("__hit"), "left").withColumn("highlighted", F.col("__hit").isNotNull()).drop("__hit")


def properties(df: DataFrame, ids: DataFrame, fid: str = "fid", geometry: str = "geometry") -> DataFrame:
    """The public columns of some rows."""
    return edges_by_id(df, ids, fid).select(*[c for c in df.columns if is_public(c) and c != geometry])


def focus(df: DataFrame, ids: DataFrame, lines: str = "vertices", fid: str = "fid") -> DataFrame:
    return extent(edges_by_id(df, ids, fid), lines)


def select_one(df: DataFrame, value: int, fid: str = "fid") -> DataFrame:
    """A point lookup: the filter reaches the scan."""
    return df.filter(F.col(fid) == value)


def color_field(df: DataFrame, names: Sequence[str], which: str | int) -> Column:
    """The fill of a colouring, by name or position; an unknown one is the base fill."""
    i = which if isinstance(which, int) else names.index(which) if which in names else 0
    column = f"__rs_fill__{i}" if 0 < i < len(names) else "__rs_fill"
    return F.coalesce(F.col(column), F.col("__rs_fill")) if column in df.columns else F.col("__rs_fill")


def first_per_name(df: DataFrame, name: str = "name", fid: str = "fid", limit: int = TOP) -> DataFrame:
    """The first row of each name, in id order, at most limit: the result list of a query. An aggregate by name, then a
    top-k; no window over the table."""
    named = df.filter(F.col(name).isNotNull() & (F.col(name) != ""))
    return named.groupBy(name).agg(F.min(fid).alias(fid)).orderBy(fid).limit(limit).select(fid, name)


def search_hits(df: DataFrame, text: str, fields: Sequence[str] | None = None, fid: str = "fid") -> DataFrame:
    """(fid, field, value) of every row with a hit, for the first column, in column order, whose value contains the text,
    or whose name does while its value is set. Fewer than two characters find nothing."""
    s = (text or "").strip().lower()
    names = [c for c in (fields or df.columns) if c in df.columns and is_public(c) and c != fid]
    if len(s) < 2 or not names:
        return df.limit(0).select(fid, F.lit("").alias("field"), F.lit("").alias("value"))
    hits = []
    for c in names:
        value = F.col(c).cast("string")
        low = F.lower(value)
        hit = low.contains(s) & (low != "nan")
        if s in c.lower():
            hit = hit | is_set(F.col(c))
        hits.append(F.when(hit, F.struct(F.lit(c).alias("field"), value.alias("value"))))
    return df.withColumn("__hit", F.coalesce(*hits)).filter("__hit is not null").select(fid, F.col("__hit.field").alias("field"), F.col("__hit.value").alias("value"))


def search(df: DataFrame, text: str, fields: Sequence[str] | None = None, fid: str = "fid", limit: int = TOP) -> DataFrame:
    """The first hits in id order: a report of at most limit rows."""
    return search_hits(df, text, fields, fid).orderBy(fid).limit(limit)


def hit_test(areas: DataFrame, points: DataFrame, ring: str = "ring", area_id: str = "area_id", cell: float = 1.0) -> DataFrame:
    """Which areas (a closed ring of vertices) hold which points (x, y): an equi-join on grid cells of the areas' boxes,
    then ray casting. Points on an edge may fall either way."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    span = lambda c: F.sequence(F.floor(F.array_min(c) / cell), F.floor(F.array_max(c) / cell))
    cells = areas.withColumn("cx", F.explode(span(xs))).withColumn("cy", F.explode(span(ys)))
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crossed = F.filter(edges, lambda e: ((e["p"]["y"] > F.col("y")) != (e["q"]["y"] > F.col("y"))) & (F.col("x") < (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return at.join(cells, ["cx", "cy"]).filter(F.size(crossed) % 2 == 1).select(area_id, *points.columns)


def ordered_first(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each group with all its columns."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).filter("__n = 1").drop("__n")
