"""Profiles, counts, legends and class breaks. Each is one aggregate; what reaches the driver is a vocabulary or a
fixed number of values."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymesh.functions.ramp import sample
from waymesh.functions.scalars import as_number, strip
from waymesh.functions.widths import z_order
from waymesh.operators.filters import is_public
from waymesh.session import cut, dealt_in_order, with_dense_ids

FEW = 12  # distinct values up to which a column is treated as categories
GROUPS = 5
ID_NAMES = ("id", "fid", "gid", "uid", "objectid")


def kpis(df: DataFrame, class_col: str, name_col: str = "name") -> DataFrame:
    """One row: edges, classes, named, total_length (of the first numeric column called length, len or dist; else null)."""
    name = strip(F.col(name_col)) if name_col in df.columns else F.lit(None).cast("string")
    real = F.when((name != "") & (F.lower(F.col(name_col)) != "nan"), F.col(name_col)) if name_col in df.columns else name
    measure = next((f.name for f in df.schema.fields if f.name.lower().startswith(("length", "len", "dist")) and isinstance(f.dataType, T.NumericType)), None)
    total = F.sum(as_number(F.col(measure), df.schema[measure].dataType)) if measure else F.lit(None).cast("double")
    kind = F.when(F.col(class_col) != "", F.col(class_col))
    return df.agg(F.count("*").alias("edges"), F.count_distinct(kind).alias("classes"), F.count_distinct(real).alias("named"), total.alias("total_length"))


def length_label(total: Column) -> Column:
    return F.when(total >= 1000, F.concat(F.format_string("%.1f", total / 1000), F.lit(" km"))).otherwise(F.concat(F.floor(total + 0.5).cast("string"), F.lit(" m")))


def class_counts(df: DataFrame, class_col: str) -> DataFrame:
    """(class, n), without null and empty classes."""
    return df.filter(F.col(class_col).isNotNull() & (F.col(class_col) != "")).groupBy(F.col(class_col).alias("class")).agg(F.count("*").alias("n"))


def class_list(df: DataFrame, class_col: str) -> DataFrame:
    """The distinct classes, sorted; null counts as ""."""
    return df.select(F.coalesce(F.col(class_col), F.lit("")).alias("class")).distinct().orderBy("class")


def filter_panel(df: DataFrame, class_col: str, fid: str = "fid", fill: str = "__rs_fill") -> DataFrame:
    """(class, swatch, rank): each class with the fill of its first edge, the most important first."""
    kept = df.filter(F.col(class_col).isNotNull() & (F.col(class_col) != ""))
    first = kept.groupBy(F.col(class_col).alias("class")).agg(F.coalesce(F.min_by(fill, fid), F.lit("#888888")).alias("swatch"))
    return first.withColumn("rank", z_order(F.regexp_replace("class", "_link$", ""))).orderBy(F.desc("rank"), "class")


def has_bridges(df: DataFrame, lvl: str = "lvl") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(F.col(lvl) > 0), F.lit(False)).alias("bridges"))


def dash_values(df: DataFrame, dash: str = "__rs_dash") -> DataFrame:
    """The distinct dash patterns, sorted."""
    return df.filter(F.col(dash).isNotNull() & (F.col(dash) != "")).select(F.col(dash).alias("dash")).distinct().orderBy("dash")


def geometry_types(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row: types (sorted), all_null."""
    t = F.col(geometry)["gtype"]
    return df.agg(F.array_sort(F.collect_set(t)).alias("types"), F.every(t.isNull()).alias("all_null"))


def running_total(df: DataFrame, by: str, order: str, value: str, into: str = "running") -> DataFrame:
    """df with the running sum of a column along each chain. Rows are dealt by (by, order) and summed where they are; each
    partition's share of a chain then moves by what comes before it, so a chain of any length is summed by many tasks."""
    dealt = dealt_in_order(df, by, order)
    local = dealt.withColumn("__local", F.sum(value).over(W.partitionBy("__part", by).orderBy("__n").rowsBetween(W.unboundedPreceding, 0)))
    shares = dealt.groupBy(by, "__part").agg(F.sum(value).alias("__share"))  # a row for each chain, and one for each partition
    earlier = F.sum("__share").over(W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    before = shares.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), earlier.alias("__before"))
    both = local.join(before, local[by].eqNullSafe(before["__by"]) & (local["__part"] == before["__p"]))
    return both.select(*[local[c] for c in df.columns], F.coalesce(F.col("__local") + F.col("__before"), "__local", "__before").alias(into))


def extent(df: DataFrame, lines: str = "vertices") -> DataFrame:
    """One row: minx, miny, maxx, maxy of a column of lines. Partial aggregation; no vertex is shuffled."""
    xs, ys = F.transform(lines, lambda p: p["x"]), F.transform(lines, lambda p: p["y"])
    return df.agg(F.min(F.array_min(xs)).alias("minx"), F.min(F.array_min(ys)).alias("miny"), F.max(F.array_max(xs)).alias("maxx"), F.max(F.array_max(ys)).alias("maxy"))


def eligible_columns(df: DataFrame, geometry: str = "geometry") -> list[str]:
    """Columns worth colouring by: numbers, and others with one to FEW values; no ids. One pass over the data."""
    names = [f.name for f in df.schema.fields if f.name != geometry and is_public(f.name) and f.name.lower() not in ID_NAMES and not f.name.lower().endswith("_id")]
    numbers = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in names if c not in numbers and isinstance(df.schema[c].dataType, T.StringType | T.BooleanType | T.DateType)]
    if not others:
        return numbers
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in others]).first()
    return numbers + [c for c in others if 0 < counts[c] <= FEW]


def robust_range(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row: vlow, vhigh, the exact quantiles with linear interpolation. Distinct values are counted, and a running total over
    partitions says which ranks each has, so no task holds all of them."""
    value = as_number(F.col(column), df.schema[column].dataType)
    counts = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    placed = cut(running_total(counts, "all", "v", "n", into="passed"))
    n = placed.agg(F.coalesce(F.max("passed"), F.lit(0))).first()[0]

    def at(share: float) -> Column:
        x = share * (n - 1)
        a, b = (F.min(F.when(F.col("passed") > f(x), F.col("v"))) for f in (math.floor, math.ceil))
        return a if x == math.floor(x) else (math.ceil(x) - x) * a + (x - math.floor(x)) * b

    return placed.agg(at(low).alias("vlow"), at(high).alias("vhigh"))


def even_groups(df: DataFrame, column: str, groups: int = GROUPS) -> DataFrame:
    """(value, grp): the sorted distinct values in at most `groups` runs; run i ends before value floor((i+1)*n/k)."""
    values = with_dense_ids(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), "value", name="rank")
    n = F.col("n")
    k = F.least(F.lit(groups), n)
    return values.crossJoin(F.broadcast(values.agg(F.count("*").alias("n")))).select("value", F.floor(((F.col("rank") + 1) * k - 1) / n).cast("int").alias("grp"))


def colour_option(df: DataFrame, column: str, ramp: str = "viridis") -> dict | None:
    """How to colour by a column: a ramp from its 2nd to its 98th percentile for numbers with more than FEW values, else a
    colour for each value in at most five steps; None if it is all null."""
    kind = df.schema[column].dataType
    many = isinstance(kind, T.NumericType) and df.filter(F.col(column).isNotNull()).select(column).distinct().limit(FEW + 1).count() > FEW
    if many:
        r = robust_range(df, column).first()
        return {"color_by": column, "cmap": ramp, "vmin": r.vlow, "vmax": r.vhigh, "missing": "self"}
    rows = even_groups(df, column).orderBy("value").collect()
    if not rows:
        return None
    stops = sample(ramp, max(r.grp for r in rows) + 1)
    return {"color_by": column, "missing": "self", "colors": {r.value: stops[r.grp] for r in rows}}


STEP = 1 << 20  # candidates that the search for breaks holds at once, or those of one value if they are more


def _best_starts(best: np.ndarray, spread: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Of each j: the least best[s - 1] + spread(s, j + 1) over 1 <= s <= j, and the first such s.

    The first best s never falls as j grows, so the middle j of a range bounds those of both halves: n log n in all.
    The ranges of one depth are searched together."""
    n = len(best)
    now, came = np.full(n, np.inf), np.zeros(n, int)
    lo, hi, first, last = (np.array([x]) for x in (1, n - 1, 1, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        count = np.minimum(last, mid) - first + 1
        total = np.cumsum(count)
        at = 0
        while at < len(mid):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
            j, size = mid[at:to], count[at:to]
            begin = np.cumsum(size) - size
            starts = np.arange(size.sum()) + np.repeat(first[at:to] - begin, size)
            cost = best[starts - 1] + spread(starts, np.repeat(j, size) + 1)
            now[j] = least = np.minimum.reduceat(cost, begin)
            hits = np.flatnonzero(cost == np.repeat(least, size))
            came[j] = starts[hits[np.searchsorted(hits, begin)]]
            at = to
        left, right = lo < mid, mid < hi
        best_mid = came[mid]
        lo, hi, first, last = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (first[left], best_mid[right]), (best_mid[left], last[right])))
    return now, came


def natural_breaks(values: Sequence[float], weights: Sequence[int], k: int) -> list[float]:
    """Fisher, 1958: the upper ends of k classes of least squared deviation, over sorted distinct values with their counts."""
    v, w = np.asarray(values, float), np.asarray(weights, float)
    k, n = min(k, len(v)), len(v)
    c = v - np.average(v, weights=w)  # so that squares don't drown the differences
    sw, sx, sxx = (np.concatenate(([0], np.cumsum(a))) for a in (w, w * c, w * c * c))
    spread = lambda a, b: (sxx[b] - sxx[a]) - (sx[b] - sx[a]) ** 2 / (sw[b] - sw[a])
    best = spread(0, np.arange(1, n + 1))
    back = []
    for _ in range(1, k):
        best, came = _best_starts(best, spread)
        back.append(came)
    ends, j = [], n - 1
    for came in reversed(back):
        ends.append(v[j])
        j = came[j] - 1
    return [*map(float, [v[j], *ends[::-1]])]


def class_breaks(df: DataFrame, column: str, scheme: str = "quantiles", k: int = 5) -> list[float]:
    """Upper edges of k classes: quantiles, equal_interval, fisher_jenks or natural_breaks, std_mean. Unknown schemes are
    quantiles. Nulls don't count; no values give no edges, equal values one. Natural breaks are exact: the distinct values
    and their counts come to the driver, 16 bytes for each."""
    value = as_number(F.col(column), df.schema[column].dataType)
    rows = df.select(value.alias("v")).filter("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return []
    if low == high:
        return [high]
    name = scheme.lower()
    if name == "equal_interval":
        return [low + (high - low) / k * (i + 1) for i in range(k)]
    if name == "std_mean":
        mean, std = rows.agg(F.mean("v"), F.stddev_pop("v")).first()
        return sorted({*(x for x in (mean + m * std for m in (-2, -1, 1, 2)) if x < high), high})
    if name in ("fisher_jenks", "natural_breaks"):
        found = rows.groupBy("v").count().toArrow()
        values, weights = found["v"].to_numpy(), found["count"].to_numpy()
        order = np.argsort(values)
        values, weights = values[order], weights[order]
        return natural_breaks(values, weights, k)
    return list(rows.agg(F.percentile("v", [(i + 1) / k for i in range(k)]).alias("q")).first()["q"])
