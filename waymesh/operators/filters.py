"""Row filters and column projections of edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import is_finite
from waymesh.functions.scalars import base_class, key_text

LINE_TYPES = ("LineString", "MultiLineString")
POPUP_FIELDS = ("name", "edge_id", "edge_ref", "highway", "lanes", "bridge", "tunnel")


def filter_classes(df: DataFrame, class_col: str, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, match_links: bool = True) -> DataFrame:
    """Rows whose class is in include (None: all; empty: none) and not in exclude. Classes are compared stripped and in
    lower case; with match_links a link counts as its road. A null class is "". The key is never null, so no row is lost
    to three-valued logic."""
    if include is None and exclude is None:
        return df
    key = base_class(F.col(class_col)) if match_links else key_text(F.col(class_col))
    norm = lambda names: sorted({n.strip().lower() for n in names})
    if include is not None:
        df = df.filter(key.isin(norm(include)) if include else F.lit(False))
    if exclude:
        df = df.filter(~key.isin(norm(exclude)))
    return df


def drop_unusable(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Without rows whose geometry is null, empty or not finite."""
    g = F.col(geometry)
    ok = g.isNotNull() & g["parts"].isNotNull() & (F.size(g["parts"]) > 0) & F.forall(g["parts"], is_finite)
    return df.filter(F.coalesce(ok, F.lit(False)))


def drop_non_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return df.filter(F.coalesce(F.col(geometry)["gtype"].isin(*LINE_TYPES), F.lit(False)))


def drop_counts(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row: rows, unusable, non_lines: what the two filters above would drop, for a warning."""
    g = F.col(geometry)
    usable = F.coalesce(g.isNotNull() & g["parts"].isNotNull() & (F.size(g["parts"]) > 0) & F.forall(g["parts"], is_finite), F.lit(False))
    line = F.coalesce(g["gtype"].isin(*LINE_TYPES), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(~usable).alias("unusable"), F.count_if(usable & ~line).alias("non_lines"))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else an error that lists what there is. No job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {missing}; there are {df.columns}")
    return df


def visible_at(df: DataFrame, class_col: str, zoom: int | Column, min_zoom: Mapping[str, int]) -> DataFrame:
    """Rows drawn at a zoom. The class is looked up as it stands; unlisted ones are always drawn."""
    return df.filter(min_zoom_of(F.col(class_col), min_zoom) <= zoom)


def min_zoom_of(name: Column, min_zoom: Mapping[str, int]) -> Column:
    if not min_zoom:
        return F.lit(0)
    table = F.create_map(*[x for k, v in min_zoom.items() for x in (F.lit(str(k)), F.lit(int(v)))])
    return F.coalesce(F.try_element_at(table, F.coalesce(name.cast("string"), F.lit(""))), F.lit(0))


def on_grade(df: DataFrame, grade: str, lvl: str = "lvl") -> DataFrame:
    """surface, tunnel or bridge rows; a null level is the surface."""
    at = F.coalesce(F.col(lvl), F.lit(0))
    return df.filter({"surface": at == 0, "tunnel": at < 0, "bridge": at > 0}[grade])


def undashed(df: DataFrame, dash: str = "dash") -> DataFrame:
    return df.filter(F.col(dash).isNull() | (F.col(dash) == ""))


def classes_shown(df: DataFrame, class_col: str, shown: Sequence[str] | None, keep_null: bool) -> DataFrame:
    """Rows of the shown classes (None: all). Rows without a class are kept or not, as the two map renderers differ."""
    if shown is None:
        return df
    hit = F.col(class_col).isin(list(shown)) if shown else F.lit(False)
    return df.filter(F.coalesce(hit, F.lit(keep_null)))


def tooltip_columns(df: DataFrame, fields: Sequence[str] | None = None, geometry: str = "geometry") -> DataFrame:
    """The fields that there are; by default every column but the geometry."""
    names = [c for c in df.columns if c != geometry] if fields is None else [f for f in fields if f in df.columns]
    return df.select(*names)


def popup_columns(df: DataFrame, popup: bool | str | Sequence[str], geometry: str = "geometry") -> DataFrame | None:
    """False: none; True or "panel": the usual fields; "all": every public column; or a list."""
    if popup is False:
        return None
    if popup == "all":
        return df.select(*[c for c in df.columns if c != geometry and is_public(c)])
    return tooltip_columns(df, POPUP_FIELDS if popup is True or popup == "panel" else popup, geometry)


def is_public(name: str) -> bool:
    """Not one of the derived columns."""
    return not name.startswith("_") and name not in ("twoway", "lvl")


def tile_columns(df: DataFrame, keep: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.startswith("__rs_") or c in keep]


def edges_by_id(df: DataFrame, ids: DataFrame, fid: str = "fid") -> DataFrame:
    """The rows whose id is in ids: a semi-join, so the list may be of any size."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("__fid")), F.col(fid) == F.col("__fid"), "left_semi")
