"""Style resolution: a styler is DataFrame in, DataFrame out, and adds the __rs_ columns.

Palettes and colour maps are dimension tables: their size is that of the vocabulary a user passes in, so they are
broadcast, and no fact row is shuffled. A numeric styler needs the range of its column: one aggregate, whose single
row is joined back by broadcast, so the whole style is one plan and one job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.ramp import MISSING_COLOR, color_at, ramp_position, sample
from waymesh.functions.scalars import as_number, base_class, clamp01, color_or, dash_text, flag_for_style, is_link, key_text
from waymesh.sources.palettes import FALLBACK, Palette, palette_styles, palette_table
from waymesh.sources.settings import DEFAULT, Settings

STYLE_COLUMNS = ("__rs_fill", "__rs_w", "__rs_op", "__rs_dash", "__rs_casing", "__rs_cw", "__rs_cop", "__rs_class")
MISSING = "__rs_missing"  # no colour for the row; dropped by bake()


class Styler(Protocol):
    """Anything that adds STYLE_COLUMNS and MISSING to an edge table, lazily."""

    def apply(self, df: DataFrame) -> DataFrame: ...

    def legend(self, df: DataFrame) -> dict | None: ...


@dataclass(frozen=True)
class ClassStyler:
    """By class, from a palette. Links are narrower, tunnels faded and dashed, bridges black-cased. Unknown classes take
    the fallback class, or the palette's first if it has no such class."""

    column: str = "highway"
    palette: Palette = "highsat"
    normalize_links: bool = True
    fallback: str = FALLBACK
    tunnel_col: str | None = None
    bridge_col: str | None = None
    settings: Settings = DEFAULT

    def apply(self, df: DataFrame) -> DataFrame:
        styles = palette_styles(self.palette)
        other = styles[self.fallback if self.fallback in styles else next(iter(styles))]
        s = self.settings
        table = palette_table(df.sparkSession, self.palette).select(*[F.col(c).alias(f"__p_{c}") for c in ("class", "fill", "width", "casing_width", "casing", "dash", "opacity")])
        raw = F.col(self.column)
        df = df.withColumn("__rs_class", base_class(raw) if self.normalize_links else key_text(raw))
        df = df.join(F.broadcast(table), F.col("__rs_class") == F.col("__p_class"), "left")
        found = F.col("__p_class").isNotNull()
        pick = lambda name, default: F.when(found, F.col(f"__p_{name}")).otherwise(default)
        scale = F.when(is_link(raw), F.lit(s.link_scale)).otherwise(F.lit(1.0)) if self.normalize_links else F.lit(1.0)
        flag = lambda c: flag_for_style(F.col(c)) if c and c in df.columns else F.lit(False)
        tunnel, bridge = flag(self.tunnel_col), flag(self.bridge_col)
        width = pick("width", F.lit(float(other.width))) * scale
        casing_width = pick("casing_width", F.lit(float(other.casing_width))) * scale
        faded = F.when(tunnel, F.lit(s.tunnel_scale)).otherwise(F.lit(1.0))
        dash = dash_text(pick("dash", F.array(*map(F.lit, other.dash)) if other.dash else F.lit(None).cast("array<int>")))
        tunnel_dash = F.lit(",".join(map(str, s.tunnel_dash)))
        out = df.withColumns(
            {
                "__rs_fill": pick("fill", F.lit(other.fill)),
                "__rs_w": width,
                "__rs_op": pick("opacity", F.lit(float(other.opacity))) * s.fill_opacity * faded,
                "__rs_dash": F.when(tunnel, F.coalesce(dash, tunnel_dash)).otherwise(dash),
                "__rs_casing": F.when(bridge, F.lit(s.bridge_casing)).otherwise(pick("casing", F.lit(other.casing))),
                "__rs_cw": F.when(bridge, F.when(casing_width == 0, width).otherwise(casing_width) + s.bridge_extra).otherwise(casing_width),
                "__rs_cop": F.lit(s.casing_opacity) * faded,
                MISSING: F.lit(False),
            }
        )
        return out.drop(*[c for c in out.columns if c.startswith("__p_")])

    def legend(self, df: DataFrame) -> None:
        return None


def _constants(width: Column, opacity: float, casing: str | None, casing_width: float, casing_opacity: float, dash: Sequence[int] | None = None) -> dict[str, Column]:
    return {
        "__rs_w": width,
        "__rs_op": F.lit(float(opacity)),
        "__rs_dash": F.lit(",".join(map(str, dash)) if dash else None).cast("string"),
        "__rs_casing": F.lit(casing).cast("string"),
        "__rs_cw": F.lit(float(casing_width) if casing else 0.0),
        "__rs_cop": F.lit(float(casing_opacity)),
    }


@dataclass(frozen=True)
class CategoricalStyler:
    """By a discrete value in any column. Keys are compared stripped and in lower case; of equal keys the last counts."""

    column: str
    colors: Mapping[str, str]
    fallback_color: str = MISSING_COLOR
    width: float | str = 2.0
    opacity: float = 0.9
    casing: str | None = None
    casing_width: float = 0.0
    casing_opacity: float = 0.75
    dash: Sequence[int] | None = None
    missing: str = "base"

    def _map(self) -> dict[str, str]:
        return {str(k).strip().lower(): v for k, v in self.colors.items()}

    def apply(self, df: DataFrame) -> DataFrame:
        table = df.sparkSession.createDataFrame(list(self._map().items()) or [("", None)], "__k string, __v string")
        if isinstance(self.width, str):
            known = self.width in df.columns
            number = as_number(F.col(self.width), df.schema[self.width].dataType) if known else None
            width = F.coalesce(number, F.lit(0.0)) if known else F.lit(2.0)
        else:
            width = F.lit(float(self.width))
        df = df.withColumn("__rs_class", key_text(F.col(self.column))).join(F.broadcast(table), F.col("__rs_class") == F.col("__k"), "left")
        hit = F.col("__k").isNotNull() & F.col("__v").isNotNull()
        return df.withColumns({"__rs_fill": F.when(hit, F.col("__v")).otherwise(F.lit(self.fallback_color)), MISSING: ~hit, **_constants(width, self.opacity, self.casing, self.casing_width, self.casing_opacity, self.dash)}).drop("__k", "__v")

    def present(self, df: DataFrame) -> DataFrame:
        """(position, label, color) of the entries that occur: the legend's rows."""
        entries = df.sparkSession.createDataFrame([(i, str(k), v, str(k).strip().lower()) for i, (k, v) in enumerate(self.colors.items())], "position int, label string, color string, key string")
        have = df.select(key_text(F.col(self.column)).alias("key")).distinct()
        return entries.join(have, "key", "left_semi").select("position", "label", "color").orderBy("position")

    def legend(self, df: DataFrame) -> dict:
        return {"kind": "categorical", "title": self.column, "entries": [(r.label, r.color) for r in self.present(df).collect()]}


@dataclass(frozen=True)
class NumericStyler:
    """By a number, over a ramp from vmin to vmax, by default the least and greatest of the rows at hand. width_by makes
    the width follow the same or another column over its own range."""

    column: str
    cmap: str | Sequence[str] = "viridis"
    vmin: float | None = None
    vmax: float | None = None
    width: float = 2.0
    width_by: tuple[float, float] | None = None
    width_column: str | None = None
    opacity: float = 0.9
    casing: str | None = None
    casing_width: float = 0.0
    casing_opacity: float = 0.75
    nan_color: str = MISSING_COLOR
    missing: str = "base"
    range_of: DataFrame | None = None  # where the ranges come from: the same rows before a join that they needn't repeat

    def _number(self, df: DataFrame, name: str) -> Column:
        return as_number(F.col(name), df.schema[name].dataType)

    def _range(self, df: DataFrame) -> DataFrame:
        """One row: vmin, vmax, wmin, wmax."""
        value = self._number(df, self.column)
        by = self._width_column(df)
        width = self._number(df, by) if self.width_by else F.lit(None).cast("double")
        low = F.lit(float(self.vmin)) if self.vmin is not None else F.coalesce(F.min(value), F.lit(0.0))
        high = F.lit(float(self.vmax)) if self.vmax is not None else F.coalesce(F.max(value), F.lit(1.0))
        return df.agg(low.alias("__lo"), high.alias("__hi"), F.coalesce(F.min(width), F.lit(0.0)).alias("__wlo"), F.coalesce(F.max(width), F.lit(1.0)).alias("__whi"))

    def _width_column(self, df: DataFrame) -> str:
        return self.width_column if self.width_column in df.columns else self.column

    def apply(self, df: DataFrame) -> DataFrame:
        value = self._number(df, self.column)
        if self.vmin is not None and self.vmax is not None and not self.width_by:
            low, high, ranged = F.lit(float(self.vmin)), F.lit(float(self.vmax)), df  # nothing to aggregate
        else:
            low, high, ranged = F.col("__lo"), F.col("__hi"), df.crossJoin(F.broadcast(self._range(self.range_of if self.range_of is not None else df)))
        width = F.lit(float(self.width))
        if self.width_by:
            a, b = map(float, self.width_by)
            number = self._number(df, self._width_column(df))
            span = F.when(F.col("__whi") == F.col("__wlo"), F.lit(1.0)).otherwise(F.col("__whi") - F.col("__wlo"))
            width = F.coalesce(F.lit(a) + F.lit(b - a) * clamp01((number - F.col("__wlo")) / span), F.lit(a))
        placed = ranged.withColumn("__at", ramp_position(value, low, high, self.cmap))
        return placed.withColumns(
            {"__rs_fill": color_at(F.col("__at"), self.cmap, self.nan_color), "__rs_class": F.lit(None).cast("string"), MISSING: value.isNull(), **_constants(width, self.opacity, self.casing, self.casing_width, self.casing_opacity)}
        ).drop("__at", "__lo", "__hi", "__wlo", "__whi")

    def legend(self, df: DataFrame) -> dict:
        r = self._range(df).first()
        return {"kind": "continuous", "title": self.column, "vmin": r["__lo"], "vmax": r["__hi"], "ramp": sample(self.cmap, 9)}


@dataclass(frozen=True)
class ColorTableStyler:
    """Widths and casing by class, the fill from a column of literal colours; grey where it is blank."""

    color_column: str
    column: str = "highway"
    palette: Palette = "highsat"
    fallback_color: str = "#bbbbbb"

    def apply(self, df: DataFrame) -> DataFrame:
        if self.column in df.columns:
            out = ClassStyler(self.column, self.palette).apply(df)
        else:
            out = df.withColumns({"__rs_class": F.lit(None).cast("string"), **_constants(F.lit(2.0), 0.9, "#bcbcbc", 3.0, 0.75)})
        color = F.col(self.color_column) if self.color_column in df.columns else F.lit(None).cast("string")
        return out.withColumns({"__rs_fill": color_or(color, self.fallback_color), MISSING: F.nullif(F.trim(color), F.lit("")).isNull()})

    def legend(self, df: DataFrame) -> None:
        return None


@dataclass(frozen=True)
class UserStyler:
    """A function DataFrame -> DataFrame that adds STYLE_COLUMNS."""

    function: Callable[[DataFrame], DataFrame]
    missing: str = field(default="base")

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.function(df)
        if lost := [c for c in STYLE_COLUMNS if c not in out.columns]:
            raise ValueError(f"the styler did not add {lost}")
        return out if MISSING in out.columns else out.withColumn(MISSING, F.lit(False))

    def legend(self, df: DataFrame) -> None:
        return None


def build_styler(
    style: Styler | Callable[[DataFrame], DataFrame] | None = None,
    palette: Palette = "highsat",
    class_col: str = "highway",
    color_by: str | None = None,
    colors: Mapping[str, str] | str | None = None,
    cmap: str | Sequence[str] | None = None,
    vmin: float | None = None,
    vmax: float | None = None,
    width_by: tuple[float, float] | None = None,
    tunnel_col: str | None = None,
    bridge_col: str | None = None,
    settings: Settings = DEFAULT,
    missing: str = "base",
) -> Styler:
    """A given style first; then literal colours (colors="self"), a colour map, a number; else the class."""
    if style is not None:
        return style if hasattr(style, "apply") else UserStyler(style)
    if color_by is not None and colors == "self":
        return ColorTableStyler(color_by, class_col, palette)
    if color_by is not None and colors is not None:
        return CategoricalStyler(color_by, colors, missing=missing)
    if color_by is not None:
        return NumericStyler(color_by, cmap or "viridis", vmin, vmax, width_by=width_by, missing=missing)
    return ClassStyler(class_col, palette, tunnel_col=tunnel_col, bridge_col=bridge_col, settings=settings)


def color_by_class(column: str = "highway", palette: Palette = "highsat", **more) -> ClassStyler:
    return ClassStyler(column, palette, **more)


def color_by(column: str, colors: Mapping[str, str], **more) -> CategoricalStyler:
    return CategoricalStyler(column, colors, **more)


def color_by_value(column: str, cmap: str | Sequence[str] = "viridis", **more) -> NumericStyler:
    return NumericStyler(column, cmap, **more)


def bake(df: DataFrame, styler: Styler) -> DataFrame:
    """df with the eight style columns."""
    return styler.apply(df).drop(MISSING)


def bake_options(df: DataFrame, options: Mapping[str, Styler], style: Styler | None = None) -> tuple[DataFrame, list[dict]]:
    """Several colourings of one table: the first option's fill is __rs_fill, the others' __rs_fill__1 and so on. Width,
    casing and class are the first option's, or those of style. Where an option has no colour for a row, the row takes
    the first option's fill, unless the option's missing is "self". The second value says which column is whose.

    Every option adds columns to the same rows, so there is one scan whatever their number."""
    items = list(options.items())
    fills = []
    for i, (_, styler) in enumerate(items):
        df = styler.apply(df).withColumnsRenamed({"__rs_fill": f"__f{i}", MISSING: f"__m{i}"})
        shared = [c for c in STYLE_COLUMNS if c != "__rs_fill"]
        df = df.withColumnsRenamed({c: f"__keep{c}" for c in shared}) if i == 0 and style is None else df.drop(*shared)
        own = i == 0 or getattr(styler, "missing", "base") == "self"
        fills.append(F.col(f"__f{i}") if own else F.when(F.col(f"__m{i}"), F.col("__f0")).otherwise(F.col(f"__f{i}")))
    if style is not None:
        df = style.apply(df).drop("__rs_fill", MISSING)
    else:
        df = df.withColumnsRenamed({c: c.removeprefix("__keep") for c in df.columns if c.startswith("__keep")})
    names = ["__rs_fill" if i == 0 else f"__rs_fill__{i}" for i in range(len(items))]
    out = df.withColumns(dict(zip(names, fills))).drop(*[f"__{x}{i}" for x in "fm" for i in range(len(items))])
    return out, [{"name": name, "prop": prop} for (name, _), prop in zip(items, names)]


def join_colors(df: DataFrame, id_col: str, table: DataFrame, key: str | None = None, color: str | None = None, order: str | None = None, into: str = "__color") -> DataFrame:
    """Literal colours from a side table, by the text of the id. Of repeated ids the last row counts: the greatest in
    order, a column of the table. Rows of a table have no order of their own, so without one repeated ids are an error.
    The side table may be of any size; adaptive execution picks the join."""
    key, color = key or table.columns[0], color or table.columns[1]
    for c in (key, color, *([order] if order else [])):
        if c not in table.columns:
            raise ValueError(f"no column {c!r} in the colour table; there are {table.columns}")
    if order is None:
        found = F.when(F.count("*") == 1, F.first(color)).otherwise(F.raise_error(F.lit("an id has several colours; name the column that orders them")).cast("string"))
    else:
        found = F.max_by(color, order)
    side = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("__id")).agg(found.alias(into))
    return df.join(side, F.col(id_col).cast("string") == F.col("__id"), "left").drop("__id")


def color_rows(spark, table: DataFrame | Mapping) -> DataFrame:
    """A colour table as rows; of a mapping the order is kept in __n."""
    if isinstance(table, DataFrame):
        return table
    return spark.createDataFrame([(str(k), v, i) for i, (k, v) in enumerate(table.items())], "id string, color string, __n int")


def resolve_one(spark, name: str | None, palette: Palette = "highsat", tunnel: bool = False, bridge: bool = False) -> dict:
    """The style of one class, by the same plan as for a table."""
    df = spark.createDataFrame([(name, str(tunnel), str(bridge))], "highway string, tunnel string, bridge string")
    return bake(df, ClassStyler("highway", palette, tunnel_col="tunnel", bridge_col="bridge")).first().asDict()


def to_arrays(df: DataFrame) -> DataFrame:
    """For array renderers: fill_rgba array<int> and width_f float, from the style columns."""
    from waymesh.functions.scalars import rgba

    alpha = F.floor(F.col("__rs_op") * 255)
    return df.withColumns({"fill_rgba": rgba(F.col("__rs_fill"), alpha), "width_f": F.col("__rs_w").cast("float")})


def selection_style(width: Column, settings: Settings = DEFAULT) -> dict[str, Column]:
    """Widths of the three layers that mark a selected edge."""
    return {name: width * factor for name, factor in settings.selection.items()}


