"""From any edge input to everything a map shows, as lazy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.scalars import level
from waymesh.functions.widths import draw_rank
from waymesh.operators import graph, profile, styling, tiles
from waymesh.operators.filters import filter_classes
from waymesh.sources.ingest import as_edges, overlay_kind, overlay_style, with_ids
from waymesh.sources.settings import DEFAULT, Settings

LABEL_ZOOM = 13  # below it names and arrows would cover the map


@dataclass(frozen=True)
class Network:
    """edges: the styled edge table with fid, lvl, twoway, __rs_oneway and draw rank. Everything else follows from it."""

    edges: DataFrame
    class_col: str
    settings: Settings
    options: list[dict] = field(default_factory=list)
    overlays: dict[str, DataFrame] = field(default_factory=dict)

    def panel(self) -> DataFrame:
        return profile.filter_panel(self.edges, self.class_col)

    def extent(self) -> DataFrame:
        return profile.extent(self.edges)

    def slots(self) -> DataFrame:
        return graph.annotation_slots(self.edges, self.settings.slot_m, self.class_col)

    def decks(self) -> DataFrame:
        return graph.bridge_decks(self.edges, self.settings.decks, self.class_col)

    def tile_layers(self, keep: Sequence[str] = (), packed: bool = False) -> list[DataFrame]:
        """The rows of every layer: the roads, clipped; from LABEL_ZOOM on the slots of names and arrows, whole; and each
        overlay, whole, under its name. packed: the roads as packed_rows."""
        o = self.settings.tiles
        flat = self.edges.drop("geometry", "a", "z")
        layers = [(tiles.packed_rows if packed else tiles.tile_rows)(flat, self.class_col, [self.class_col, *keep], self.settings.min_zoom, o)]
        late = {**o, "minzoom": max(o["minzoom"], min(LABEL_ZOOM, o["maxzoom"]))}
        slots = self.slots().withColumn("fid", F.col("chain"))
        for name, rows in (("names", graph.name_slots(slots)), ("arrows", graph.arrow_slots(slots))):
            layers.append(tiles.tile_rows(rows.drop("chain"), None, options=late, layer=name, whole=True))
        for name, df in self.overlays.items():
            layers.append(tiles.overlay_rows(df, name, o))
        return layers

    def tiles(self, keep: Sequence[str] = ()) -> DataFrame:
        return tiles.build_tiles(self.tile_layers(keep, packed=True), self.settings.tiles["extent"])

    def tile_extent(self) -> DataFrame:
        """One row: minx, miny, maxx, maxy over the edges and all overlays, as an archive's header has it."""
        boxes = profile.extent(self.edges)
        for df in self.overlays.values():
            boxes = boxes.unionByName(profile.extent(df.select(F.flatten("geometry.parts").alias("vertices"))))
        return boxes.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))

    def overlay_styles(self) -> DataFrame | None:
        """Each overlay's rows with their style, see ingest.overlay_style; None without overlays."""
        rows = None
        for i, (name, df) in enumerate(self.overlays.items()):
            styled = overlay_style(df, name, i)
            rows = styled if rows is None else rows.unionByName(styled)
        return rows

    def sidecar(self) -> DataFrame:
        return tiles.sidecar(self.edges.drop("vertices", "a", "z"))

    def overlay_catalog(self, spark: SparkSession) -> DataFrame:
        """(name, position, kind) of each overlay: one row each."""
        rows = None
        for i, (name, df) in enumerate(self.overlays.items()):
            row = overlay_kind(df).select(F.lit(name).alias("name"), F.lit(i).alias("position"), "kind")
            rows = row if rows is None else rows.unionByName(row)
        return rows if rows is not None else spark.createDataFrame([], "name string, position int, kind string")


def build(
    spark: SparkSession,
    data,
    class_col: str = "highway",
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    styler: styling.Styler | None = None,
    options: Mapping[str, styling.Styler] | None = None,
    color_table: DataFrame | Mapping | None = None,
    color_order: str | None = None,
    id_col: str = "edge_id",
    overlays: Mapping[str, object] | None = None,
    settings: Settings = DEFAULT,
    **read,
) -> Network:
    """Read, colour by table, filter, style, derive: in this order, so that a numeric range is that of the rows shown.
    color_order: the column of color_table whose greatest value counts where an id has several colours."""
    df = as_edges(data, spark, class_col=class_col, **read).df
    if color_table is not None:
        df = styling.join_colors(df, id_col, styling.color_rows(spark, color_table), order="__n" if isinstance(color_table, Mapping) else color_order)
        styler = styler or styling.ColorTableStyler("__color", class_col)
    df = filter_classes(df, class_col, include, exclude)
    if "fid" not in df.columns:
        df = with_ids(df, *([id_col] if id_col in df.columns else [class_col, "vertices"]))
    meta: list[dict] = []
    if options:
        df, meta = styling.bake_options(df, options, styler)
    else:
        df = styling.bake(df, styler or styling.ClassStyler(class_col, settings=settings))
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    df = df.withColumn("lvl", level(have("bridge"), have("tunnel"), have("layer")))
    df = graph.mark_twoway(graph.edge_nodes(df)).withColumn("draw_rank", draw_rank(F.col(class_col), F.col("lvl")))
    layers = {k: as_edges(v, spark, class_col=None, keep_non_lines=True).df for k, v in (overlays or {}).items()}
    return Network(df, class_col, settings, meta, layers)
