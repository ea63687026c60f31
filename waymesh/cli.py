"""Command line: style an edge file and write it.

    spark-submit -m waymesh.cli IN OUT --format geojsonl|geojson|spec|parquet|tiles|pmtiles [--class-col C] [--palette P] ...
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from waymesh.operators.filters import filter_classes
from waymesh.operators.styling import bake, build_styler
from waymesh.sources.basemaps import BASEMAPS, DEFAULT_BASEMAP
from waymesh.sources.ingest import read_edges, with_ids
from waymesh.sources.palettes import PALETTES, load_palette
from waymesh.sources.sinks import save_spec, to_geojson, to_spec, write_geojson_lines, write_tiles


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymesh")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-f", "--format", choices=("geojsonl", "geojson", "spec", "parquet", "tiles", "pmtiles"), default="parquet", help="geojsonl: one feature a line, of any size; geojson and spec: one document; tiles: a table; pmtiles: one file")
    p.add_argument("--class-col", default="highway")
    p.add_argument("--palette", default="highsat", help=f"{', '.join(PALETTES)} or a JSON file")
    p.add_argument("--color-by")
    p.add_argument("--colors", type=json.loads, metavar="JSON", help='colours for the values of --color-by: {"a": "#ff0000"}')
    p.add_argument("--cmap")
    p.add_argument("--vmin", type=float)
    p.add_argument("--vmax", type=float)
    p.add_argument("--width-by", nargs=2, type=float, metavar=("MIN", "MAX"), help="widths that follow the number in --color-by")
    p.add_argument("--basemap", default=DEFAULT_BASEMAP, choices=tuple(BASEMAPS), help="of a spec")
    p.add_argument("--tooltip", nargs="+", metavar="COLUMN", help="of a spec")
    p.add_argument("--include", nargs="*")
    p.add_argument("--exclude", nargs="*")
    p.add_argument("--srid", type=int, default=4326)
    p.add_argument("--layer", help="of a GeoPackage")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("waymesh").getOrCreate()
    palette = load_palette(spark, a.palette) if a.palette.endswith(".json") else a.palette
    try:
        edges = read_edges(spark, a.input, a.class_col, srid=a.srid, layer=a.layer)
        styler = build_styler(palette=palette, class_col=a.class_col, color_by=a.color_by, colors=a.colors, cmap=a.cmap, vmin=a.vmin, vmax=a.vmax, width_by=tuple(a.width_by) if a.width_by else None)
    except Exception as e:  # a missing file or column: say so, as a command should
        print(f"waymesh: {e}", file=sys.stderr)
        return 2
    df = filter_classes(edges.df, a.class_col, a.include, a.exclude)
    if a.format == "spec":
        save_spec(spark, to_spec(df, styler, a.class_col, a.basemap, a.tooltip), a.output)
        return 0
    styled = bake(df, styler)
    if a.format == "geojsonl":
        write_geojson_lines(styled, a.output)
    elif a.format == "geojson":
        save_spec(spark, to_geojson(styled), a.output)
    elif a.format in ("tiles", "pmtiles"):
        from waymesh.operators.tiles import build_tiles, packed_rows
        from waymesh.sources.archive import write_archive

        rows = packed_rows(styled if "fid" in styled.columns else with_ids(styled, a.class_col, "vertices"), a.class_col, [a.class_col])
        (write_tiles if a.format == "tiles" else write_archive)(build_tiles([rows]), a.output)
    else:
        styled.drop("vertices").write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
