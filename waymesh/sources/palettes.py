"""Palettes: class to line style, as dimension tables; reading, writing and registering them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "unclassified"
SCHEMA = "class string, fill string, width double, casing_width double, casing string, dash array<int>, opacity double"


@dataclass(frozen=True)
class LineStyle:
    fill: str
    width: float
    casing_width: float = 0.0
    casing: str | None = None
    dash: tuple[int, ...] | None = None
    opacity: float = 1.0

    def __post_init__(self) -> None:
        if not isinstance(self.fill, str) or not self.fill:
            raise ValueError("a style needs a fill colour")
        if self.width < 0 or self.casing_width < 0 or not 0 <= self.opacity <= 1:
            raise ValueError("widths can't be negative, and opacity is between 0 and 1")


def _plain(rows: dict[str, tuple]) -> dict[str, LineStyle]:
    return {k: LineStyle(*v) for k, v in rows.items()}


#: Class: fill, width, casing width, casing, dash.
PALETTES: dict[str, dict[str, LineStyle]] = {
    "highsat": _plain(
        {
            "motorway": ("#00E5FF", 6.0, 8.0, "#bcbcbc"),
            "trunk": ("#FF007F", 5.5, 7.5, "#bcbcbc"),
            "primary": ("#FF9100", 4.5, 6.5, "#bcbcbc"),
            "secondary": ("#FFEA00", 3.5, 5.5, "#bcbcbc"),
            "tertiary": ("#00E676", 2.5, 4.5, "#bcbcbc"),
            "unclassified": ("#FFFFFF", 2.0, 4.0, "#bcbcbc"),
            "residential": ("#FFFFFF", 2.0, 4.0, "#bcbcbc"),
            "living_street": ("#DDDDDD", 2.0),
            "pedestrian": ("#DDDDDD", 1.5),
            "service": ("#F0F0F0", 1.0),
            "track": ("#9E7B54", 1.5),
            "cycleway": ("#2980B9", 1.5, 0.0, None, (6, 4)),
            "footway": ("#D98880", 1.5, 0.0, None, (4, 4)),
            "path": ("#D98880", 1.5, 0.0, None, (4, 4)),
        }
    ),
    "carto": _plain(
        {
            "motorway": ("#e892a2", 6.0, 8.0, "#dc2a48"),
            "trunk": ("#f9b29c", 5.5, 7.5, "#c84e2f"),
            "primary": ("#fcd6a4", 4.5, 6.5, "#a06b00"),
            "secondary": ("#f7fabf", 3.5, 5.5, "#707d00"),
            "tertiary": ("#ffffff", 2.5, 4.0, "#bcbcbc"),
            "unclassified": ("#ffffff", 2.0, 3.5, "#bcbcbc"),
            "residential": ("#ffffff", 2.0, 3.5, "#bcbcbc"),
            "living_street": ("#ededed", 1.8, 3.0, "#cccccc"),
            "service": ("#ffffff", 1.2, 2.2, "#d4d4d4"),
            "track": ("#9e7b54", 1.5, 1.5, "#9e7b54", (4, 4)),
            "cycleway": ("#5c7cb6", 1.2, 1.2, "#5c7cb6", (3, 3)),
            "footway": ("#C59D9D", 1.2, 1.2, "#C59D9D", (4, 4)),
            "path": ("#C59D9D", 1.2, 1.2, "#C59D9D", (2, 5)),
        }
    ),
    "mono": _plain(
        {
            "motorway": ("#707070", 6.0, 8.0, "#3c3c3c"),
            "trunk": ("#7a7a7a", 5.5, 7.5, "#444444"),
            "primary": ("#8a8a8a", 4.5, 6.5, "#4f4f4f"),
            "secondary": ("#9c9c9c", 3.5, 5.5, "#5c5c5c"),
            "tertiary": ("#b0b0b0", 2.5, 4.5, "#6e6e6e"),
            "unclassified": ("#c4c4c4", 2.0, 3.5, "#828282"),
            "residential": ("#c4c4c4", 2.0, 3.5, "#828282"),
            "living_street": ("#d4d4d4", 1.8, 3.0, "#9a9a9a"),
            "service": ("#e4e4e4", 1.2, 2.2, "#bcbcbc"),
            "track": ("#9a9a9a", 1.5, 1.5, "#9a9a9a", (4, 4)),
            "cycleway": ("#888888", 1.2, 1.2, "#888888", (3, 3)),
            "footway": ("#ABABAB", 1.2, 1.2, "#ABABAB", (4, 4)),
            "path": ("#ABABAB", 1.2, 1.2, "#ABABAB", (2, 5)),
        }
    ),
}

Palette = str | Mapping[str, LineStyle]


def palette_styles(palette: Palette) -> Mapping[str, LineStyle]:
    if not isinstance(palette, str):
        return palette
    if palette not in PALETTES:
        raise ValueError(f"unknown palette {palette!r}; choose from {list(PALETTES)}")
    return PALETTES[palette]


def register_palette(name: str, styles: Mapping[str, LineStyle]) -> None:
    if not styles or not all(isinstance(s, LineStyle) for s in styles.values()):
        raise ValueError("a palette maps classes to LineStyle")
    PALETTES[name] = dict(styles)


def palette_table(spark: SparkSession, palette: Palette) -> DataFrame:
    """The palette as rows of SCHEMA, keyed by class."""
    rows = [(k, s.fill, float(s.width), float(s.casing_width), s.casing, list(s.dash) if s.dash else None, float(s.opacity)) for k, s in palette_styles(palette).items()]
    return spark.createDataFrame(rows, SCHEMA)


def palette_from_dict(obj: Mapping) -> tuple[str | None, dict[str, LineStyle]]:
    """(name, styles) of {"name", "roads": {class: style}}, or of a bare {class: style}."""
    styles = {}
    for k, v in obj.get("roads", obj).items():
        v = dict(v)
        if "casing_dark" in v:
            v.setdefault("casing", v.pop("casing_dark"))
        unknown = set(v) - {"fill", "width", "casing_width", "casing", "dash", "opacity"}
        if unknown:
            raise ValueError(f"unknown style fields {sorted(unknown)}")
        v["dash"] = tuple(v["dash"]) if v.get("dash") else None
        styles[k] = LineStyle(**v)
    return obj.get("name"), styles


def palette_to_dict(name: str, palette: Palette) -> dict:
    return {"name": name, "roads": {k: {f: list(x) if isinstance(x, tuple) else x for f, x in asdict(s).items()} for k, s in palette_styles(palette).items()}}


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_palette(spark: SparkSession, path: str, register: bool = False) -> dict[str, LineStyle]:
    """From JSON at any path that Spark reads."""
    name, styles = palette_from_dict(json.loads(_text(spark, path)))
    if register:
        if not name:
            raise ValueError("a palette needs a name to be registered")
        register_palette(name, styles)
    return styles


def save_palette(spark: SparkSession, name: str, palette: Palette, path: str) -> None:
    spark.createDataFrame([(json.dumps(palette_to_dict(name, palette)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
