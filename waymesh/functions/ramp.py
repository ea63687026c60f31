"""Colour ramps: values to hex colours over evenly spaced stops, and class breaks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymesh.functions.geometry import let
from waymesh.functions.scalars import clamp01, to_hex

MISSING_COLOR = "#cccccc"
#: Evenly spaced stops of the named ramps. A list of colours can be given instead of a name.
RAMPS: dict[str, tuple[str, ...]] = {
    "viridis": ("#440154", "#472d7b", "#3b528b", "#2c728e", "#21918c", "#28ae80", "#5ec962", "#addc30", "#fde725"),
    "plasma": ("#0d0887", "#4c02a1", "#7e03a8", "#a92395", "#cc4778", "#e66c5c", "#f89540", "#fdc527", "#f0f921"),
    "magma": ("#000004", "#1d1147", "#51127c", "#832681", "#b73779", "#e75263", "#fc8961", "#fec488", "#fcfdbf"),
    "cividis": ("#00224e", "#1e3a6f", "#434e6c", "#61656f", "#7d7c78", "#9b9476", "#bcae6c", "#dfca59", "#fee838"),
    "greys": ("#ffffff", "#d9d9d9", "#bdbdbd", "#737373", "#252525"),
    "inferno": ("#000004", "#210c4a", "#57106e", "#8a226a", "#bc3754", "#e45a31", "#f98e09", "#f9cb35", "#fcffa4"),
    "turbo": ("#30123b", "#4675ed", "#1bcfd5", "#61fc6c", "#d1e935", "#fe9b2d", "#d93807", "#7a0403"),
    "ylorrd": ("#ffffcc", "#ffeda0", "#fed976", "#feb24c", "#fd8d3c", "#fc4e2a", "#e31a1c", "#bd0026", "#800026"),
    "ylgnbu": ("#ffffd9", "#edf8b1", "#c7e9b4", "#7fcdbb", "#41b6c4", "#1d91c0", "#225ea8", "#253494", "#081d58"),
    "ylorbr": ("#ffffe5", "#fff7bc", "#fee391", "#fec44f", "#fe9929", "#ec7014", "#cc4c02", "#993404", "#662506"),
    "rdylgn": ("#d73027", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#d9ef8b", "#a6d96a", "#66bd63", "#1a9850"),
    "rdylbu": ("#d73027", "#f46d43", "#fdae61", "#fee090", "#ffffbf", "#e0f3f8", "#abd9e9", "#74add1", "#4575b4"),
    "rdbu": ("#b2182b", "#d6604d", "#f4a582", "#fddbc7", "#f7f7f7", "#d1e5f0", "#92c5de", "#4393c3", "#2166ac"),
    "spectral": ("#d53e4f", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#e6f598", "#abdda4", "#66c2a5", "#3288bd"),
    "blues": ("#f7fbff", "#deebf7", "#c6dbef", "#9ecae1", "#6baed6", "#4292c6", "#2171b5", "#08519c", "#08306b"),
    "greens": ("#f7fcf5", "#e5f5e0", "#c7e9c0", "#a1d99b", "#74c476", "#41ab5d", "#238b45", "#006d2c", "#00441b"),
    "oranges": ("#fff5eb", "#fee6ce", "#fdd0a2", "#fdae6b", "#fd8d3c", "#f16913", "#d94801", "#a63603", "#7f2704"),
    "purples": ("#fcfbfd", "#efedf5", "#dadaeb", "#bcbddc", "#9e9ac8", "#807dba", "#6a51a3", "#54278f", "#3f007d"),
    "reds": ("#fff5f0", "#fee0d2", "#fcbba1", "#fc9272", "#fb6a4a", "#ef3b2c", "#cb181d", "#a50f15", "#67000d"),
    "coolwarm": ("#3b4cc0", "#7b9ff9", "#c0d4f5", "#dddddd", "#f2cbb7", "#ee8468", "#b40426"),
}


def ramp_stops(ramp: str | Sequence[str]) -> tuple[str, ...]:
    """Of a name (any case, with or without a count of classes such as _09, a unique prefix will do) or a list of at least
    two colours."""
    if not isinstance(ramp, str):
        if len(ramp) < 2:
            raise ValueError("a ramp needs two colours or more")
        return tuple(ramp)
    name = ramp.lower()
    reverse = name.endswith("_r")
    name = re.sub(r"_\d+$", "", name.removesuffix("_r"))
    found = [name] if name in RAMPS else [k for k in RAMPS if name and k.startswith(name)]
    if len(found) != 1:
        raise ValueError(f"unknown ramp {ramp!r}; choose from {sorted(RAMPS)} or give a list of hex colours")
    return RAMPS[found[0]][::-1] if reverse else RAMPS[found[0]]


def sample(ramp: str | Sequence[str], n: int) -> list[str]:
    """n evenly spaced colours, two at least."""
    stops, n = ramp_stops(ramp), max(n, 2)
    channels = [[int(s[i : i + 2], 16) for i in (1, 3, 5)] for s in stops]
    out = []
    for i in range(n):
        at = i / (n - 1) * (len(stops) - 1)
        low = min(int(at), len(stops) - 2)
        out.append("#" + "".join(f"{int(a + (b - a) * (at - low) + 0.5):02x}" for a, b in zip(channels[low], channels[low + 1])))
    return out


def ramp_position(value: Column, low: Column, high: Column, ramp: str | Sequence[str]) -> Column:
    """Where a value stands between low and high, counted in the ramp's stops; null for null."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.when(value.isNotNull(), clamp01((value - low) / span) * (len(ramp_stops(ramp)) - 1))


def color_at(at: Column, ramp: str | Sequence[str], missing: str = MISSING_COLOR) -> Column:
    """The colour at a position. `at` is mentioned often, so it should be a column, not an expression."""
    stops = ramp_stops(ramp)
    lower = F.least(F.floor(at).cast("int"), F.lit(len(stops) - 2))
    channels = []
    for i in range(3):
        levels = F.array(*[F.lit(int(s[1 + 2 * i : 3 + 2 * i], 16)) for s in stops])
        a, b = F.element_at(levels, lower + 1), F.element_at(levels, lower + 2)
        channels.append(F.floor(a + (b - a) * (at - lower) + 0.5))
    return F.when(at.isNull(), F.lit(missing)).otherwise(to_hex(*channels))


def ramp_color(value: Column, low: Column, high: Column, ramp: str | Sequence[str], missing: str = MISSING_COLOR) -> Column:
    """The colour of a value between low and high. Values outside take the end colours; null takes missing. With no span
    a value above low is the last colour."""
    return let(ramp_position(value, low, high, ramp), lambda at: color_at(at, ramp, missing))
