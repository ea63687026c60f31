"""Scalar functions on classes, flags, numbers and colours. All stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SAFE_INT = (1 << 53) - 1


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def key_text(c: Column) -> Column:
    """The form in which values are looked up: text, stripped, lower case; null is empty."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def base_class(c: Column) -> Column:
    """A class without its _link suffix. Unknown classes stay as they are; the palette lookup has the fallback."""
    return F.regexp_replace(key_text(c), "_link$", "")


def is_link(c: Column) -> Column:
    return key_text(c).endswith("_link")


def as_number(c: Column, kind: T.DataType) -> Column:
    """A finite double, or null: text that reads as a decimal number counts, true and false are 1 and 0."""
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.StringType):
        c = F.when(strip(c).rlike(_NUMBER), strip(c))
        c = c.try_cast("double")
    else:
        c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def flag_for_style(c: Column) -> Column:
    """Tunnel and bridge flags of the class style: yes, true, 1, y or t in any case."""
    return F.coalesce(key_text(c).isin("yes", "true", "1", "y", "t"), F.lit(False))


def flag_for_web(c: Column, kind: T.DataType | None = None) -> Column:
    """Flags of the derived columns: anything but null, "", "no", "false", "0" and zero. Case counts, so "No" is set."""
    if kind is not None and isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(~c.cast("string").isin("", "no", "false", "0"), F.lit(False))


def flag_for_gpu(c: Column) -> Column:
    """Flags of the array output: yes, true or 1."""
    return F.coalesce(key_text(c).isin("yes", "true", "1"), F.lit(False))


def color_or(c: Column, fallback: str) -> Column:
    """A literal colour, stripped; fallback where it is null or blank."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(fallback))


def dash_text(c: Column) -> Column:
    """array<int> as "on,off"; null for null and empty arrays."""
    return F.when(F.size(c) > 0, F.array_join(c.cast("array<string>"), ","))


def hex_channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")


def rgba(c: Column, alpha: Column) -> Column:
    """#rrggbb as [r, g, b, a]; null is black."""
    c = F.coalesce(c, F.lit("#000000"))
    return F.array(hex_channel(c, 0), hex_channel(c, 1), hex_channel(c, 2), alpha.cast("int"))


def to_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("bigint")), 2, "0")) for x in (red, green, blue)])


def level(bridge: Column, tunnel: Column, layer: Column) -> Column:
    """Elevation of an edge: of a bridge its layer but at least 1, of a tunnel its layer but at most -1, of others a
    negative layer or 0. A layer that isn't a number counts as 0; decimals are cut off."""
    number = F.when(strip(layer.cast("string")).rlike(_NUMBER), strip(layer.cast("string"))).try_cast("double")
    whole = F.coalesce(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int"), F.lit(0))
    return F.when(flag_for_web(bridge), F.greatest(F.lit(1), whole)).when(flag_for_web(tunnel), F.least(F.lit(-1), whole)).otherwise(F.least(whole, F.lit(0)))


def exact_text(c: Column) -> Column:
    """An integer that JSON readers would round, as text; others as they are, also as text."""
    return F.when(F.abs(c) > SAFE_INT, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))


def short_number(c: Column) -> Column:
    """Ticks of a legend: thousands separated, at most two decimals, no trailing zeros."""
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.regexp_replace(F.regexp_replace(F.format_number(c, 2), "0+$", ""), r"\.$", ""))


def is_set(c: Column) -> Column:
    """Whether a field counts as set in the search: not blank, nan, no, false, none or 0."""
    return F.coalesce(~key_text(c).isin("", "nan", "no", "false", "none", "0"), F.lit(False))
