"""Styling of streams. The row-wise operators work on a stream as they are; ranges and counts need a window or fixed
bounds. An extension: there is no streaming in what this engine follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.filters import filter_classes
from waymesh.operators.styling import ClassStyler, NumericStyler, Styler, bake


def style_stream(stream: DataFrame, styler: Styler, class_col: str, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """Filter and style, stateless. A numeric styler needs both vmin and vmax, as a stream has no range."""
    if isinstance(styler, NumericStyler) and (styler.vmin is None or styler.vmax is None or styler.width_by):
        raise ValueError("on a stream a numeric styler needs vmin and vmax, and no width_by")
    return bake(filter_classes(stream, class_col, include, exclude), styler)


def class_counts_by_window(stream: DataFrame, class_col: str, time_col: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(start, class, n): edges per class and time window; rows later than the watermark are dropped."""
    marked = stream.withWatermark(time_col, late).filter(F.col(class_col).isNotNull())
    return marked.groupBy(F.window(time_col, window).alias("w"), F.col(class_col).alias("class")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "class", "n")


def class_style_stream(stream: DataFrame, class_col: str, palette: str = "highsat") -> DataFrame:
    return style_stream(stream, ClassStyler(class_col, palette), class_col)
