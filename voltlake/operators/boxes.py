"""Joins of boxes: rectangles on cells, midpoints in boxes, positions zipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.geo import overlap


def marked(cells: DataFrame, rects: DataFrame, page: list[str], share: float = 0.55) -> DataFrame:
    """Cells (x0, x1, top, bottom) that some rectangle of their page overlaps by more than ``share`` of the cell's width and
    height. An equi-join on the page carries the range test, as a semi join."""
    r = rects.select(*[F.col(p).alias(f"_{p}") for p in page], *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "top", "bottom")])
    same = [F.col(p) == F.col(f"_{p}") for p in page]
    wide = overlap(F.col("x0"), F.col("x1"), F.col("_x0"), F.col("_x1")) > share * (F.col("x1") - F.col("x0"))
    tall = overlap(F.col("top"), F.col("bottom"), F.col("_top"), F.col("_bottom")) > share * (F.col("bottom") - F.col("top"))
    on = wide & tall
    for s in same:
        on = s & on
    return cells.join(r, on, "left_semi")


def in_boxes(glyphs: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Each glyph with the boxes of its page that hold its midpoint (left and top edges included)."""
    b = boxes.withColumnsRenamed({c: f"b_{c}" for c in ("x0", "x1", "top", "bottom")})
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return glyphs.join(b, page).where((F.col("b_x0") <= x) & (x < F.col("b_x1")) & (F.col("b_top") <= y) & (y < F.col("b_bottom")))


def zipped(left: Column, right: Column) -> Column:
    """Pairs by position, or null if the lengths differ; null entries on the left are skipped."""
    pairs = F.filter(F.arrays_zip(left.alias("a"), right.alias("b")), lambda p: p["a"].isNotNull())
    return F.when(F.size(left) == F.size(right), pairs)
