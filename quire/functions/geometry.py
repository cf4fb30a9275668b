"""Box geometry as column expressions. A box is four columns; ``box("a_")`` names a_x0, a_y0, a_x1, a_y1."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def x_center(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def y_center(self) -> Column:
        return (self.y0 + self.y1) / 2


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def _positive(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def horizontal_overlap(a: Box, b: Box) -> Column:
    return _positive(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))


def vertical_overlap(a: Box, b: Box) -> Column:
    return _positive(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def horizontal_gap(a: Box, b: Box) -> Column:
    """Signed distance from the right edge of ``a`` to the left edge of ``b``."""
    return b.x0 - a.x1


def vertical_gap(a: Box, b: Box) -> Column:
    return b.y0 - a.y1


def horizontal_separation(a: Box, b: Box) -> Column:
    return F.greatest(b.x0 - a.x1, a.x0 - b.x1, F.lit(0.0))


def vertical_separation(a: Box, b: Box) -> Column:
    return F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    """The common box, null unless it has an inside."""
    x0, y0, x1, y1 = F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def intersection_area(a: Box, b: Box) -> Column:
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    common = intersection_area(a, b)
    union = a.area + b.area - common
    return F.when(union > 0, F.try_divide(common, union)).otherwise(F.lit(0.0))


def overlap_min(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 where that is not positive."""
    least = F.least(a.area, b.area)
    return F.when(least > 0, F.try_divide(intersection_area(a, b), least)).otherwise(F.lit(0.0))


def overlap_of_first(a: Box, b: Box) -> Column:
    return F.when(a.area > 0, F.try_divide(intersection_area(a, b), a.area)).otherwise(F.lit(0.0))


def center_inside(a: Box, b: Box) -> Column:
    return a.x_center.between(b.x0, b.x1) & a.y_center.between(b.y0, b.y1)


def expand(a: Box, pad: Column) -> Box:
    return Box(a.x0 - pad, a.y0 - pad, a.x1 + pad, a.y1 + pad)


def points_to_pixels(a: Box, dpi: Column, page_height: Column, flip_y: bool = True) -> Box:
    """Points to pixels at ``dpi``; ``flip_y``: the box is counted from the lower edge of the page."""
    s = dpi / F.lit(72.0)
    if not flip_y:
        return Box(a.x0 * s, a.y0 * s, a.x1 * s, a.y1 * s)
    return Box(a.x0 * s, (page_height - a.y1) * s, a.x1 * s, (page_height - a.y0) * s)


def pixels_to_points(c: Column, dpi: Column) -> Column:
    return c * F.lit(72.0) / dpi


def usable(a: Box, dpi: Column, inset: float = 3.0) -> Box:
    """The box in points, drawn in by ``inset`` on all sides."""
    return Box(pixels_to_points(a.x0, dpi) + inset, pixels_to_points(a.y0, dpi) + inset, pixels_to_points(a.x1, dpi) - inset, pixels_to_points(a.y1, dpi) - inset)


def is_same_line(a: Box, b: Box, ratio: float = 0.3) -> Column:
    least = F.least(a.height, b.height)
    return F.coalesce((least > 0) & (F.try_divide(vertical_overlap(a, b), least) >= ratio), F.lit(False))


def is_aligned_left(a: Box, b: Box, within: float = 5.0) -> Column:
    return F.abs(a.x0 - b.x0) <= within


def is_aligned_right(a: Box, b: Box, within: float = 5.0) -> Column:
    return F.abs(a.x1 - b.x1) <= within


def font_estimate(font_size: Column, a: Box) -> Column:
    return F.when(font_size > 0, font_size).otherwise(a.height)


def diagonal(width: Column, height: Column) -> Column:
    return F.sqrt(width * width + height * height)


def layout_class(a: Box, page_width: Column, page_height: Column, font_size: Column, text_length: Column, n_lines: Column) -> Column:
    """header, footer, title, caption or body, by the first rule that holds."""
    font = F.when(font_size <= 0, a.height / F.greatest(F.lit(1), n_lines)).otherwise(font_size)
    diag = diagonal(page_width, page_height)
    relative = F.when(diag > 0, F.try_divide(font, diag)).otherwise(F.lit(0.0))
    flat = (page_height > 0) & (a.height < page_height * 0.06)
    return (
        F.when(flat & (a.y0 < page_height * 0.08), "header")
        .when(flat & (a.y1 > page_height * 0.92), "footer")
        .when((relative > 0.030) & (text_length < 120), "title")
        .when((n_lines <= 1) & (text_length < 80) & (relative < 0.020), "caption")
        .otherwise("body")
    )


def upper_median(values: Column, default: float = 12.0) -> Column:
    """Aggregate: the upper median of the positive values, ``default`` if there is none."""
    s = F.sort_array(F.collect_list(F.when(values > 0, values)))
    return F.coalesce(F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1), F.lit(default))


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates of the box around all boxes."""
    a = box(prefix)
    return [F.min(a.x0).alias("x0"), F.min(a.y0).alias("y0"), F.max(a.x1).alias("x1"), F.max(a.y1).alias("y1")]
