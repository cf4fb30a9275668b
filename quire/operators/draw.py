"""Draw commands of a translated page, and the masks to clear before drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fit
from ..functions import geometry as g
from ..functions.text import is_blank, strip

PAGE = ["doc_id", "page_num"]


def inpaint_masks(lines: DataFrame) -> DataFrame:
    """Pixel rectangles to clear: line boxes grown by int(2 * dpi / 72) and clipped to the image; radius clamp(int(3 * dpi / 72), 1, 10).

    ``lines``: box, dpi, image_width, image_height (pixels).
    """
    pad = (F.col("dpi") * F.lit(2.0) / F.lit(72.0)).cast("int")
    rows = lines.withColumns({
        "mx0": F.greatest(F.lit(0), F.col("x0").cast("int") - pad), "my0": F.greatest(F.lit(0), F.col("y0").cast("int") - pad),
        "mx1": F.least(F.col("image_width").cast("int"), F.col("x1").cast("int") + pad), "my1": F.least(F.col("image_height").cast("int"), F.col("y1").cast("int") + pad),
        "radius": F.least(F.greatest(F.lit(1), (F.col("dpi") * F.lit(3.0) / F.lit(72.0)).cast("int")), F.lit(10)),
    })
    return rows.where("mx1 > mx0 and my1 > my0")


def median_font(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median of the line fonts of each group, 10 if there is none. ``lines``: box, dpi."""
    height = g.pixels_to_points(F.col("y1") - F.col("y0"), F.col("dpi"))
    return lines.groupBy(*keys).agg(g.upper_median(F.when(height >= 2, fit.line_font(height)), 10.0).cast("int").alias("font"))


def cluster_frames(clusters: DataFrame) -> DataFrame:
    """Outline rectangles of clusters in points, layer 0; those under 4 points are left out. ``clusters``: box, dpi."""
    a = g.Box(*(g.pixels_to_points(c, F.col("dpi")) for c in g.box()))
    return clusters.select(*PAGE, F.col("cluster_idx").alias("item_idx"), F.lit("frame").alias("op"), F.lit(0).alias("layer"), *(c.alias(n) for n, c in zip(("px0", "py0", "px1", "py1"), a))).where("px1 - px0 >= 4 and py1 - py0 >= 4")


def line_frames(lines: DataFrame) -> DataFrame:
    """Outline rectangles of lines in points, layer 2; those under 2 points are left out."""
    a = g.Box(*(g.pixels_to_points(c, F.col("dpi")) for c in g.box()))
    return lines.select(*PAGE, F.col("line_no").alias("item_idx"), F.lit("line").alias("op"), F.lit(2).alias("layer"), *(c.alias(n) for n, c in zip(("px0", "py0", "px1", "py1"), a))).where("px1 - px0 >= 2 and py1 - py0 >= 2")


def text_commands(areas: DataFrame) -> DataFrame:
    """White ground and text lines of translated areas, layer 1.

    ``areas``: doc_id, page_num, item_idx, box, dpi, font, translation. The text is fitted into the box drawn in by 3
    points; areas with less than 4 points inside and blank translations draw nothing. Lines step by 1.25 sizes.
    """
    inner = g.usable(g.box(), F.col("dpi"))
    rows = areas.where(~is_blank(F.col("translation"))).withColumns({"_l": inner.x0, "_t": inner.y0, "_r": inner.x1, "_b": inner.y1}).where("_r - _l >= 4 and _b - _t >= 4")
    rows = rows.withColumn("_fit", fit.fit(strip(F.col("translation")), F.col("_r") - F.col("_l"), F.col("_b") - F.col("_t"), F.col("font")))
    pad = g.pixels_to_points(F.lit(3.0), F.col("dpi"))
    none = F.lit(None).cast("string")
    ground = rows.select(*PAGE, "item_idx", F.lit("ground").alias("op"), F.lit(1).alias("layer"), F.lit(-1).alias("line_no"), (F.col("_l") - pad).alias("x"), (F.col("_t") - pad).alias("y"), (F.col("_r") + pad).alias("x1"), (F.col("_b") + pad).alias("y1"), F.lit(0).alias("font"), none.alias("text"))
    lines = rows.select("*", F.posexplode("_fit.lines").alias("line_no", "line")).where(~is_blank(F.col("line")))
    font = F.col("_fit.font")
    words = lines.select(*PAGE, "item_idx", F.lit("text").alias("op"), F.lit(1).alias("layer"), "line_no", F.col("_l").alias("x"), (F.col("_t") + font + F.col("line_no") * font * fit.LINE_SPACING).alias("y"), F.lit(None).cast("double").alias("x1"), F.lit(None).cast("double").alias("y1"), font.alias("font"), F.col("line").alias("text"))
    return ground.unionByName(words)


def page_modes(pages: DataFrame, lines: DataFrame, debug: bool = False, disable_inpaint: bool = True) -> DataFrame:
    """How each page gets onto the output: copied, rasterised or inpainted."""
    boxes = lines.select(*PAGE).distinct().withColumn("_has", F.lit(True))
    has = F.coalesce("_has", F.lit(False))
    mode = F.when(F.lit(debug), "raster").when(has & ~F.lit(disable_inpaint), "inpaint").when(has, "raster").otherwise("copy")
    return pages.join(boxes, PAGE, "left").select(*PAGE, mode.alias("page_mode"))
