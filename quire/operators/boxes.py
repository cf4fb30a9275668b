"""Filters and merges of positioned text boxes of a page."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

PAGE = ["doc_id", "page_num"]


def filter_image_text(blocks: DataFrame, images: DataFrame, overlap: float = 0.70, inner_overlap: float = 0.25, background: float = 0.85, flip_y: bool = True) -> DataFrame:
    """Drop blocks that lie in an image; images that cover the page are ignored.

    ``images``: doc_id, page_num, x0, y0, x1, y1 (points), page_width, page_height (points), dpi. An equi join on the
    page with a residual condition (left anti), so Spark stops at the first hit and never compares across pages.
    """
    i = g.box()
    page_area = F.when((F.col("page_width") > 0) & (F.col("page_height") > 0), F.col("page_width") * F.col("page_height")).otherwise(F.lit(0.0))
    front = images.where(~((page_area > 0) & (F.try_divide(i.area, page_area) > background)))
    pad = F.greatest(F.lit(4.0), F.col("dpi") * F.lit(0.01))
    scaled = g.expand(g.points_to_pixels(i, F.col("dpi"), F.col("page_height"), flip_y), pad)
    front = front.select(*PAGE, *(c.alias(f"i_{n}") for n, c in zip(("x0", "y0", "x1", "y1"), scaled)))
    a, b = g.box(), g.box("i_")
    share = g.overlap_of_first(a, b)
    hit = (share >= overlap) | (g.center_inside(a, b) & (share >= inner_overlap))
    on = [blocks[k] == front[k] for k in PAGE]
    return blocks.join(front, on[0] & on[1] & hit, "left_anti")


def pages_needing_ocr(pages: DataFrame, blocks: DataFrame, char_threshold: int = 20) -> DataFrame:
    """Pages whose blocks hold fewer than ``char_threshold`` characters, blockless pages included: doc_id, page_num, n_chars."""
    chars = blocks.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("n"))
    joined = pages.select(*PAGE).join(chars, PAGE, "left").withColumn("n_chars", F.coalesce("n", F.lit(0)).cast("bigint"))
    return joined.where(F.col("n_chars") < char_threshold).select(*PAGE, "n_chars")


def dedup_image_boxes(images: DataFrame, least: float = 24.0, order: str = "image_idx") -> DataFrame:
    """Image boxes of at least 24 by 24 points; of boxes equal to a tenth of a point the first stays."""
    a = g.box()
    keys = [F.round(F.col(c), 1) for c in ("x0", "y0", "x1", "y1")]
    first = F.row_number().over(Window.partitionBy(*PAGE, *keys).orderBy(order))
    return images.where((a.width >= least) & (a.height >= least)).withColumn("_n", first).where("_n = 1").drop("_n")


Block = tuple[float, float, float, float, str, str, float]  # box, text, source, font size
BLOCK_COLUMNS = ["x0", "y0", "x1", "y1", "text", "source", "font_size"]


def _by_page(blocks: DataFrame, fold: Callable[[list[Block]], list[Block]]) -> DataFrame:
    """``fold`` over the boxes of each page in order (y0, x0): doc_id, page_num, block_idx, box, text, source, font_size. One shuffle."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("y0", "x0", "block_idx")])
        rows = fold(list(zip(*(part.column(c).to_pylist() for c in BLOCK_COLUMNS))))
        n = len(rows)
        kinds = [pa.float64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.Table.from_arrays([*(pa.array([part.column(c)[0].as_py()] * n, pa.int64()) for c in PAGE), pa.array(range(n), pa.int32()), *columns], [*PAGE, "block_idx", *BLOCK_COLUMNS])

    own = blocks.select(*PAGE, "block_idx", "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text"), "source", "font_size")
    return own.groupBy(*PAGE).applyInArrow(run, "doc_id bigint, page_num bigint, block_idx int, x0 double, y0 double, x1 double, y1 double, text string, source string, font_size double")


def merge_neighbours(rows: list[Block], x_gap: float = 5.0, y_within: float = 3.0) -> list[Block]:
    out: list[Block] = []
    for b in rows:
        if out:
            last = out[-1]
            if abs(b[1] - last[1]) < y_within and abs(b[3] - last[3]) < y_within and 0 < b[0] - last[2] < x_gap:
                out[-1] = (last[0], min(last[1], b[1]), max(last[2], b[2]), max(last[3], b[3]), last[4] + b[4], last[5], 0.0)
                continue
        out.append(b)
    return out


def merge_horizontally(blocks: DataFrame, x_gap: float = 5.0, y_within: float = 3.0) -> DataFrame:
    """Join neighbours on one line whose gap is positive and below ``x_gap``; judged against the box merged so far.

    A merged box has no font size.
    """
    return _by_page(blocks, lambda rows: merge_neighbours(rows, x_gap, y_within))


def drop_doubles(rows: list[Block], threshold: float = 0.3) -> list[Block]:
    """The sweep of ``merge_engines``: boxes that end above the current one are no longer compared."""
    kept: list[Block] = []
    near: list[int] = []
    for b in rows:
        near = [k for k in near if kept[k][3] > b[1]]
        for k in near:
            a = kept[k]
            wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
            if wide > 0 and high > 0 and least > 0 and wide * high / least > threshold:
                if len(b[4]) > len(a[4]):
                    kept[k] = b
                break
        else:
            near.append(len(kept))
            kept.append(b)
    return kept


def merge_engines(blocks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Union of recognition engines without doubles: of boxes that overlap by more than ``threshold`` of the smaller, the longer text stays.

    Boxes are taken in order (y0, x0); each is compared with the boxes kept so far, and a longer text replaces the
    first that it overlaps in place.
    """
    return _by_page(blocks, lambda rows: drop_doubles(rows, threshold))


def page_sizes(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Page size in the unit of the page's blocks: pixels as soon as one block is from OCR, else points.

    ``pages``: width and height in points, dpi.
    """
    kinds = blocks.groupBy(*PAGE).agg(F.bool_or(F.col("source") == "ocr").alias("has_ocr"))
    s = F.when(F.coalesce("has_ocr", F.lit(False)), F.col("dpi") / F.lit(72.0)).otherwise(F.lit(1.0))
    return pages.join(kinds, PAGE, "left").select(*PAGE, (F.col("width") * s).alias("width"), (F.col("height") * s).alias("height"))


def keep_native_if_no_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR blocks of the pages that have some, native blocks of all others."""
    return ocr.unionByName(native.join(ocr.select(*PAGE).distinct(), PAGE, "left_anti"))


def read_spans(spans: DataFrame) -> DataFrame:
    """Native blocks from text spans (doc_id, page_num, block_idx, block_kind, span_idx, text, size, box): text blocks only, empties dropped."""
    from ..functions.text import ordered_concat, strip

    rows = spans.where("block_kind = 0").groupBy(*PAGE, "block_idx").agg(strip(ordered_concat(F.col("span_idx"), F.col("text"))).alias("text"), F.bround(F.max("size"), 1).alias("font_size"), *g.union_box())
    return rows.where("text != ''").withColumns({"source": F.lit("native"), "block_type": F.lit("text")})
