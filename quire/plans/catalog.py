"""Queries over the whole tables, one for each operator or group of operators, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fit
from ..functions import geometry as g
from ..functions import text as t
from ..session import shared_folder
from ..operators import boxes, draw, layout, simple, translate
from ..sources import pdf, store
from ..sources.tables import table
from . import stages
from ..streaming import pages as streams

PAGE = ["doc_id", "page_num"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query; whole numbers come out as bigint."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, base: str) -> DataFrame:
            df = f(spark, base)
            return df.select(*(F.col(c).cast("bigint") if k in ("int", "smallint") else F.col(c) for c, k in df.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _blocks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "blocks")


def _points(spark: SparkSession, base: str) -> DataFrame:
    return stages.page_points(table(spark, base, "ocr_pages"))


def _images(spark: SparkSession, base: str) -> DataFrame:
    """Image boxes derived from the pages, two each (whole numbers of points)."""
    rows = _points(spark, base).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    x0 = F.lit(40) + F.pmod(F.col("doc_id") * 37 + F.col("page_num") * 13 + F.col("k") * 211, F.lit(300))
    y0 = F.pmod(F.col("doc_id") * 53 + F.col("page_num") * 29 + F.col("k") * 397, F.lit(600))
    w, h = F.lit(160) + F.pmod("doc_id", F.lit(5)) * 20, F.lit(40) + F.pmod("doc_id", F.lit(4)) * 20
    return rows.select(*PAGE, F.col("k").alias("image_idx"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + w).cast("double").alias("x1"), (y0 + h).cast("double").alias("y1"), F.col("width").alias("page_width"), F.col("height").alias("page_height"), "dpi")


POINTS = """points AS (
  SELECT doc_id, page_num, dpi, status, width * (72.0::DOUBLE / dpi) AS width, height * (72.0::DOUBLE / dpi) AS height
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY saved_at DESC, loaded_at DESC, status DESC) AS n FROM ocr_pages) WHERE n = 1)"""
IMAGES = """images AS (
  SELECT doc_id, page_num, k AS image_idx, (40 + (doc_id * 37 + page_num * 13 + k * 211) % 300)::DOUBLE AS x0, ((doc_id * 53 + page_num * 29 + k * 397) % 600)::DOUBLE AS y0,
         (40 + (doc_id * 37 + page_num * 13 + k * 211) % 300 + 160 + (doc_id % 5) * 20)::DOUBLE AS x1, ((doc_id * 53 + page_num * 29 + k * 397) % 600 + 40 + (doc_id % 4) * 20)::DOUBLE AS y1,
         width AS page_width, height AS page_height, dpi
  FROM points, (VALUES (0), (1)) v(k))"""
COLUMNS = """col AS (
  SELECT *, sum(s) OVER (PARTITION BY doc_id, page_num ORDER BY x0, y0, block_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS column_no
  FROM (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY doc_id, page_num ORDER BY x0, y0, block_idx) > 50)::INT, 0) AS s FROM blocks))"""
PARAS = COLUMNS + """, par AS (
  SELECT *, sum(s2) OVER (PARTITION BY doc_id, page_num, column_no ORDER BY y0, x0, block_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS para_no
  FROM (SELECT *, coalesce((y0 - lag(y1) OVER w > greatest((lag(y1) OVER w - lag(y0) OVER w) * 1.5, 4.0))::INT, 0) AS s2 FROM col
        WINDOW w AS (PARTITION BY doc_id, page_num, column_no ORDER BY y0, x0, block_idx))), paragraphs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY column_no, para_no) - 1 AS para_idx FROM (
    SELECT doc_id, page_num, column_no, para_no, string_agg(coalesce(text, ''), '' ORDER BY y0, x0, block_idx) AS text,
           min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines,
           coalesce(avg(CASE WHEN font_size > 0 THEN font_size END), 0) AS font_size
    FROM par GROUP BY ALL))"""
SIZES = POINTS + """, kinds AS (SELECT doc_id, page_num, bool_or(source = 'ocr') AS has_ocr FROM blocks GROUP BY ALL), sizes AS (
  SELECT p.doc_id, p.page_num, width * CASE WHEN coalesce(has_ocr, false) THEN dpi / 72.0::DOUBLE ELSE 1.0 END AS width, height * CASE WHEN coalesce(has_ocr, false) THEN dpi / 72.0::DOUBLE ELSE 1.0 END AS height
  FROM points p LEFT JOIN kinds USING (doc_id, page_num))"""
MEDIANS = """medians AS (
  SELECT doc_id, page_num, CASE WHEN len(h) = 0 THEN 12.0 ELSE h[len(h) // 2 + 1] END AS median_height
  FROM (SELECT doc_id, page_num, coalesce(list(y1 - y0 ORDER BY y1 - y0) FILTER (y1 - y0 > 0), []) AS h FROM blocks GROUP BY ALL))"""
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


# --- scans and the page store ---------------------------------------------------------------------------------------


@query("SELECT doc_id, page_num, block_idx::BIGINT AS block_idx, x0, y0, x1, y1, text, source FROM blocks")
def blocks_scan(spark: SparkSession, base: str) -> DataFrame:
    """All blocks with the columns of the layout operators."""
    return _blocks(spark, base).select(*PAGE, "block_idx", "x0", "y0", "x1", "y1", "text", "source")


@query("SELECT doc_id, page_num, block_idx::BIGINT AS block_idx, text FROM blocks WHERE page_num BETWEEN 2 AND 5")
def page_range_scan(spark: SparkSession, base: str) -> DataFrame:
    """Blocks of a page range; the range is pushed to the scan."""
    return _blocks(spark, base).where(F.col("page_num").between(2, 5)).select(*PAGE, "block_idx", "text")


@query("SELECT doc_id, page_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_blocks FROM blocks GROUP BY ALL")
def page_extent(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(spark, base).groupBy(*PAGE).agg(*g.union_box(), F.count("*").alias("n_blocks"))


@query(f"WITH {POINTS} SELECT doc_id, page_num, dpi::BIGINT AS dpi, status, width, height FROM points")
def latest_pages(spark: SparkSession, base: str) -> DataFrame:
    return _points(spark, base).select(*PAGE, "dpi", "status", "width", "height")


LATEST_PARAGRAPHS = """latest AS (SELECT * EXCLUDE (n, last) FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, para_idx ORDER BY id DESC) AS n FROM (
    SELECT *, max(saved_at) OVER (PARTITION BY doc_id, page_num) AS last FROM ocr_paragraphs) WHERE saved_at IS NOT DISTINCT FROM last) WHERE n = 1)"""


@query(f"WITH {POINTS}, {LATEST_PARAGRAPHS} SELECT doc_id, page_num, p.status, l.para_idx::BIGINT AS para_idx, l.text, l.translated_text FROM points p JOIN latest l USING (doc_id, page_num) WHERE page_num BETWEEN 1 AND 4")
def store_batch(spark: SparkSession, base: str) -> DataFrame:
    """Saved pages 1 to 4 with their paragraphs, in one join."""
    rows = store.load_batch(table(spark, base, "ocr_pages"), table(spark, base, "ocr_paragraphs"), 1, 4)
    return rows.select(*PAGE, "status", "para_idx", "text", "translated_text")


@query(f"WITH {POINTS} SELECT doc_id, page_num FROM points WHERE status = 'ocr_done'")
def untranslated_pages(spark: SparkSession, base: str) -> DataFrame:
    return store.untranslated_pages(table(spark, base, "ocr_pages"))


@query("SELECT DISTINCT doc_id, page_num FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM ocr_paragraphs p WHERE p.doc_id = b.doc_id AND p.page_num = b.page_num)")
def pages_to_do(spark: SparkSession, base: str) -> DataFrame:
    """Pages with blocks that have no stored paragraph."""
    return store.pages_to_do(_blocks(spark, base).select(*PAGE).distinct(), table(spark, base, "ocr_paragraphs"))


@query("SELECT coalesce(max(page_num), 0) AS max_page FROM ocr_pages")
def max_page(spark: SparkSession, base: str) -> DataFrame:
    return store.max_page(table(spark, base, "ocr_pages"))


@query(f"WITH {POINTS} SELECT status, count(*) AS n_pages FROM points GROUP BY ALL")
def translate_status_summary(spark: SparkSession, base: str) -> DataFrame:
    return _points(spark, base).groupBy("status").agg(F.count("*").alias("n_pages"))


@query("SELECT doc_id, page_num, (page_num - 1) // 10 AS ocr_batch, (page_num - 1) // 3 AS translate_batch FROM (SELECT DISTINCT doc_id, page_num FROM ocr_pages)")
def page_batches(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "ocr_pages").select(*PAGE).distinct()
    rows = stages.page_batches(pages, 10).withColumnRenamed("batch_id", "ocr_batch")
    return stages.page_batches(rows, 3).withColumnRenamed("batch_id", "translate_batch")


# --- geometry ---------------------------------------------------------------------------------------------------------


@query("""SELECT block_id, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS x_center, (y0 + y1) / 2 AS y_center,
  CASE WHEN font_size > 0 THEN font_size ELSE y1 - y0 END AS font, x0 * 72.0::DOUBLE / coord_dpi AS x0_pt, x0 * 72.0::DOUBLE / coord_dpi + 3 AS left_pt, y1 * 72.0::DOUBLE / coord_dpi - 3 AS bottom_pt FROM blocks""")
def box_measures(spark: SparkSession, base: str) -> DataFrame:
    a, inner = g.box(), g.usable(g.box(), F.col("coord_dpi"))
    return _blocks(spark, base).select("block_id", a.width.alias("width"), a.height.alias("height"), a.area.alias("area"), a.x_center.alias("x_center"), a.y_center.alias("y_center"), g.font_estimate(F.col("font_size"), a).alias("font"), g.pixels_to_points(a.x0, F.col("coord_dpi")).alias("x0_pt"), inner.x0.alias("left_pt"), inner.y1.alias("bottom_pt"))


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    rows = _blocks(spark, base)
    cols = ["block_id", "x0", "y0", "x1", "y1"]
    a = rows.select(*PAGE, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = rows.select(*PAGE, *(F.col(c).alias(f"b_{c}") for c in cols))
    return a.join(b, PAGE).where("a_block_id < b_block_id")


INTER = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"


@query(f"""SELECT a.block_id AS a_id, b.block_id AS b_id, {INTER} AS common,
  CASE WHEN {AREA_A} + {AREA_B} - {INTER} > 0 THEN {INTER} / ({AREA_A} + {AREA_B} - {INTER}) ELSE 0 END AS iou,
  CASE WHEN least({AREA_A}, {AREA_B}) > 0 THEN {INTER} / least({AREA_A}, {AREA_B}) ELSE 0 END AS overlap_min,
  CASE WHEN {AREA_A} > 0 THEN {INTER} / {AREA_A} ELSE 0 END AS overlap_of_first
  FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.block_id < b.block_id WHERE {INTER} > 0""")
def overlapping_blocks(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of blocks of a page that overlap, with the three overlap measures."""
    a, b = g.box("a_"), g.box("b_")
    rows = _pairs(spark, base).withColumn("common", g.intersection_area(a, b)).where("common > 0")
    return rows.select(F.col("a_block_id").alias("a_id"), F.col("b_block_id").alias("b_id"), "common", g.iou(a, b).alias("iou"), g.overlap_min(a, b).alias("overlap_min"), g.overlap_of_first(a, b).alias("overlap_of_first"))


V_OVER = "greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
LEAST_H = "least(a.y1 - a.y0, b.y1 - b.y0)"


@query(f"""SELECT a.block_id AS a_id, b.block_id AS b_id, b.x0 - a.x1 AS h_gap, greatest(b.x0 - a.x1, a.x0 - b.x1, 0.0) AS h_sep, greatest(b.y0 - a.y1, a.y0 - b.y1, 0.0) AS v_sep,
  abs(a.x0 - b.x0) <= 5 AS left_aligned, abs(a.x1 - b.x1) <= 5 AS right_aligned
  FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.block_id < b.block_id WHERE {LEAST_H} > 0 AND {V_OVER} / {LEAST_H} >= 0.3""")
def same_line_pairs(spark: SparkSession, base: str) -> DataFrame:
    a, b = g.box("a_"), g.box("b_")
    rows = _pairs(spark, base).where(g.is_same_line(a, b))
    return rows.select(F.col("a_block_id").alias("a_id"), F.col("b_block_id").alias("b_id"), g.horizontal_gap(a, b).alias("h_gap"), g.horizontal_separation(a, b).alias("h_sep"), g.vertical_separation(a, b).alias("v_sep"), g.is_aligned_left(a, b).alias("left_aligned"), g.is_aligned_right(a, b).alias("right_aligned"))


@query(f"WITH {SIZES} SELECT doc_id, page_num, width, height FROM sizes")
def page_sizes(spark: SparkSession, base: str) -> DataFrame:
    """Page sizes in the unit of the blocks."""
    return boxes.page_sizes(_points(spark, base), _blocks(spark, base)).select(*PAGE, "width", "height")


@query(f"WITH {MEDIANS} SELECT doc_id, page_num, median_height FROM medians")
def median_line_height(spark: SparkSession, base: str) -> DataFrame:
    return _blocks(spark, base).groupBy(*PAGE).agg(g.upper_median(F.col("y1") - F.col("y0")).alias("median_height"))


# --- filters --------------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT p.doc_id, p.page_num, coalesce(n, 0)::BIGINT AS n_chars FROM points p LEFT JOIN (SELECT doc_id, page_num, sum(length(text)) AS n FROM blocks GROUP BY ALL) USING (doc_id, page_num) WHERE coalesce(n, 0) < 20")
def needs_ocr_pages(spark: SparkSession, base: str) -> DataFrame:
    return boxes.pages_needing_ocr(_points(spark, base), _blocks(spark, base))


@query(f"""WITH {POINTS}, {IMAGES}, near AS (SELECT * FROM images UNION ALL SELECT doc_id, page_num, image_idx + 2, x0 + 0.03, y0, x1, y1 - 0.02, page_width, page_height, dpi FROM images
  UNION ALL SELECT doc_id, page_num, image_idx + 4, x0, y0, x0 + 20, y1, page_width, page_height, dpi FROM images)
  SELECT doc_id, page_num, image_idx::BIGINT AS image_idx, x0, y0, x1, y1 FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, round(x0, 1), round(y0, 1), round(x1, 1), round(y1, 1) ORDER BY image_idx) AS n FROM near WHERE x1 - x0 >= 24 AND y1 - y0 >= 24) WHERE n = 1""")
def image_box_dedup(spark: SparkSession, base: str) -> DataFrame:
    """Image boxes found twice by two ways; small ones are dropped."""
    images = _images(spark, base)
    near = images.unionByName(images.withColumns({"image_idx": F.col("image_idx") + 2, "x0": F.col("x0") + 0.03, "y1": F.col("y1") - 0.02}))
    near = near.unionByName(images.withColumns({"image_idx": F.col("image_idx") + 4, "x1": F.col("x0") + 20}))
    return boxes.dedup_image_boxes(near).select(*PAGE, "image_idx", "x0", "y0", "x1", "y1")


@query(f"""WITH {POINTS}, {IMAGES}, front AS (SELECT doc_id, page_num, x0 * (dpi / 72.0::DOUBLE) - greatest(4.0::DOUBLE, dpi * 0.01::DOUBLE) AS x0, (page_height - y1) * (dpi / 72.0::DOUBLE) - greatest(4.0::DOUBLE, dpi * 0.01::DOUBLE) AS y0,
    x1 * (dpi / 72.0::DOUBLE) + greatest(4.0::DOUBLE, dpi * 0.01::DOUBLE) AS x1, (page_height - y0) * (dpi / 72.0::DOUBLE) + greatest(4.0::DOUBLE, dpi * 0.01::DOUBLE) AS y1 FROM images
    WHERE NOT coalesce(page_width > 0 AND page_height > 0 AND (x1 - x0) * (y1 - y0) / (page_width * page_height) > 0.85, false))
  SELECT block_id FROM blocks a WHERE NOT EXISTS (SELECT 1 FROM front b WHERE a.doc_id = b.doc_id AND a.page_num = b.page_num AND (
    (CASE WHEN {AREA_A} > 0 THEN {INTER} / {AREA_A} ELSE 0 END) >= 0.7 OR ((a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 AND (CASE WHEN {AREA_A} > 0 THEN {INTER} / {AREA_A} ELSE 0 END) >= 0.25)))""")
def image_text_filter(spark: SparkSession, base: str) -> DataFrame:
    """Blocks outside images."""
    return boxes.filter_image_text(_blocks(spark, base), _images(spark, base)).select("block_id")


# --- clustering -------------------------------------------------------------------------------------------------------


@query(f"WITH {COLUMNS} SELECT block_id, column_no FROM col")
def column_split(spark: SparkSession, base: str) -> DataFrame:
    return simple.split_columns(_blocks(spark, base)).select("block_id", "column_no")


@query(f"WITH {PARAS} SELECT doc_id, page_num, para_idx, column_no, text, x0, y0, x1, y1, n_lines FROM paragraphs")
def simple_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    """Blocks of each page to paragraphs by gaps."""
    return simple.simple_paragraphs(_blocks(spark, base)).select(*PAGE, "para_idx", "column_no", "text", "x0", "y0", "x1", "y1", "n_lines")


@query(f"WITH {PARAS} SELECT doc_id, page_num, para_idx AS cluster_idx, text, n_lines FROM paragraphs")
def paragraph_clusters(spark: SparkSession, base: str) -> DataFrame:
    return simple.one_cluster_each(simple.simple_paragraphs(_blocks(spark, base))).select(*PAGE, "cluster_idx", "text", "n_lines")


def _edges(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _blocks(spark, base)
    medians = rows.groupBy(*PAGE).agg(g.upper_median(F.col("y1") - F.col("y0")).alias("median_height"))
    paragraphs = simple.simple_paragraphs(rows)
    return paragraphs, medians, layout.merge_edges(paragraphs, medians)


def _floor(c: str) -> str:
    return f"greatest(1.0, {c})"


EDGE_RULE = f"""edges AS (SELECT a.doc_id, a.page_num, a.para_idx AS a_idx, b.para_idx AS b_idx FROM paragraphs a JOIN paragraphs b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.para_idx < b.para_idx
  JOIN medians m ON a.doc_id = m.doc_id AND a.page_num = m.page_num WHERE
  (CASE WHEN {AREA_A} + {AREA_B} - {INTER} > 0 THEN {INTER} / ({AREA_A} + {AREA_B} - {INTER}) ELSE 0 END) > 0.12 OR (CASE WHEN least({AREA_A}, {AREA_B}) > 0 THEN {INTER} / least({AREA_A}, {AREA_B}) ELSE 0 END) > 0.6
  OR (greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least({_floor('a.x1 - a.x0')}, {_floor('b.x1 - b.x0')}) >= 0.55 AND greatest(b.y0 - a.y1, a.y0 - b.y1, 0.0) <= greatest(6.0, median_height * 0.65::DOUBLE))
  OR ({V_OVER} / least({_floor('a.y1 - a.y0')}, {_floor('b.y1 - b.y0')}) >= 0.55 AND greatest(b.x0 - a.x1, a.x0 - b.x1, 0.0) <= greatest(8.0, median_height * 0.75::DOUBLE)))"""
EDGES = PARAS + ", " + MEDIANS + ", " + EDGE_RULE


@query(f"WITH {EDGES} SELECT doc_id, page_num, a_idx, b_idx FROM edges")
def merge_edges(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of paragraphs that belong together."""
    return _edges(spark, base)[2]


GROUPS = """both_ways AS (SELECT doc_id, page_num, a_idx AS a, b_idx AS b FROM edges UNION ALL SELECT doc_id, page_num, b_idx, a_idx FROM edges),
  reach AS (SELECT doc_id, page_num, para_idx, para_idx AS seen FROM paragraphs UNION SELECT r.doc_id, r.page_num, r.para_idx, e.b FROM reach r JOIN both_ways e ON r.doc_id = e.doc_id AND r.page_num = e.page_num AND r.seen = e.a),
  groups AS (SELECT doc_id, page_num, para_idx, min(seen) AS group_idx FROM reach GROUP BY ALL)"""


@query(f"WITH RECURSIVE {EDGES}, {GROUPS} SELECT doc_id, page_num, para_idx, group_idx FROM groups")
def paragraph_groups(spark: SparkSession, base: str) -> DataFrame:
    """Connected components of paragraphs: each with the smallest index of its group."""
    paragraphs, _, edges = _edges(spark, base)
    return layout.group_paragraphs(paragraphs, edges).select(*PAGE, "para_idx", "group_idx")


@query(f"""WITH RECURSIVE {EDGES}, {GROUPS} SELECT doc_id, page_num, group_idx, string_agg(coalesce(p.text, ''), '' ORDER BY p.y0, p.x0, para_idx, block_idx) AS text, min(p.x0) AS x0, min(p.y0) AS y0, max(p.x1) AS x1, max(p.y1) AS y1, count(*) AS n_lines
  FROM par p JOIN (SELECT doc_id, page_num, column_no, para_no, para_idx FROM paragraphs) q USING (doc_id, page_num, column_no, para_no) JOIN groups USING (doc_id, page_num, para_idx) GROUP BY ALL""")
def merged_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    """Text and box of each group of paragraphs."""
    rows = simple.split_paragraphs(simple.split_columns(_blocks(spark, base)))
    index = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("column_no", "para_no")) - 1
    paragraphs, medians, _ = _edges(spark, base)
    return layout.merged_paragraphs(rows.withColumn("para_idx", index), paragraphs, medians).select(*PAGE, "group_idx", "text", "x0", "y0", "x1", "y1", "n_lines")


def _gap_sql(axis: str) -> str:
    lo, hi, extent = f"{axis}0", f"{axis}1", "width" if axis == "x" else "height"
    factor, least = ("0.35", 4) if axis == "x" else ("0.8", 8)
    return SIZES + ", " + MEDIANS + f""", spans AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id, page_num ORDER BY s, e, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach, max(e) OVER (PARTITION BY doc_id, page_num) AS last_e,
    row_number() OVER (PARTITION BY doc_id, page_num ORDER BY s, e, block_idx) AS k FROM (
      SELECT b.doc_id, b.page_num, block_idx, greatest(0, trunc({lo})::BIGINT) AS s, least(greatest(1, trunc({extent})::BIGINT + 1), trunc({hi})::BIGINT + 1) AS e, greatest(1, trunc({extent})::BIGINT + 1) AS size,
        min({lo}) OVER p AS low, max({hi}) OVER p AS high, count(*) OVER p AS n FROM blocks b JOIN sizes USING (doc_id, page_num) WINDOW p AS (PARTITION BY b.doc_id, b.page_num)) WHERE s < e AND n > 1),
  gaps AS (SELECT doc_id, page_num, gap_start, gap_end FROM (SELECT doc_id, page_num, reach AS gap_start, s AS gap_end, low, high FROM spans WHERE s > reach UNION ALL SELECT doc_id, page_num, last_e, size, low, high FROM spans WHERE k = 1 AND last_e < size)
    JOIN medians USING (doc_id, page_num) WHERE gap_end - gap_start >= greatest({least}, trunc(median_height * {factor}::DOUBLE)::BIGINT) AND gap_end > low AND gap_start < high)"""


def _sizes(spark: SparkSession, base: str) -> DataFrame:
    return boxes.page_sizes(_points(spark, base), _blocks(spark, base))


@query(f"WITH {_gap_sql('x')} SELECT * FROM gaps")
def xcut_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Inner vertical gaps of each page."""
    return layout.page_gaps(_blocks(spark, base), _sizes(spark, base), "x")


@query(f"WITH {_gap_sql('y')} SELECT * FROM gaps")
def ycut_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Inner horizontal gaps of each page."""
    return layout.page_gaps(_blocks(spark, base), _sizes(spark, base), "y")


@query(f"WITH {_gap_sql('x')} SELECT b.block_id, (SELECT count(*) FROM gaps q WHERE q.doc_id = b.doc_id AND q.page_num = b.page_num AND (q.gap_start + q.gap_end) / 2 <= (b.x0 + b.x1) / 2) AS region_no FROM blocks b")
def xycut_one_level(spark: SparkSession, base: str) -> DataFrame:
    """Region of each block after the first vertical cut."""
    rows = _blocks(spark, base)
    return layout.cut_once(rows, layout.page_gaps(rows, _sizes(spark, base), "x")).select("block_id", "region_no")


REGION = "doc_id, page_num, path"
#: The recursive cut, one level a step: spans of the three cuts (columns, columns without wide boxes, rows), their gaps, and the boxes' bins.
CUTS = f"""cuts AS (SELECT b.doc_id, b.page_num, block_idx, x0, y0, x1, y1, coalesce(width, 0.0) AS width, coalesce(height, 0.0) AS height, []::BIGINT[] AS path FROM blocks b LEFT JOIN sizes USING (doc_id, page_num)
  UNION ALL (WITH live AS (SELECT * FROM cuts),
    st AS (SELECT {REGION}, min(x0) AS xl, max(x1) AS xh, min(y0) AS yl, max(y1) AS yh, greatest(1, trunc(any_value(width))::BIGINT + 1) AS xs, greatest(1, trunc(any_value(height))::BIGINT + 1) AS ys,
      coalesce(list_sort(list(y1 - y0) FILTER (y1 - y0 > 0)), []) AS hs FROM live GROUP BY ALL HAVING count(*) > 1),
    reg AS (SELECT * EXCLUDE (hs), CASE WHEN len(hs) = 0 THEN 12.0 ELSE hs[len(hs) // 2 + 1] END AS med FROM st),
    ax AS (SELECT r.*, a, CASE WHEN a < 3 THEN xs ELSE ys END AS size, CASE WHEN a < 3 THEN xl ELSE yl END AS low, CASE WHEN a < 3 THEN xh ELSE yh END AS high, CASE WHEN a < 3 THEN greatest(4, trunc(med * 0.35::DOUBLE)::BIGINT) ELSE greatest(8, trunc(med * 0.8::DOUBLE)::BIGINT) END AS least_gap FROM reg r, (VALUES (1), (2), (3)) v(a)),
    sp AS (SELECT * FROM (SELECT x.doc_id, x.page_num, x.path, a, size, greatest(0, trunc(CASE WHEN a < 3 THEN x0 ELSE y0 END)::BIGINT) AS s, least(size, trunc(CASE WHEN a < 3 THEN x1 ELSE y1 END)::BIGINT + 1) AS e
      FROM live l JOIN ax x ON l.doc_id = x.doc_id AND l.page_num = x.page_num AND l.path = x.path WHERE a != 2 OR x1 - x0 <= width * 0.45::DOUBLE) WHERE s < e),
    run AS (SELECT *, coalesce(max(e) OVER (PARTITION BY {REGION}, a ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM sp),
    gap AS (SELECT {REGION}, a, reach AS g0, s AS g1 FROM run WHERE s > reach UNION ALL SELECT x.doc_id, x.page_num, x.path, x.a, coalesce(m.e, 0), x.size FROM ax x LEFT JOIN (SELECT {REGION}, a, max(e) AS e FROM sp GROUP BY ALL) m
      ON m.doc_id = x.doc_id AND m.page_num = x.page_num AND m.path = x.path AND m.a = x.a WHERE coalesce(m.e, 0) < x.size),
    mid AS (SELECT g.doc_id, g.page_num, g.path, g.a, list((g0 + g1) / 2.0::DOUBLE) AS ms FROM gap g JOIN ax x ON g.doc_id = x.doc_id AND g.page_num = x.page_num AND g.path = x.path AND g.a = x.a WHERE g1 - g0 >= least_gap AND g1 > low AND g0 < high GROUP BY ALL),
    opt AS (SELECT {REGION}, coalesce(any_value(ms) FILTER (a = 1), any_value(ms) FILTER (a = 2), []) AS mx, coalesce(any_value(ms) FILTER (a = 3), []) AS my FROM mid GROUP BY ALL),
    binned AS (SELECT l.*, len(list_filter(mx, lambda m: m <= (x0 + x1) / 2)) AS bin_x, len(list_filter(my, lambda m: m <= (y0 + y1) / 2)) AS bin_y FROM live l JOIN opt o ON l.doc_id = o.doc_id AND l.page_num = o.page_num AND l.path = o.path),
    cut AS (SELECT *, min(bin_x) OVER r <> max(bin_x) OVER r AS in_x, min(bin_y) OVER r <> max(bin_y) OVER r AS in_y FROM binned WINDOW r AS (PARTITION BY {REGION}))
    SELECT doc_id, page_num, block_idx, x0, y0, x1, y1, width, height, path || [CASE WHEN in_x THEN bin_x ELSE bin_y END::BIGINT] FROM cut WHERE in_x OR in_y)),
  leaf AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_num ORDER BY path) - 1 AS region_no FROM (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, block_idx ORDER BY len(path) DESC) = 1))"""
LINE_FITS = "greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.4::DOUBLE AND b.x0 - a.x1 <= b.reach"
LAST = "{'x1': b.x1, 'y0': b.y0, 'y1': b.y1}"
LINE_FOLD = f"""line_in AS (SELECT f.*, greatest(15.0, m.hs[len(m.hs) // 2 + 1] * 1.8::DOUBLE) AS reach, row_number() OVER (PARTITION BY doc_id, page_num, region_no ORDER BY y0, x0, block_idx) AS k FROM leaf f
    JOIN (SELECT doc_id, page_num, region_no, list_sort(list(y1 - y0)) AS hs FROM leaf WHERE y1 > y0 GROUP BY ALL) m USING (doc_id, page_num, region_no) WHERE y1 > y0),
  line_fold AS (SELECT doc_id, page_num, region_no, k, block_idx, x0, y0, 1::BIGINT AS place, [{LAST}] AS lasts FROM line_in b WHERE k = 1
    UNION ALL SELECT doc_id, page_num, region_no, k, block_idx, x0, y0, CASE WHEN hit > 0 THEN hit ELSE len(lasts) + 1 END, CASE WHEN hit > 0 THEN lasts[:hit - 1] || [one] || lasts[hit + 1:] ELSE lasts || [one] END
    FROM (SELECT b.doc_id, b.page_num, b.region_no, b.k, b.block_idx, b.x0, b.y0, f.lasts, {LAST} AS one, coalesce(list_sort(list_filter(list_transform(f.lasts, lambda a, i: {{'g': CASE WHEN {LINE_FITS} THEN b.x0 - a.x1 END, 'n': i}}), lambda c: c.g IS NOT NULL))[1].n, 0)::BIGINT AS hit
      FROM line_fold f JOIN line_in b ON b.doc_id = f.doc_id AND b.page_num = f.page_num AND b.region_no = f.region_no AND b.k = f.k + 1)),
  line_rank AS (SELECT doc_id, page_num, region_no, place, row_number() OVER (PARTITION BY doc_id, page_num, region_no ORDER BY list_sum(list(y0 ORDER BY x0, k)) / count(*), place) - 1 AS line_no FROM line_fold GROUP BY doc_id, page_num, region_no, place),
  placed AS (SELECT doc_id, page_num, block_idx, region_no, line_no, row_number() OVER (PARTITION BY doc_id, page_num, region_no, place ORDER BY f.x0, f.k) - 1 AS box_no FROM line_fold f JOIN line_rank USING (doc_id, page_num, region_no, place))"""


@query(f"WITH RECURSIVE {SIZES}, {CUTS}, {LINE_FOLD} SELECT doc_id, page_num, block_idx::BIGINT AS block_idx, region_no, line_no, box_no FROM placed")
def text_lines(spark: SparkSession, base: str) -> DataFrame:
    """Region, line and place of each block by the recursive cut and line detection."""
    return layout.lay_out_lines(_blocks(spark, base), _sizes(spark, base)).select(*PAGE, "block_idx", "region_no", "line_no", "box_no")


START = rf"(length({_strip('text')}) > 0 AND (text LIKE '　%' OR text LIKE '  %' OR regexp_matches(regexp_replace(text, '^{BLANK}+', ''), '^(?:\([0-9]{{1,2}}\)|[0-9]{{1,2}}[.)]|[\x{{2460}}-\x{{2473}}\x{{2776}}-\x{{277f}}])(?:[\s\x{{3000}}]|$)') OR regexp_matches(regexp_replace(text, '^{BLANK}+', ''), '^[•◦▪●○・·\-–]')))"


def _break_sql(source: str, keys: str, order: str) -> str:
    """``source`` (box and text of lines) with para_no."""
    return f"""r AS (SELECT *, avg(h) OVER p AS mean_h, min(x0) OVER p AS bl, max(x1) OVER p AS br, avg(CASE WHEN gap >= 0 THEN gap END) OVER p AS mean_gap FROM (
    SELECT *, y1 - y0 AS h, y0 - lag(y1) OVER o AS gap, lag(y1 - y0) OVER o AS ph, lag(x1) OVER o AS pr, lag(x0) OVER o AS pl, row_number() OVER o AS k FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY {order})) WINDOW p AS (PARTITION BY {keys})),
  s AS (SELECT *, (k > 1 AND coalesce(coalesce({START}, false) OR gap > greatest(mean_h * 0.5::DOUBLE, coalesce(mean_gap, mean_h * 0.25::DOUBLE) * 1.4::DOUBLE, 5.0) OR (CASE WHEN ph > 0 AND h > 0 THEN greatest(ph, h) / least(ph, h) ELSE 1.0 END) > 1.25
    OR (br - bl > mean_h * 2.5::DOUBLE AND br - pr > mean_h AND gap > 0) OR (br - bl > mean_h * 2.5::DOUBLE AND x0 - bl > mean_h * 0.4::DOUBLE AND abs(pl - bl) < mean_h * 0.5::DOUBLE), false))::INT AS st FROM r),
  broken AS (SELECT *, sum(st) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS para_no FROM s)"""


@query(f"WITH {COLUMNS}, {_break_sql('col', 'doc_id, page_num, column_no', 'y0, x0, block_idx')} SELECT block_id, column_no, para_no FROM broken")
def paragraph_breaks(spark: SparkSession, base: str) -> DataFrame:
    """Paragraph detection over the lines of each column."""
    rows = simple.split_columns(_blocks(spark, base))
    return layout.break_paragraphs(rows, [*PAGE, "column_no"], ["y0", "x0", "block_idx"]).select("block_id", "column_no", "para_no")


@query(f"""WITH {PARAS}, {SIZES}, f AS (SELECT p.*, s.width, s.height, CASE WHEN font_size <= 0 THEN (y1 - y0) / greatest(1, n_lines) ELSE font_size END AS fs, y1 - y0 AS h, sqrt(s.width * s.width + s.height * s.height) AS diag FROM paragraphs p JOIN sizes s USING (doc_id, page_num))
  SELECT doc_id, page_num, para_idx, CASE WHEN height > 0 AND y0 < height * 0.08::DOUBLE AND h < height * 0.06::DOUBLE THEN 'header' WHEN height > 0 AND y1 > height * 0.92::DOUBLE AND h < height * 0.06::DOUBLE THEN 'footer'
    WHEN (CASE WHEN diag > 0 THEN fs / diag ELSE 0 END) > 0.03 AND length(text) < 120 THEN 'title' WHEN n_lines <= 1 AND length(text) < 80 AND (CASE WHEN diag > 0 THEN fs / diag ELSE 0 END) < 0.02 THEN 'caption' ELSE 'body' END AS layout_type FROM f""")
def layout_classes(spark: SparkSession, base: str) -> DataFrame:
    rows = simple.simple_paragraphs(_blocks(spark, base)).join(_sizes(spark, base), PAGE)
    return rows.select(*PAGE, "para_idx", g.layout_class(g.box(), F.col("width"), F.col("height"), F.col("font_size"), F.length("text"), F.col("n_lines")).alias("layout_type"))


def _order_sql(source: str, key: str, name: str = "strip") -> str:
    """Reading order of the boxes of ``source`` (doc_id, page_num, ``key``, box): strips as a fold over the boxes of each page."""
    fits = "b.y0 < s.b / s.n AND b.y1 > s.a / s.n AND (least(b.y1, s.b / s.n) - greatest(b.y0, s.a / s.n)) / least(greatest(1.0, b.y1 - b.y0), greatest(1.0, (s.b - s.a) / s.n)) >= 0.4"
    fits = fits.replace("(s.b - s.a) / s.n", "s.b / s.n - s.a / s.n")
    one = "{'a': b.y0, 'b': b.y1, 'n': 1::BIGINT}"
    return f"""{name}_in AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, {key}) AS k FROM {source}),
  {name}_fold AS (SELECT doc_id, page_num, k, {key}, x0, 1::BIGINT AS place, [{one}] AS strips FROM {name}_in b WHERE k = 1
    UNION ALL SELECT doc_id, page_num, k, {key}, x0, CASE WHEN hit > 0 THEN hit ELSE len(strips) + 1 END AS place, CASE WHEN hit > 0 THEN strips[:hit - 1] || [{{'a': strips[hit].a + y0, 'b': strips[hit].b + y1, 'n': strips[hit].n + 1}}] || strips[hit + 1:] ELSE strips || [one] END
    FROM (SELECT b.doc_id, b.page_num, b.k, b.{key}, b.x0, b.y0, b.y1, f.strips, {one} AS one, coalesce(list_position(list_transform(f.strips, lambda s: {fits}), true), 0)::BIGINT AS hit
      FROM {name}_fold f JOIN {name}_in b ON b.doc_id = f.doc_id AND b.page_num = f.page_num AND b.k = f.k + 1)),
  {name}_order AS (SELECT doc_id, page_num, {key}, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY place, x0, k) - 1 AS reading_no FROM {name}_fold)"""


@query(f"WITH RECURSIVE {PARAS}, {_order_sql('paragraphs', 'para_idx')} SELECT doc_id, page_num, para_idx, reading_no FROM strip_order")
def reading_order(spark: SparkSession, base: str) -> DataFrame:
    """Reading order of each page's paragraphs."""
    return layout.order_pages(simple.simple_paragraphs(_blocks(spark, base)), "para_idx")


CLASS = """CASE WHEN height > 0 AND y0 < height * 0.08::DOUBLE AND h < height * 0.06::DOUBLE THEN 'header' WHEN height > 0 AND y1 > height * 0.92::DOUBLE AND h < height * 0.06::DOUBLE THEN 'footer'
    WHEN (CASE WHEN diag > 0 THEN fs / diag ELSE 0 END) > 0.03 AND length(text) < 120 THEN 'title' WHEN n_lines <= 1 AND length(text) < 80 AND (CASE WHEN diag > 0 THEN fs / diag ELSE 0 END) < 0.02 THEN 'caption' ELSE 'body' END"""
LAYOUT = f"""{SIZES}, {CUTS}, {LINE_FOLD}, box AS (SELECT p.*, coalesce(b.text, '') AS text, b.font_size, b.x0, b.y0, b.x1, b.y1 FROM placed p JOIN blocks b USING (doc_id, page_num, block_idx)),
  line AS (SELECT doc_id, page_num, region_no, line_no, string_agg(text, '' ORDER BY box_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM box GROUP BY ALL), {_break_sql('line', 'doc_id, page_num, region_no', 'line_no')},
  numbered_box AS (SELECT b.*, dense_rank() OVER (PARTITION BY b.doc_id, b.page_num ORDER BY b.region_no, q.para_no) - 1 AS para_idx FROM box b JOIN broken q USING (doc_id, page_num, region_no, line_no)),
  paragraphs AS (SELECT doc_id, page_num, para_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM numbered_box GROUP BY ALL),
  medians AS (SELECT doc_id, page_num, h[len(h) // 2 + 1] AS median_height FROM (SELECT doc_id, page_num, list_sort(list(y1 - y0)) AS h FROM box GROUP BY ALL)), {EDGE_RULE}, {GROUPS},
  lone AS (SELECT doc_id, page_num, max(para_idx) = 0 AS alone FROM paragraphs GROUP BY ALL),
  merged AS (SELECT doc_id, page_num, group_idx, string_agg(text, '' ORDER BY CASE WHEN alone THEN line_no ELSE y0 END, CASE WHEN alone THEN box_no ELSE x0 END, para_idx, block_idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines,
    coalesce(avg(CASE WHEN font_size > 0 THEN font_size ELSE y1 - y0 END), 0) AS font_size FROM numbered_box JOIN groups USING (doc_id, page_num, para_idx) JOIN lone USING (doc_id, page_num) GROUP BY ALL), {_order_sql('merged', 'group_idx')}"""


@query(f"""WITH RECURSIVE {LAYOUT} SELECT doc_id, page_num, reading_no, {CLASS} AS layout_type, text, x0, y0, x1, y1, n_lines, round(font_size, 4) AS font_size
  FROM (SELECT m.*, reading_no, coalesce(width, 0) AS width, coalesce(height, 0) AS height, CASE WHEN font_size <= 0 THEN (y1 - y0) / greatest(1, n_lines) ELSE font_size END AS fs, y1 - y0 AS h, sqrt(coalesce(width, 0) * coalesce(width, 0) + coalesce(height, 0) * coalesce(height, 0)) AS diag
    FROM merged m JOIN strip_order USING (doc_id, page_num, group_idx) LEFT JOIN sizes USING (doc_id, page_num))""")
def layout_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    """The layout algorithm from blocks to classified paragraphs in reading order."""
    return layout.cluster(_blocks(spark, base), _sizes(spark, base), "layout").withColumn("font_size", F.round("font_size", 4))


ORDERED = "ordered AS (SELECT doc_id, page_num, block_idx, x0, y0, x1, y1, coalesce(text, '') AS text, source, font_size, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, block_idx) AS k FROM blocks)"
JOINS = "abs(o.y0 - f.y0) < 3 AND abs(o.y1 - f.y1) < 3 AND o.x0 - f.x1 > 0 AND o.x0 - f.x1 < 5"


@query(f"""WITH RECURSIVE {ORDERED}, fold AS (SELECT doc_id, page_num, k, 0::BIGINT AS n, x0, y0, x1, y1, text, source, font_size FROM ordered WHERE k = 1
    UNION ALL SELECT o.doc_id, o.page_num, o.k, CASE WHEN {JOINS} THEN f.n ELSE f.n + 1 END, CASE WHEN {JOINS} THEN f.x0 ELSE o.x0 END, CASE WHEN {JOINS} THEN least(f.y0, o.y0) ELSE o.y0 END, CASE WHEN {JOINS} THEN greatest(f.x1, o.x1) ELSE o.x1 END,
      CASE WHEN {JOINS} THEN greatest(f.y1, o.y1) ELSE o.y1 END, CASE WHEN {JOINS} THEN f.text || o.text ELSE o.text END, CASE WHEN {JOINS} THEN f.source ELSE o.source END, CASE WHEN {JOINS} THEN 0.0 ELSE o.font_size END
    FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.page_num = f.page_num AND o.k = f.k + 1)
  SELECT doc_id, page_num, n AS block_idx, x0, y0, x1, y1, text, source, font_size FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, n ORDER BY k DESC) = 1""")
def horizontal_merge(spark: SparkSession, base: str) -> DataFrame:
    return boxes.merge_horizontally(_blocks(spark, base))


DOUBLE = """least(a.x1, o.x1) > greatest(a.x0, o.x0) AND least(a.y1, o.y1) > greatest(a.y0, o.y0) AND least((a.x1 - a.x0) * (a.y1 - a.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0
  AND (least(a.x1, o.x1) - greatest(a.x0, o.x0)) * (least(a.y1, o.y1) - greatest(a.y0, o.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0.3"""
BOX_STRUCT = "{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'text': o.text, 'source': o.source, 'font_size': o.font_size}"


@query(f"""WITH RECURSIVE {ORDERED}, fold AS (SELECT doc_id, page_num, k, [{BOX_STRUCT}] AS kept FROM ordered o WHERE k = 1
    UNION ALL SELECT doc_id, page_num, k, CASE WHEN hit = 0 THEN kept || [one] WHEN length(one.text) > length(kept[hit].text) THEN kept[:hit - 1] || [one] || kept[hit + 1:] ELSE kept END
    FROM (SELECT o.doc_id, o.page_num, o.k, f.kept, {BOX_STRUCT} AS one, coalesce(list_position(list_transform(f.kept, lambda a: {DOUBLE}), true), 0)::BIGINT AS hit
      FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.page_num = f.page_num AND o.k = f.k + 1)),
  whole AS (SELECT doc_id, page_num, kept, unnest(range(1, len(kept) + 1)) AS i FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY k DESC) = 1)
  SELECT doc_id, page_num, i - 1 AS block_idx, kept[i].x0 AS x0, kept[i].y0 AS y0, kept[i].x1 AS x1, kept[i].y1 AS y1, kept[i].text AS text, kept[i].source AS source, kept[i].font_size AS font_size FROM whole""")
def ocr_engine_merge(spark: SparkSession, base: str) -> DataFrame:
    """Blocks without the doubles of a second engine."""
    return boxes.merge_engines(_blocks(spark, base))


# --- text, memory, requests ---------------------------------------------------------------------------------------------

KANA_SQL, HAN_SQL = r"'[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]'", r"'[\x{4e00}-\x{9fff}]'"


@query(f"""SELECT cache_id, coalesce(regexp_matches(source_text, {KANA_SQL}), false) AS source_kana, coalesce(regexp_matches(source_text, {HAN_SQL}), false) AS source_han, coalesce(regexp_matches(translated_text, {KANA_SQL}), false) AS target_kana,
  sha256(source_text) AS hash, length(source_text) AS n FROM translation_cache""")
def script_flags(spark: SparkSession, base: str) -> DataFrame:
    a, b = F.col("source_text"), F.col("translated_text")
    return table(spark, base, "translation_cache").select("cache_id", t.has_kana(a).alias("source_kana"), t.has_han(a).alias("source_han"), t.has_kana(b).alias("target_kana"), t.content_hash(a).alias("hash"), F.length(a).alias("n"))


@query(f"""SELECT cache_id FROM translation_cache WHERE {_strip('translated_text')} = {_strip('source_text')} AND (regexp_matches(source_text, {KANA_SQL}) OR regexp_matches(source_text, {HAN_SQL}))""")
def identity_failures(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "translation_cache").where(t.identity_failure(F.col("source_text"), F.col("translated_text"))).select("cache_id")


ECHO_SQL = " OR ".join(f"contains(lower(translated_text), '{m}')" for m in t.ECHO_MARKERS)


@query(f"SELECT cache_id FROM translation_cache WHERE translated_text IS NULL OR {_strip('translated_text')} = '' OR {ECHO_SQL}")
def prompt_echoes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "translation_cache").where(t.prompt_echo(F.col("translated_text"))).select("cache_id")


@query(f"""SELECT cache_id, coalesce({_strip('translated_text')}, '') <> '' AND NOT coalesce(regexp_matches(translated_text, {KANA_SQL}), false) AND (NOT coalesce(regexp_matches(source_text, {HAN_SQL}), false) OR coalesce(regexp_matches(translated_text, {HAN_SQL}), false)) AS valid FROM translation_cache""")
def valid_targets(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "translation_cache").select("cache_id", t.valid_target(F.col("source_text"), F.col("translated_text")).alias("valid"))


LATEST_CACHE = """entry AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY version_no DESC, written_at DESC NULLS LAST, cache_id DESC) AS n FROM translation_cache WHERE source_hash IS NOT NULL) WHERE n = 1)"""


@query(f"WITH {LATEST_CACHE} SELECT d.text AS source_text, sha256(d.text) AS source_hash, e.translated_text FROM (SELECT DISTINCT text FROM ocr_paragraphs WHERE text IS NOT NULL) d LEFT JOIN entry e ON e.source_hash = sha256(d.text)")
def cache_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Paragraph texts with their cached translation."""
    return translate.look_up(table(spark, base, "ocr_paragraphs"), table(spark, base, "translation_cache"))


@query(f"WITH {LATEST_CACHE} SELECT source_hash, source_text, translated_text, version_no::BIGINT AS version_no FROM entry")
def cache_latest(spark: SparkSession, base: str) -> DataFrame:
    return translate.latest_entries(table(spark, base, "translation_cache")).select("source_hash", "source_text", "translated_text", "version_no")


@query(f"""WITH {LATEST_CACHE}, fresh AS (SELECT sha256(text) AS source_hash, text AS source_text, max(translated_text) AS translated_text FROM ocr_paragraphs WHERE text IS NOT NULL AND translated_text <> '' GROUP BY text)
  SELECT source_hash, source_text, translated_text FROM entry WHERE source_hash NOT IN (SELECT source_hash FROM fresh) UNION ALL SELECT source_hash, source_text, translated_text FROM fresh""")
def cache_upsert(spark: SparkSession, base: str) -> DataFrame:
    """The memory after putting in the stored paragraph translations."""
    new = table(spark, base, "ocr_paragraphs").where("text is not null and translated_text != ''").select(F.col("text").alias("source_text"), "translated_text")
    return translate.upsert(translate.latest_entries(table(spark, base, "translation_cache")), new)


def _line_sql(extra: str = "") -> str:
    return LATEST_PARAGRAPHS + f""", lines AS (SELECT doc_id, page_num, para_idx, i - 1 AS line_idx, json_extract_string(line_bboxes_json, '$[' || (i - 1) || '][1]') AS text, json_extract(line_bboxes_json, '$[' || (i - 1) || '][0][0]')::DOUBLE AS x0,
    json_extract(line_bboxes_json, '$[' || (i - 1) || '][0][1]')::DOUBLE AS y0, json_extract(line_bboxes_json, '$[' || (i - 1) || '][0][2]')::DOUBLE AS x1, json_extract(line_bboxes_json, '$[' || (i - 1) || '][0][3]')::DOUBLE AS y1,
    json_extract(line_bboxes_json, '$[' || (i - 1) || '][2]')::DOUBLE AS font_size FROM (SELECT *, unnest(range(1, json_array_length(line_bboxes_json)::BIGINT + 1)) AS i FROM latest)){extra}"""


@query(f"WITH {_line_sql()} SELECT doc_id, page_num, para_idx::BIGINT AS para_idx, line_idx, text, x0, y0, x1, y1, font_size FROM lines")
def stored_lines(spark: SparkSession, base: str) -> DataFrame:
    """Printed lines of the stored paragraphs, from JSON."""
    return stages.stored_line_rows(table(spark, base, "ocr_paragraphs")).select(*PAGE, "para_idx", "line_idx", "text", "x0", "y0", "x1", "y1", "font_size")


NUMBERED = _line_sql(f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, batch_id ORDER BY page_num, para_idx, line_idx) - 1 AS gid FROM (SELECT *, (page_num - 1) // 3 AS batch_id FROM lines WHERE coalesce({_strip('text')}, '') <> ''))""")


@query(f"WITH {NUMBERED} SELECT doc_id, page_num, para_idx::BIGINT AS para_idx, line_idx, batch_id, gid, gid // 50 AS chunk_no FROM numbered")
def chunk_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines numbered over their page batch, in chunks of 50."""
    lines = stages.stored_line_rows(table(spark, base, "ocr_paragraphs"))
    return translate.chunk_lines(translate.number_lines(lines, 3)).select(*PAGE, "para_idx", "line_idx", "batch_id", "gid", "chunk_no")


@query(f"WITH {NUMBERED} SELECT concat_ws('-', doc_id, batch_id, gid // 50) AS chunk_id, count(*) AS n_items, sum(length(text))::BIGINT AS n_chars FROM numbered GROUP BY ALL")
def chunk_requests(spark: SparkSession, base: str) -> DataFrame:
    """Requests built from the chunks and read back: items and characters of each."""
    lines = stages.stored_line_rows(table(spark, base, "ocr_paragraphs"))
    chunked = translate.chunk_lines(translate.number_lines(lines, 3)).withColumn("chunk_id", F.concat_ws("-", "doc_id", "batch_id", "chunk_no"))
    items = translate.build_requests(chunked).select("chunk_id", F.explode(F.from_json("request", t.REQUEST_SCHEMA)["items"]).alias("i"))
    return items.groupBy("chunk_id").agg(F.count("*").alias("n_items"), F.sum(F.length("i.text")).alias("n_chars"))


def _identity_sql(source: str, reply: str) -> str:
    return f"coalesce({_strip(reply)} = {_strip(source)} AND (regexp_matches({source}, {KANA_SQL}) OR regexp_matches({source}, {HAN_SQL})), false)"


def _echo_sql(reply: str) -> str:
    return f"({reply} IS NULL OR {_strip(reply)} = '' OR " + " OR ".join(f"contains(lower({reply}), '{m}')" for m in t.ECHO_MARKERS) + ")"


def _done_sql(paragraphs: str, lines: str) -> str:
    """Translations of ``paragraphs`` and, where there is none, of their ``lines``, with the latest memory as memory and as backend."""
    return f"""direct AS (SELECT doc_id, page_num, para_idx, e.translated_text AS translation, 'paragraph' AS level FROM {paragraphs} p JOIN entry e ON e.source_hash = sha256(p.text)
    WHERE {_strip('p.text')} <> '' AND e.translated_text <> '' AND NOT {_identity_sql('p.text', 'e.translated_text')}),
  by_line AS (SELECT l.doc_id, l.page_num, l.para_idx, l.line_idx, CASE WHEN coalesce({_strip('l.text')}, '') = '' OR {_echo_sql('e.translated_text')} THEN '' WHEN {_identity_sql('l.text', 'e.translated_text')} THEN {_strip('e.translated_text')} ELSE e.translated_text END AS translated
    FROM {lines} l LEFT JOIN entry e ON e.source_hash = sha256(l.text) WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.doc_id = l.doc_id AND d.page_num = l.page_num AND d.para_idx = l.para_idx)),
  done AS (SELECT * FROM direct UNION ALL SELECT doc_id, page_num, para_idx, string_agg(translated, chr(10) ORDER BY line_idx), 'line' FROM by_line GROUP BY ALL)"""


STAGE = f"{LATEST_CACHE}, {_line_sql()}, {_done_sql('latest', 'lines')}"


def _stage(spark: SparkSession, base: str) -> stages.Translated:
    cache = table(spark, base, "translation_cache")
    return stages.translation_stage(table(spark, base, "ocr_paragraphs"), cache, translate.DictionaryBackend(translate.latest_entries(cache)))


@query(f"WITH {STAGE} SELECT doc_id, page_num, para_idx::BIGINT AS para_idx, translation, level FROM done")
def translated_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    """The translation stage with the latest memory as memory and as backend."""
    return _stage(spark, base).paragraphs


@query(f"WITH {STAGE} SELECT doc_id, page_num, para_idx::BIGINT AS para_idx, line_idx, translated FROM by_line")
def translated_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines of the paragraphs that the memory does not know as a whole, asked in chunks with retry."""
    return _stage(spark, base).lines.select(*PAGE, "para_idx", "line_idx", "translated")


def _rendered(spark: SparkSession, base: str) -> stages.Rendered:
    cache = table(spark, base, "translation_cache")
    return stages.translate_render_stage(table(spark, base, "ocr_pages"), table(spark, base, "ocr_paragraphs"), cache, translate.DictionaryBackend(translate.latest_entries(cache)))


@query(f"WITH {STAGE}, {POINTS} SELECT l.id, l.para_idx::BIGINT AS para_idx, coalesce(d.translation, l.translated_text) AS translated_text FROM latest l JOIN points USING (doc_id, page_num) LEFT JOIN done d ON d.doc_id = l.doc_id AND d.page_num = l.page_num AND d.para_idx = l.para_idx")
def translations_saved(spark: SparkSession, base: str) -> DataFrame:
    """The paragraph store after the translation stage."""
    return _rendered(spark, base).paragraphs.select("id", "para_idx", "translated_text")


@query(f"WITH {POINTS} SELECT doc_id, page_num, CASE WHEN EXISTS (SELECT 1 FROM ocr_paragraphs q WHERE q.doc_id = p.doc_id AND q.page_num = p.page_num) THEN 'translated' ELSE status END AS status FROM points p")
def pages_marked(spark: SparkSession, base: str) -> DataFrame:
    """The page store after the translation stage."""
    return _rendered(spark, base).pages.select(*PAGE, "status")


@query(f"WITH {LATEST_CACHE} SELECT source_hash, source_text, translated_text FROM entry")
def memory_after_stage(spark: SparkSession, base: str) -> DataFrame:
    """The memory after the translation stage; the dictionary backend knows no more than the memory."""
    return _rendered(spark, base).memory


@query(f"""WITH {STAGE}, parts AS (SELECT l.*, d.level, coalesce(d.translation, '') AS t, b.translated, length(coalesce(d.translation, '')) AS size, sum(length(l.text)) OVER p AS total, count(*) OVER p AS n, l.line_idx + 1 AS i
    FROM lines l LEFT JOIN done d USING (doc_id, page_num, para_idx) LEFT JOIN by_line b ON b.doc_id = l.doc_id AND b.page_num = l.page_num AND b.para_idx = l.para_idx AND b.line_idx = l.line_idx WINDOW p AS (PARTITION BY l.doc_id, l.page_num, l.para_idx)),
  ends AS (SELECT *, sum(size * length(text) // greatest(total, 1)) OVER (PARTITION BY doc_id, page_num, para_idx ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM parts),
  pieces AS (SELECT *, CASE WHEN level = 'line' THEN translated WHEN i = n THEN substring(t, coalesce(lag(b) OVER w, 0) + 1) ELSE substring(t, coalesce(lag(b) OVER w, 0) + 1, b - coalesce(lag(b) OVER w, 0)) END AS piece FROM ends WINDOW w AS (PARTITION BY doc_id, page_num, para_idx ORDER BY i)),
  listed AS (SELECT doc_id, page_num, para_idx, list({{'bbox': [x0, y0, x1, y1], 'original': text, 'translated': piece}} ORDER BY i) AS ls FROM pieces GROUP BY ALL)
  SELECT doc_id, page_num, to_json({{'page_num': page_num, 'paragraphs': list({{'para_idx': para_idx, 'source_text': coalesce(text, ''), 'translation': coalesce(translation, ''), 'lines': coalesce(ls, [])}} ORDER BY para_idx)}})::VARCHAR AS document
  FROM latest LEFT JOIN listed USING (doc_id, page_num, para_idx) LEFT JOIN done USING (doc_id, page_num, para_idx) GROUP BY doc_id, page_num""")
def debug_documents(spark: SparkSession, base: str) -> DataFrame:
    """Debug JSON of each page: paragraphs with their printed and translated lines."""
    paras = table(spark, base, "ocr_paragraphs")
    return store.debug_document(stages.translated_lines(paras, _stage(spark, base)))


RUN = PARAS + f""", blk AS (SELECT p.doc_id, p.page_num, q.para_idx, row_number() OVER (PARTITION BY p.doc_id, p.page_num, q.para_idx ORDER BY p.y0, p.x0, p.block_idx) - 1 AS line_idx, coalesce(p.text, '') AS text, p.x0, p.y0, p.x1, p.y1
    FROM par p JOIN (SELECT doc_id, page_num, column_no, para_no, para_idx FROM paragraphs) q USING (doc_id, page_num, column_no, para_no)), {LATEST_CACHE}, {_done_sql('paragraphs', 'blk')}"""


def _run(spark: SparkSession, base: str, **options: object) -> stages.Run:
    cache = table(spark, base, "translation_cache")
    return stages.full_run(_blocks(spark, base), table(spark, base, "ocr_pages"), cache, translate.DictionaryBackend(translate.latest_entries(cache)), **options)


@query(f"WITH {RUN} SELECT doc_id, page_num, para_idx, text, coalesce(translation, '') AS translation, level FROM paragraphs LEFT JOIN done USING (doc_id, page_num, para_idx)")
def full_run(spark: SparkSession, base: str) -> DataFrame:
    """Recognition and translation in one run: whole paragraphs, then lines."""
    return _run(spark, base).paragraphs.select(*PAGE, "para_idx", "text", "translation", "level")


@query(f"WITH {RUN} SELECT doc_id, page_num, para_idx, text, string_agg(b.text, chr(10) ORDER BY line_idx) AS translation FROM paragraphs p JOIN (SELECT doc_id, page_num, para_idx, line_idx, text FROM blk) b USING (doc_id, page_num, para_idx) GROUP BY doc_id, page_num, para_idx, p.text".replace("para_idx, text, string_agg", "para_idx, p.text, string_agg"))
def ocr_only_run(spark: SparkSession, base: str) -> DataFrame:
    """A run without translation: the recognised lines stand for it."""
    return _run(spark, base, ocr_only=True).paragraphs.select(*PAGE, "para_idx", "text", "translation")


# --- fitting and drawing ------------------------------------------------------------------------------------------------


@query(f"""WITH {_line_sql()}, p AS (SELECT l.doc_id, l.page_num, l.para_idx, list(length(x.text) ORDER BY line_idx) AS n, any_value(coalesce(l.translated_text, '')) AS t FROM latest l JOIN lines x ON l.doc_id = x.doc_id AND l.page_num = x.page_num AND l.para_idx = x.para_idx GROUP BY ALL),
  e AS (SELECT doc_id, page_num, para_idx, t, len(n) AS size, i, sum(length(t) * n[i] // greatest(list_sum(n), 1)) OVER (PARTITION BY doc_id, page_num, para_idx ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM p)),
  c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id, page_num, para_idx ORDER BY i), 0) AS a FROM e)
  SELECT doc_id, page_num, para_idx::BIGINT AS para_idx, i - 1 AS line_idx, CASE WHEN i = size THEN substring(t, a + 1) ELSE substring(t, a + 1, b - a) END AS part FROM c""")
def proportional_split(spark: SparkSession, base: str) -> DataFrame:
    """Stored translations split over the printed lines."""
    paras = store.latest_paragraphs(table(spark, base, "ocr_paragraphs"))
    lengths = F.transform(t.stored_lines(F.col("line_bboxes_json")), lambda x: F.length(x["text"]))
    rows = paras.select(*PAGE, "para_idx", F.posexplode(fit.split_proportionally(F.coalesce("translated_text", F.lit("")), lengths)).alias("line_idx", "part"))
    return rows.select(*PAGE, "para_idx", "line_idx", "part")


def _fit_sql(source: str, key: str) -> str:
    """Largest size that fits and its lines, for rows (``key``, text, w, h, initial) of ``source``: fitted (``key``, font, line_no, line)."""
    return f"""fit_in AS (SELECT {key}, {_strip('text')} AS text, w, h, initial FROM {source} WHERE {_strip('text')} <> ''),
  fit_step AS (SELECT {key}, size, w * 0.95::DOUBLE AS room, -1::BIGINT AS line_no, text AS rest, '' AS line FROM (SELECT *, unnest(CASE WHEN initial > 4 THEN range(4, initial + 1) ELSE [4] END)::BIGINT AS size FROM fit_in WHERE w >= 2 AND h >= 2)
    UNION ALL SELECT {key}, size, room, line_no + 1, regexp_replace(substring(rest, stop + 1), '^{BLANK}+', ''), regexp_replace(substring(rest, 1, stop), '{BLANK}+$', '')
    FROM (SELECT *, coalesce(list_position(list_transform(range(2, len(u) + 1), lambda k: size * list_sum(u[1:k]) > room), true), len(u))::BIGINT AS stop FROM (
      SELECT *, list_transform(string_split(substring(rest, 1, trunc(room * 2 / size)::BIGINT + 3), ''), lambda c: CASE WHEN c BETWEEN '一' AND '鿿' OR c BETWEEN '　' AND 'ヿ' THEN 1.0 ELSE 0.5 END) AS u FROM fit_step WHERE rest <> ''))),
  fit_lines AS (SELECT {key}, size, line_no, line FROM fit_step WHERE line_no >= 0),
  fit_best AS (SELECT {key}, coalesce(max(size) FILTER (c * size * 1.25 <= h), 4) AS font FROM (SELECT {key}, size, h, count(*) AS c FROM fit_lines JOIN (SELECT {key}, h FROM fit_in) USING ({key}) GROUP BY ALL) GROUP BY ALL),
  fitted AS (SELECT {key}, font, line_no, line FROM fit_best JOIN fit_lines l USING ({key}) WHERE l.size = font UNION ALL SELECT {key}, initial, 0, text FROM fit_in WHERE w < 2 OR h < 2)"""


@query(f"WITH RECURSIVE {LATEST_CACHE}, texts AS (SELECT source_hash, translated_text AS text, 300.0::DOUBLE AS w, 60.0::DOUBLE AS h, 12::BIGINT AS initial FROM entry WHERE translated_text IS NOT NULL), {_fit_sql('texts', 'source_hash')} SELECT source_hash, font, line_no, line FROM fitted")
def wrapped_lines(spark: SparkSession, base: str) -> DataFrame:
    """Cached translations fitted into a box of 300 by 60 points: font size and lines."""
    cache = translate.latest_entries(table(spark, base, "translation_cache"))
    return cache.where(~t.is_blank(F.col("translated_text"))).select("source_hash", fit.fit(F.col("translated_text"), F.lit(300.0), F.lit(60.0), F.lit(12)).alias("f")).select("source_hash", F.col("f.font").alias("font"), F.posexplode("f.lines").alias("line_no", "line"))


@query("""SELECT cache_id, 10 * len(regexp_extract_all(translated_text, '[\\x{4e00}-\\x{9fff}\\x{3000}-\\x{30ff}]')) + 5.0::DOUBLE * (length(translated_text) - len(regexp_extract_all(translated_text, '[\\x{4e00}-\\x{9fff}\\x{3000}-\\x{30ff}]'))) AS width FROM translation_cache WHERE translated_text IS NOT NULL""")
def text_widths(spark: SparkSession, base: str) -> DataFrame:
    """Width of each translation at size 10."""
    return table(spark, base, "translation_cache").where("translated_text is not null").select("cache_id", fit.text_width(F.col("translated_text"), F.lit(10.0)).alias("width"))


@query(f"""WITH {POINTS}, m AS (SELECT block_id, dpi, trunc(b.x0)::BIGINT AS ix0, trunc(b.y0)::BIGINT AS iy0, trunc(b.x1)::BIGINT AS ix1, trunc(b.y1)::BIGINT AS iy1, trunc(dpi * 2.0::DOUBLE / 72.0::DOUBLE)::BIGINT AS pad, trunc(width * dpi / 72.0::DOUBLE)::BIGINT AS iw, trunc(height * dpi / 72.0::DOUBLE)::BIGINT AS ih FROM blocks b JOIN points USING (doc_id, page_num)),
  q AS (SELECT block_id, greatest(0, ix0 - pad) AS mx0, greatest(0, iy0 - pad) AS my0, least(iw, ix1 + pad) AS mx1, least(ih, iy1 + pad) AS my1, least(greatest(1, trunc(dpi * 3.0::DOUBLE / 72.0::DOUBLE)::BIGINT), 10) AS radius FROM m) SELECT * FROM q WHERE mx1 > mx0 AND my1 > my0""")
def inpaint_masks(spark: SparkSession, base: str) -> DataFrame:
    """Pixel rectangles to clear on each page."""
    pages = _points(spark, base).withColumns({"image_width": F.col("width") * F.col("dpi") / F.lit(72.0), "image_height": F.col("height") * F.col("dpi") / F.lit(72.0)})
    rows = _blocks(spark, base).join(pages.select(*PAGE, "dpi", "image_width", "image_height"), PAGE)
    return draw.inpaint_masks(rows).select("block_id", "mx0", "my0", "mx1", "my1", "radius")


@query(f"""WITH {POINTS}, {PARAS} SELECT doc_id, page_num, item_idx, op, layer::BIGINT AS layer, px0, py0, px1, py1 FROM (
  SELECT doc_id, page_num, para_idx AS item_idx, 'frame' AS op, 0 AS layer, x0 * 72.0::DOUBLE / dpi AS px0, y0 * 72.0::DOUBLE / dpi AS py0, x1 * 72.0::DOUBLE / dpi AS px1, y1 * 72.0::DOUBLE / dpi AS py1, 4 AS least_size FROM paragraphs JOIN points USING (doc_id, page_num)
  UNION ALL SELECT doc_id, page_num, block_idx, 'line', 2, x0 * 72.0::DOUBLE / dpi, y0 * 72.0::DOUBLE / dpi, x1 * 72.0::DOUBLE / dpi, y1 * 72.0::DOUBLE / dpi, 2 FROM blocks JOIN points USING (doc_id, page_num)) WHERE px1 - px0 >= least_size AND py1 - py0 >= least_size""")
def draw_frames(spark: SparkSession, base: str) -> DataFrame:
    """Outlines of clusters and lines."""
    dpi = _points(spark, base).select(*PAGE, "dpi")
    clusters = simple.simple_paragraphs(_blocks(spark, base)).withColumnRenamed("para_idx", "cluster_idx").join(dpi, PAGE)
    lines = _blocks(spark, base).withColumn("line_no", F.col("block_idx")).join(dpi, PAGE)
    return draw.cluster_frames(clusters).unionByName(draw.line_frames(lines))


def _draw_sql(lines: str, done: str) -> str:
    """Ground and text commands of ``done`` (doc_id, page_num, para_idx, translation) over ``lines`` (box)."""
    height = "(y1 - y0) * 72.0::DOUBLE / dpi"
    return f"""drawn AS (SELECT l.*, dpi FROM {lines} l JOIN points USING (doc_id, page_num)),
  areas AS (SELECT doc_id, page_num, para_idx, dpi, min(x0) * 72.0::DOUBLE / dpi + 3 AS le, min(y0) * 72.0::DOUBLE / dpi + 3 AS tp, max(x1) * 72.0::DOUBLE / dpi - 3 AS ri, max(y1) * 72.0::DOUBLE / dpi - 3 AS bo,
    list_sort(coalesce(list(greatest(1, trunc({height} * 0.72::DOUBLE)::BIGINT)) FILTER ({height} >= 2), [])) AS fonts FROM drawn GROUP BY doc_id, page_num, para_idx, dpi),
  area_text AS (SELECT a.*, d.translation AS text, ri - le AS w, bo - tp AS h, CASE WHEN len(fonts) = 0 THEN 10 ELSE fonts[len(fonts) // 2 + 1] END AS initial, concat_ws('-', doc_id, page_num, para_idx) AS key
    FROM areas a JOIN {done} d USING (doc_id, page_num, para_idx) WHERE coalesce({_strip('d.translation')}, '') <> '' AND ri - le >= 4 AND bo - tp >= 4), {_fit_sql('area_text', 'key')},
  commands AS (SELECT doc_id, page_num, para_idx AS item_idx, 'ground' AS op, 1 AS layer, -1 AS line_no, le - 3 * 72.0::DOUBLE / dpi AS x, tp - 3 * 72.0::DOUBLE / dpi AS y, ri + 3 * 72.0::DOUBLE / dpi AS x1, bo + 3 * 72.0::DOUBLE / dpi AS y1, 0 AS font, NULL::VARCHAR AS text FROM area_text
    UNION ALL SELECT doc_id, page_num, para_idx, 'text', 1, line_no, le, tp + font + line_no * font * 1.25::DOUBLE, NULL, NULL, font, line FROM fitted JOIN area_text USING (key) WHERE line <> '')"""


COMMANDS = "SELECT doc_id, page_num, item_idx::BIGINT AS item_idx, op, layer::BIGINT AS layer, line_no::BIGINT AS line_no, x, y, x1, y1, font::BIGINT AS font, text FROM"


@query(f"WITH RECURSIVE {_line_sql()}, {POINTS}, {_draw_sql('lines', '(SELECT doc_id, page_num, para_idx, translated_text AS translation FROM latest)')} {COMMANDS} commands")
def draw_commands(spark: SparkSession, base: str) -> DataFrame:
    """White grounds and text lines of the stored translations."""
    paras = table(spark, base, "ocr_paragraphs")
    done = store.latest_paragraphs(paras).select(*PAGE, "para_idx", F.col("translated_text").alias("translation"))
    return stages.drawing(done, paras, table(spark, base, "ocr_pages"))


@query(f"""WITH {PARAS}, f AS (SELECT doc_id, page_num, count(*) AS n_paragraphs, min_by(text, para_idx) AS t FROM paragraphs GROUP BY ALL)
  SELECT doc_id, page_num, n_blocks, n_paragraphs, CASE WHEN has_ocr THEN 'ocr' ELSE 'native' END AS origin, replace(substring(t, 1, 80), chr(10), ' ') AS preview FROM (SELECT doc_id, page_num, count(*) AS n_blocks, bool_or(source = 'ocr') AS has_ocr FROM blocks GROUP BY ALL) JOIN f USING (doc_id, page_num)""")
def dry_run_report(spark: SparkSession, base: str) -> DataFrame:
    """Blocks, paragraphs and a preview of each page."""
    return stages.dry_run(_blocks(spark, base), simple.simple_paragraphs(_blocks(spark, base)))


@query(f"""WITH {LATEST_PARAGRAPHS}, v AS (SELECT doc_id, page_num, coalesce({_strip('translated_text')}, '') <> '' AND NOT coalesce(regexp_matches(translated_text, {KANA_SQL}), false) AND (NOT coalesce(regexp_matches(text, {HAN_SQL}), false) OR coalesce(regexp_matches(translated_text, {HAN_SQL}), false)) AS ok, coalesce(regexp_matches(text, {HAN_SQL}), false) AS han FROM latest)
  SELECT doc_id, page_num, count(*) FILTER (ok) AS n_good, count(*) FILTER (NOT ok) AS n_bad, count(*) FILTER (han) AS n_han FROM v GROUP BY ALL""")
def translation_quality(spark: SparkSession, base: str) -> DataFrame:
    """Good and bad translations of each page."""
    return stages.line_quality(store.latest_paragraphs(table(spark, base, "ocr_paragraphs")).withColumn("translated", F.col("translated_text")))


@query(f"""WITH RECURSIVE {RUN}, {POINTS}, {_draw_sql('blk', 'done')} {COMMANDS} (SELECT * FROM commands
  UNION ALL SELECT doc_id, page_num, para_idx, 'frame', 0, -1, x0 * 72.0::DOUBLE / dpi, y0 * 72.0::DOUBLE / dpi, x1 * 72.0::DOUBLE / dpi, y1 * 72.0::DOUBLE / dpi, 0, NULL FROM paragraphs JOIN points USING (doc_id, page_num) WHERE (x1 - x0) * 72.0::DOUBLE / dpi >= 4 AND (y1 - y0) * 72.0::DOUBLE / dpi >= 4
  UNION ALL SELECT doc_id, page_num, line_idx, 'line', 2, -1, x0 * 72.0::DOUBLE / dpi, y0 * 72.0::DOUBLE / dpi, x1 * 72.0::DOUBLE / dpi, y1 * 72.0::DOUBLE / dpi, 0, NULL FROM blk JOIN points USING (doc_id, page_num) WHERE (x1 - x0) * 72.0::DOUBLE / dpi >= 2 AND (y1 - y0) * 72.0::DOUBLE / dpi >= 2)""")
def page_commands(spark: SparkSession, base: str) -> DataFrame:
    """All draw commands of a run, in layers: outlines of clusters, their texts, outlines of lines."""
    return _run(spark, base).commands


@query(f"""WITH {POINTS}, lined AS (SELECT DISTINCT doc_id, page_num FROM ocr_paragraphs WHERE json_array_length(line_bboxes_json) > 0)
  SELECT doc_id, page_num, CASE WHEN l.doc_id IS NULL THEN 'copy' ELSE 'raster' END AS page_mode, CASE WHEN l.doc_id IS NULL THEN 'copy' ELSE 'inpaint' END AS inpaint_mode, 'raster' AS debug_mode FROM points p LEFT JOIN lined l USING (doc_id, page_num)""".replace("l.doc_id IS NULL", "NOT EXISTS (SELECT 1 FROM lined l WHERE l.doc_id = p.doc_id AND l.page_num = p.page_num)").replace(" LEFT JOIN lined l USING (doc_id, page_num)", ""))
def page_modes(spark: SparkSession, base: str) -> DataFrame:
    """How each page gets onto the output: as the options stand, with inpainting, and in debug mode."""
    lines, pages = stages.stored_line_rows(table(spark, base, "ocr_paragraphs")), _points(spark, base)
    rows = draw.page_modes(pages, lines)
    for name, options in (("inpaint_mode", {"disable_inpaint": False}), ("debug_mode", {"debug": True})):
        rows = rows.join(draw.page_modes(pages, lines, **options).withColumnRenamed("page_mode", name), PAGE)
    return rows


# --- pages in and out -----------------------------------------------------------------------------------------------------


@query(f"""WITH {LATEST_PARAGRAPHS}, {_line_sql().replace(LATEST_PARAGRAPHS + ', ', '', 1)},
  spans AS (SELECT doc_id, page_num, para_idx AS block_idx, {_strip("string_agg(coalesce(text, ''), '' ORDER BY line_idx)")} AS text, round_even(max(font_size), 1) AS font_size, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY doc_id, page_num, para_idx)
  SELECT doc_id, page_num, block_idx::BIGINT AS block_idx, text, font_size, x0, y0, x1, y1 FROM spans WHERE text <> ''""")
def native_blocks(spark: SparkSession, base: str) -> DataFrame:
    """Text blocks from spans, each printed line taken as a span of its paragraph."""
    lines = stages.stored_line_rows(table(spark, base, "ocr_paragraphs"))
    spans = lines.select(*PAGE, F.col("para_idx").alias("block_idx"), F.lit(0).alias("block_kind"), F.col("line_idx").alias("span_idx"), "text", F.col("font_size").alias("size"), "x0", "y0", "x1", "y1")
    return boxes.read_spans(spans).select(*PAGE, "block_idx", "text", "font_size", "x0", "y0", "x1", "y1")


@query("SELECT block_id FROM blocks WHERE source = 'ocr' UNION ALL SELECT block_id FROM blocks b WHERE source <> 'ocr' AND NOT EXISTS (SELECT 1 FROM blocks o WHERE o.source = 'ocr' AND o.doc_id = b.doc_id AND o.page_num = b.page_num)")
def native_or_ocr(spark: SparkSession, base: str) -> DataFrame:
    """Recognised blocks of the pages that have some, native blocks of all others."""
    rows = _blocks(spark, base)
    return boxes.keep_native_if_no_ocr(rows.where("source != 'ocr'"), rows.where("source = 'ocr'")).select("block_id")


@query(f"WITH {POINTS} SELECT doc_id, page_num, CASE WHEN page_num = 1 THEN 'translated' ELSE status END AS status FROM points")
def pages_saved(spark: SparkSession, base: str) -> DataFrame:
    """A store in the shared folder after saving all pages, and first pages once more: the other pages of their documents stay."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    pages = store.latest_pages(table(spark, base, "ocr_pages")).select(*PAGE, "status")
    store.save_pages(pages, path)
    store.save_pages(pages.where("page_num = 1").withColumn("status", F.lit("translated")), path)
    return spark.read.parquet(path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "page_num", "status")


@query(f"WITH {LATEST_PARAGRAPHS} SELECT para_idx::BIGINT AS para_idx, text, translated_text FROM latest WHERE doc_id = 7 AND page_num = 1")
def stored_page(spark: SparkSession, base: str) -> DataFrame:
    """One page of the store, in order of its paragraphs."""
    return store.load_page(store.latest_paragraphs(table(spark, base, "ocr_paragraphs")), 7, 1).select("para_idx", "text", "translated_text")


@query("""SELECT a.block_id AS a_id, b.block_id AS b_id, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.block_id < b.block_id
  WHERE greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)""")
def intersections(spark: SparkSession, base: str) -> DataFrame:
    """Common boxes of blocks of a page."""
    rows = _pairs(spark, base).withColumn("i", g.intersection(g.box("a_"), g.box("b_"))).where("i is not null")
    return rows.select(F.col("a_block_id").alias("a_id"), F.col("b_block_id").alias("b_id"), "i.*")


@query(f"""WITH w AS (SELECT cache_id, translated_text AS t, len(regexp_extract_all(translated_text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3000}}-\\x{{30ff}}]')) AS wide FROM translation_cache WHERE translated_text IS NOT NULL)
  SELECT cache_id, CASE WHEN {_strip('t')} = '' THEN 0 ELSE greatest(1, trunc(least(floor(240.0::DOUBLE * 0.95::DOUBLE / (wide + 0.5::DOUBLE * (length(t) - wide))), floor(20.0::DOUBLE * 0.95::DOUBLE), 200)))::BIGINT END AS font FROM w""")
def one_line_fonts(spark: SparkSession, base: str) -> DataFrame:
    """Largest size at which each translation stands on one line of 240 by 20 points."""
    rows = table(spark, base, "translation_cache").where("translated_text is not null")
    return rows.select("cache_id", fit.one_line_font(F.col("translated_text"), F.lit(240.0), F.lit(20.0)).alias("font"))


@query(f"WITH {LATEST_PARAGRAPHS} SELECT id, CASE WHEN len(string_split(translated_text, chr(10))) = para_idx + 1 THEN {_strip('string_split(translated_text, chr(10))[1]')} END AS first_part FROM latest")
def cluster_splits(spark: SparkSession, base: str) -> DataFrame:
    """First paragraph of each translation if it has as many lines as the paragraph's number says, else null."""
    rows = store.latest_paragraphs(table(spark, base, "ocr_paragraphs"))
    return rows.select("id", fit.split_cluster_text(F.col("translated_text"), F.col("para_idx") + 1)[0].alias("first_part"))


@query("SELECT doc_id, CASE lang WHEN 'japan' THEN 'ja' WHEN 'japanese' THEN 'ja' WHEN 'chinese' THEN 'ch_sim' WHEN 'eng' THEN 'en' ELSE lang END AS code FROM documents")
def language_codes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", t.language_alias(F.col("lang")).alias("code"))


@query(f"""WITH {POINTS} SELECT doc_id, page_num, CASE WHEN EXISTS (SELECT 1 FROM ocr_paragraphs l WHERE json_array_length(line_bboxes_json) > 0 AND l.doc_id = p.doc_id AND l.page_num = p.page_num) THEN 'image' ELSE 'copy' END AS op, width AS x1, height AS y1 FROM points p""")
def page_pictures(spark: SparkSession, base: str) -> DataFrame:
    """The lowest layer of each page's commands: its picture, or the page itself."""
    pages = _points(spark, base)
    return pdf.image_commands(draw.page_modes(pages, stages.stored_line_rows(table(spark, base, "ocr_paragraphs"))), pages).select(*PAGE, "op", "x1", "y1")


@query("SELECT date_trunc('day', ts) AS started, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    """Extension: events of each day and type."""
    return streams.windowed_counts(table(spark, base, "events"))


# --- extension: sessions --------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE)::INT, 0) AS st FROM events))
  SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n_events, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Extension: sessions of events, the one-dimensional analogue of paragraph splitting."""
    return streams.sessions(table(spark, base, "events"))
