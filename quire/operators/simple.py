"""Simple clustering: columns by gaps in x, paragraphs by gaps in y. Pure window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import ordered_concat
from .boxes import PAGE


def split_columns(blocks: DataFrame, gap: float = 50.0) -> DataFrame:
    """``blocks`` with column_no: a new column begins where x0 exceeds the previous box's right edge by more than ``gap``."""
    order = Window.partitionBy(*PAGE).orderBy("x0", "y0", "block_idx")
    starts = F.coalesce((F.col("x0") - F.lag("x1").over(order) > gap).cast("int"), F.lit(0))
    return blocks.withColumn("_s", starts).withColumn("column_no", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def split_paragraphs(columns: DataFrame, ratio: float = 1.5, least: float = 4.0) -> DataFrame:
    """Blocks with column_no to blocks with para_no inside the column: a new one where the gap exceeds max(previous height * ratio, least)."""
    order = Window.partitionBy(*PAGE, "column_no").orderBy("y0", "x0", "block_idx")
    previous = F.lag("y1").over(order)
    limit = F.greatest((previous - F.lag("y0").over(order)) * ratio, F.lit(least))
    starts = F.coalesce((F.col("y0") - previous > limit).cast("int"), F.lit(0))
    return columns.withColumn("_s", starts).withColumn("para_no", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def numbered_blocks(blocks: DataFrame, ratio: float = 1.5, gap: float = 50.0) -> DataFrame:
    """``blocks`` with para_idx on the page and line_idx in the paragraph."""
    rows = split_paragraphs(split_columns(blocks, gap), ratio)
    page = Window.partitionBy(*PAGE).orderBy("column_no", "para_no")
    line = Window.partitionBy(*PAGE, "column_no", "para_no").orderBy("y0", "x0", "block_idx")
    return rows.withColumns({"para_idx": F.dense_rank().over(page) - 1, "line_idx": F.row_number().over(line) - 1})


def simple_paragraphs(blocks: DataFrame, ratio: float = 1.5, gap: float = 50.0) -> DataFrame:
    """Paragraphs of every page in reading order: para_idx, column_no, text, box, n_lines, font_size."""
    rows = split_paragraphs(split_columns(blocks, gap), ratio)
    # all three steps share the page as partition key, so Spark keeps one shuffle
    paras = rows.groupBy(*PAGE, "column_no", "para_no").agg(
        ordered_concat(F.struct("y0", "x0", "block_idx"), F.col("text")).alias("text"), *g.union_box(),
        F.count("*").alias("n_lines"), F.coalesce(F.avg(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(0.0)).alias("font_size"),
    )
    index = F.row_number().over(Window.partitionBy(*PAGE).orderBy("column_no", "para_no")) - 1
    return paras.withColumn("para_idx", index)


def one_cluster_each(paragraphs: DataFrame) -> DataFrame:
    """Each paragraph is a cluster of its own."""
    return paragraphs.withColumns({"cluster_idx": F.col("para_idx"), "para_idxs": F.array("para_idx")})
