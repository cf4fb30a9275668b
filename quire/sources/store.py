"""The page store and the translation memory as Parquet, and the JSON debug sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

PAGE = ["doc_id", "page_num"]
STATUSES = ("ocr_done", "translated")
STORES = ("pages", "paragraphs", "memory", "debug")
# Columns of the stores.
PAGE_SCHEMA = "doc_id bigint, page_num bigint, width double, height double, dpi int, status string, saved_at timestamp, loaded_at timestamp"
PARAGRAPH_SCHEMA = "id bigint, doc_id bigint, page_num bigint, para_idx int, text string, translated_text string, line_bboxes_json string, saved_at timestamp"
MEMORY_SCHEMA = "source_hash string, source_text string, translated_text string"


def latest_pages(pages: DataFrame) -> DataFrame:
    """The row of each page that was saved last."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("saved_at"), F.desc("loaded_at"), F.desc("status"))
    return pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs of each page's last save, one row for each para_idx; paragraphs of earlier saves do not come back."""
    page = Window.partitionBy(*PAGE)
    order = Window.partitionBy(*PAGE, "para_idx").orderBy(F.desc("id"))
    last = paragraphs.withColumn("_last", F.max("saved_at").over(page)).where("saved_at <=> _last").drop("_last")
    return last.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def save_pages(rows: DataFrame, path: str) -> None:
    """Put the pages of ``rows`` (of the page table or of the paragraph table) into a store, in place of what it has of these pages.

    The store is partitioned by document. The documents touched are written anew with their other pages; all others are
    neither read nor written (partition pruning by the saved documents, dynamic overwrite).
    """
    spark, target = rows.sparkSession, rows
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        target = cut(rows)  # written twice otherwise: once to find the pages, once to save them
        old = spark.read.schema(rows.schema).parquet(path).join(target.select("doc_id").distinct(), "doc_id", "left_semi")
        target = target.unionByName(old.join(target.select(*PAGE).distinct(), PAGE, "left_anti").select(rows.columns))
    target.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def load_page(paragraphs: DataFrame, doc_id: int, page_num: int) -> DataFrame:
    """Paragraphs of one page in order; the filter is pushed to the scan."""
    return paragraphs.where((F.col("doc_id") == doc_id) & (F.col("page_num") == page_num)).orderBy("para_idx")


def load_batch(pages: DataFrame, paragraphs: DataFrame, start: int, end: int, only_untranslated: bool = False) -> DataFrame:
    """Pages of a range with their paragraphs, in one join. Finished pages are read again unless ``only_untranslated``."""
    wanted = latest_pages(pages).where(F.col("page_num").between(start, end) & F.col("status").isin(*STATUSES[: 1 if only_untranslated else 2]))
    rows = latest_paragraphs(paragraphs).where(F.col("page_num").between(start, end)).select(*PAGE, "para_idx", "text", "translated_text", "line_bboxes_json")
    return wanted.select(*PAGE, "width", "height", "dpi", "status").join(rows, PAGE)


def pages_to_do(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    return wanted.join(pages.select(*PAGE), PAGE, "left_anti")


def max_page(pages: DataFrame) -> DataFrame:
    return pages.agg(F.coalesce(F.max("page_num"), F.lit(0)).cast("bigint").alias("max_page"))


def untranslated_pages(pages: DataFrame) -> DataFrame:
    return latest_pages(pages).where("status = 'ocr_done'").select(*PAGE)


def mark_translated(pages: DataFrame, done: DataFrame) -> DataFrame:
    """``pages`` with status 'translated' for the pages of ``done``."""
    hits = done.select(*PAGE).distinct().withColumn("_done", F.lit(True))
    return pages.join(hits, PAGE, "left").withColumn("status", F.when(F.col("_done"), F.lit("translated")).otherwise(F.col("status"))).drop("_done")


def save_translations(paragraphs: DataFrame, translations: DataFrame) -> DataFrame:
    """``paragraphs`` with translated_text taken from ``translations`` where it has an entry."""
    new = translations.select(*PAGE, "para_idx", F.col("translation").alias("_new"))
    return paragraphs.join(new, [*PAGE, "para_idx"], "left").withColumn("translated_text", F.coalesce("_new", "translated_text")).drop("_new")


def save_run(pages: DataFrame, paragraphs: DataFrame, root: str) -> None:
    """Save recognised pages with status 'ocr_done' and their paragraphs, in place of what the store has of these pages."""
    save_pages(pages.withColumn("status", F.lit(STATUSES[0])), f"{root}/pages")
    save_pages(paragraphs, f"{root}/paragraphs")


def clean_up(spark: SparkSession, root: str) -> int:
    """Delete the stores, the memory and the debug files under ``root``; the number of folders removed."""
    removed = 0
    for name in STORES:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        removed += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
    return removed


def reset(spark: SparkSession, path: str, doc_id: int) -> None:
    """Drop one document from a store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/doc_id={doc_id}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def debug_document(rows: DataFrame) -> DataFrame:
    """One JSON text for each page: paragraphs with text, translation, and printed and translated lines paired by position, as far as both go.

    ``rows``: doc_id, page_num, para_idx, text, translation, boxes array<array<double>>, sources and translations array<string>.
    """
    n = F.least(F.size("sources"), F.size("translations"))
    zipped = F.arrays_zip(F.slice("boxes", 1, n).alias("bbox"), F.slice("sources", 1, n).alias("original"), F.slice("translations", 1, n).alias("translated"))
    pairs: Column = F.transform(zipped, lambda x: F.struct(x["bbox"].alias("bbox"), x["original"].alias("original"), x["translated"].alias("translated")))
    entry = F.struct("para_idx", F.coalesce("text", F.lit("")).alias("source_text"), F.coalesce("translation", F.lit("")).alias("translation"), pairs.alias("lines"))
    return rows.groupBy(*PAGE).agg(F.to_json(F.struct(F.first("page_num").alias("page_num"), F.sort_array(F.collect_list(entry)).alias("paragraphs"))).alias("document"))


def write_debug(lines: DataFrame, path: str) -> None:
    debug_document(lines).write.mode("overwrite").json(path)
