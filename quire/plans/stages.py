"""The stages of a run: recognition, translation with drawing, both, and a dry run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fit
from ..functions.text import content_hash, has_han, stored_lines, valid_target
from ..operators import boxes, draw, layout, translate
from ..session import cut
from ..sources import store

PAGE = ["doc_id", "page_num"]


def page_batches(pages: DataFrame, size: int, start: int = 1) -> DataFrame:
    """Pages with batch_id, ``size`` pages each."""
    return pages.withColumn("batch_id", F.floor((F.col("page_num") - start) / size).cast("bigint"))


def page_points(pages: DataFrame) -> DataFrame:
    """Latest pages with width and height in points."""
    s = F.lit(72.0) / F.col("dpi")
    return store.latest_pages(pages).select(*PAGE, "dpi", "status", (F.col("width") * s).alias("width"), (F.col("height") * s).alias("height"))


def recognition_stage(blocks: DataFrame, pages: DataFrame, images: DataFrame | None = None, algorithm: str = "simple") -> DataFrame:
    """Blocks to stored paragraphs: image text dropped, blocks clustered."""
    kept = boxes.filter_image_text(blocks, images) if images is not None else blocks
    return layout.cluster(kept, boxes.page_sizes(page_points(pages), kept), algorithm)


def stored_line_rows(paragraphs: DataFrame) -> DataFrame:
    """Lines of stored paragraphs: doc_id, page_num, para_idx, line_idx, text, box, font_size."""
    rows = store.latest_paragraphs(paragraphs).select(*PAGE, "para_idx", F.posexplode(stored_lines(F.col("line_bboxes_json"))).alias("line_idx", "l"))
    return rows.select(*PAGE, "para_idx", "line_idx", "l.*")


class Translated(NamedTuple):
    """paragraphs: doc_id, page_num, para_idx, translation, level; lines: with translated; entries: new in the memory."""

    paragraphs: DataFrame
    lines: DataFrame
    entries: DataFrame


KEYS = [*PAGE, "para_idx"]


def translate_paragraphs(paragraphs: DataFrame, lines: DataFrame, memory: DataFrame, backend: translate.Backend) -> Translated:
    """Whole texts by memory and backend, and line by line, with retry, those that got none.

    ``paragraphs``: doc_id, page_num, para_idx, text; ``lines``: line_idx and text of each; ``memory``: one entry a hash. Texts
    and translations meet on the hash, so no text is shuffled with its translation.
    """
    whole, new = translate.translate_texts(paragraphs.select("text"), memory, backend)
    keyed = paragraphs.where(F.col("text").isNotNull()).select(*KEYS, content_hash(F.col("text")).alias("source_hash"))
    direct = cut(keyed.join(whole.select("source_hash", "translation"), "source_hash").select(*KEYS, "translation", F.lit("paragraph").alias("level")))
    rest = lines.join(direct.select(*KEYS), KEYS, "left_anti")
    translated, fresh = translate.translate_lines(rest, translate.upsert(memory, new), backend)
    composed = translate.compose_paragraphs(translated).withColumn("level", F.lit("line"))
    entries = new.unionByName(fresh.join(new.select("source_hash"), "source_hash", "left_anti"))
    return Translated(direct.unionByName(composed.select(direct.columns)), translated, entries)


def translation_stage(paragraphs: DataFrame, cache: DataFrame, backend: translate.Backend) -> Translated:
    """Translations of the stored paragraphs."""
    current = store.latest_paragraphs(paragraphs).select(*KEYS, "text")
    return translate_paragraphs(current, stored_line_rows(paragraphs), translate.latest_entries(cache), backend)


def translated_lines(paragraphs: DataFrame, done: Translated) -> DataFrame:
    """Each stored paragraph with its lines and their translations: KEYS, text, translation, boxes, sources, translations.

    A translation of the whole text is split over the printed lines in proportion to their lengths.
    """
    printed = F.transform(stored_lines(F.col("line_bboxes_json")), lambda x: F.struct(F.array(x["x0"], x["y0"], x["x1"], x["y1"]).alias("box"), x["text"].alias("text")))
    rows = store.latest_paragraphs(paragraphs).select(*KEYS, "text", printed.alias("_lines")).join(done.paragraphs, KEYS, "left")
    by_line = done.lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("line_idx", "translated"))).alias("_t"))
    rows = rows.join(by_line, KEYS, "left")
    lengths = F.transform("_lines", lambda x: F.length(x["text"]))
    parts = F.when(F.col("level") == "line", F.transform("_t", lambda x: x["translated"])).otherwise(fit.split_proportionally(F.coalesce("translation", F.lit("")), lengths))
    return rows.select(*KEYS, "text", F.coalesce("translation", F.lit("")).alias("translation"), F.transform("_lines", lambda x: x["box"]).alias("boxes"), F.transform("_lines", lambda x: x["text"]).alias("sources"), parts.alias("translations"))


class Rendered(NamedTuple):
    """What the stage leaves: stores, memory, debug documents and draw commands."""

    pages: DataFrame
    paragraphs: DataFrame
    memory: DataFrame
    debug: DataFrame
    commands: DataFrame


def translate_render_stage(pages: DataFrame, paragraphs: DataFrame, cache: DataFrame, backend: translate.Backend) -> Rendered:
    """Translate the recognised pages of the store and draw them: translations saved, pages marked, memory filled up."""
    wanted = store.latest_pages(pages).where(F.col("status").isin(*store.STATUSES))
    rows = store.latest_paragraphs(paragraphs).join(wanted.select(*PAGE), PAGE, "left_semi")
    done = translation_stage(rows, cache, backend)
    done = done._replace(paragraphs=cut(done.paragraphs))
    return Rendered(
        store.mark_translated(wanted, rows), store.save_translations(rows, done.paragraphs),
        translate.upsert(translate.latest_entries(cache), done.entries), store.debug_document(translated_lines(rows, done)),
        drawing(done.paragraphs, rows, pages),
    )


def save_stage(done: Rendered, root: str) -> None:
    """Write the stage into the stores under ``root``; debug documents and draw commands beside them."""
    store.save_pages(done.pages, f"{root}/pages")
    store.save_pages(done.paragraphs, f"{root}/paragraphs")
    cut(done.memory).write.mode("overwrite").parquet(f"{root}/memory")
    done.debug.write.mode("overwrite").json(f"{root}/debug")
    done.commands.write.mode("overwrite").parquet(f"{root}/commands")


def drawing(translated: DataFrame, paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Draw commands of translated paragraphs (doc_id, page_num, para_idx, translation)."""
    return draw_lines(translated, stored_line_rows(paragraphs), pages)


def draw_lines(translated: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Draw commands of translated paragraphs over their printed lines (box)."""
    lines = lines.join(store.latest_pages(pages).select(*PAGE, "dpi"), PAGE)
    areas = lines.groupBy(*KEYS, "dpi").agg(*(f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))))
    fonts = draw.median_font(lines, KEYS)
    areas = areas.join(fonts, KEYS).join(translated.select(*KEYS, "translation"), KEYS).withColumn("item_idx", F.col("para_idx"))
    return draw.text_commands(areas)


class Run(NamedTuple):
    paragraphs: DataFrame
    translated: DataFrame
    entries: DataFrame
    commands: DataFrame


def full_run(blocks: DataFrame, pages: DataFrame, cache: DataFrame, backend: translate.Backend, algorithm: str = "simple", ocr_only: bool = False, images: DataFrame | None = None) -> Run:
    """Recognition, translation (whole texts, then lines) and drawing of all pages. ``ocr_only``: the recognised text stands for its translation."""
    kept = boxes.filter_image_text(blocks, images) if images is not None else blocks
    paragraphs, lines = layout.cluster_with_lines(kept, boxes.page_sizes(page_points(pages), kept), algorithm)
    paragraphs, lines = cut(paragraphs), cut(lines)
    if ocr_only:
        composed = translate.compose_paragraphs(lines.withColumn("translated", F.col("text"))).withColumn("level", F.lit("source"))
        none = translate.latest_entries(cache).select(*translate.MEMORY).limit(0)
        done = Translated(composed, lines, none)
    else:
        done = translate_paragraphs(paragraphs.select(*KEYS, "text"), lines, translate.latest_entries(cache), backend)
        done = done._replace(paragraphs=cut(done.paragraphs))
    rows = paragraphs.join(done.paragraphs, KEYS, "left").withColumn("translation", F.coalesce("translation", F.lit("")))
    return Run(rows, done.lines, done.entries, draw_page(done.paragraphs, paragraphs, lines, pages))


def draw_page(translated: DataFrame, paragraphs: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """All commands of a page in drawing order: cluster outlines (each a paragraph), their texts, then line outlines, then other texts.

    layer 0 outlines, 1 ground and text, 2 line outlines; the columns are those of ``draw.text_commands``.
    """
    dpi = store.latest_pages(pages).select(*PAGE, "dpi")
    frames = draw.cluster_frames(paragraphs.select(*PAGE, F.col("para_idx").alias("cluster_idx"), "x0", "y0", "x1", "y1").join(dpi, PAGE))
    outlines = draw.line_frames(lines.select(*PAGE, F.col("line_idx").alias("line_no"), "x0", "y0", "x1", "y1").join(dpi, PAGE))
    texts = draw_lines(translated, lines, pages)
    boxes_ = frames.unionByName(outlines).select(*PAGE, "item_idx", "op", "layer", F.lit(-1).alias("line_no"), F.col("px0").alias("x"), F.col("py0").alias("y"), F.col("px1").alias("x1"), F.col("py1").alias("y1"), F.lit(0).alias("font"), F.lit(None).cast("string").alias("text"))
    return texts.unionByName(boxes_.select(texts.columns))


def dry_run(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Report of each page: blocks, paragraphs, origin, and the start of the first paragraph on one line."""
    per_page = blocks.groupBy(*PAGE).agg(F.count("*").alias("n_blocks"), F.bool_or(F.col("source") == "ocr").alias("has_ocr"))
    first = paragraphs.groupBy(*PAGE).agg(F.count("*").alias("n_paragraphs"), F.min_by("text", "para_idx").alias("_first"))
    preview = F.translate(F.substring("_first", 1, 80), "\n", " ")
    origin = F.when(F.col("has_ocr"), "ocr").otherwise("native")
    return per_page.join(first, PAGE, "left").select(*PAGE, "n_blocks", F.coalesce("n_paragraphs", F.lit(0)).cast("bigint").alias("n_paragraphs"), origin.alias("origin"), F.coalesce(preview, F.lit("")).alias("preview"))


def line_quality(lines: DataFrame) -> DataFrame:
    """Good and bad translated lines of each page (columns text and translated)."""
    good = valid_target(F.col("text"), F.col("translated"))
    return lines.groupBy(*PAGE).agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"), F.count_if(has_han(F.col("text"))).alias("n_han"))
