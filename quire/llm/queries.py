"""The queries pN_... of this subpackage, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import simple
from ..session import cut
from ..sources.tables import table
from . import alignment, encoding, formatting_copies, lookalike, misreads, packing, pairs, reading_level, scan_noise, splitting


def _limit(spark: SparkSession, base: str, name: str) -> tuple[int, int]:
    row = table(spark, base, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    return int(row.max_size), int(row.overlap_size)


def _two(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    return a.withColumn("src_table", F.lit(name_a)).unionByName(b.withColumn("src_table", F.lit(name_b)))


def translated_pages(spark: SparkSession, base: str) -> DataFrame:
    """doc_id and page_num of the pages whose latest row in the page store is 'translated'."""
    latest = table(spark, base, "ocr_pages").groupBy("doc_id", "page_num").agg(F.max_by("status", F.struct("saved_at", "loaded_at", "status")).alias("status"))
    return latest.where("status = 'translated'").select("doc_id", "page_num")


def _prompts_and_answers(spark: SparkSession, base: str) -> DataFrame:
    """Sources and translations of both tables: prompt, answer, src_table, row_id, doc_id, page_num."""
    cache, paras = table(spark, base, "translation_cache"), table(spark, base, "ocr_paragraphs")
    of_cache = cache.select(F.col("source_text").alias("prompt"), F.col("translated_text").alias("answer"), F.lit("translation_cache").alias("src_table"), F.col("cache_id").alias("row_id"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_num"))
    of_paras = paras.select(F.col("text").alias("prompt"), F.col("translated_text").alias("answer"), F.lit("ocr_paragraphs").alias("src_table"), F.col("id").alias("row_id"), "doc_id", "page_num")
    return of_cache.unionAll(of_paras)


def _defect_model(both: DataFrame) -> pairs.DefectModel:
    """The model by which p1_found and p3_found judge alike."""
    return pairs.DefectModel(formatting_copies.learn_labels(both, "prompt"), pairs.learn_endings(both))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Defective answers: src_table, row_id, defect. The pages are joined to the defects alone."""
    both = _prompts_and_answers(spark, base)
    found = cut(pairs.find_defects(both, _defect_model(both), ["src_table", "row_id", "doc_id", "page_num"]))
    on_pages = found.where("src_table = 'ocr_paragraphs'").join(translated_pages(spark, base), ["doc_id", "page_num"], "left_semi")
    return found.where("src_table = 'translation_cache'").select("src_table", "row_id", "defect").unionAll(on_pages.select("src_table", "row_id", "defect"))


def _copy_rows(spark: SparkSession, base: str) -> DataFrame:
    cache, paras = table(spark, base, "translation_cache"), table(spark, base, "ocr_paragraphs")
    labels = formatting_copies.learn_labels(cache.select(F.col("source_text").alias("text")).unionAll(paras.select("text")))
    rows = _two(formatting_copies.keyed_rows(cache, "cache_id", "source_text", labels), formatting_copies.keyed_rows(paras, "id", "text", labels), "translation_cache", "ocr_paragraphs")
    return cut(rows)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Surplus copies: src_table, keep_id, row_id."""
    rows = _copy_rows(spark, base)
    records = formatting_copies.collapse(rows, ["src_table", "key"])
    return formatting_copies.surplus(rows, records, ["src_table", "key"]).select("src_table", "keep_id", "row_id")


def p2_records(spark: SparkSession, base: str) -> DataFrame:
    """One record for each text or form, with the number of its copies."""
    return formatting_copies.collapse(_copy_rows(spark, base), ["src_table", "key"]).select("src_table", "keep_id", "n_copies")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Sentences that translate each other: para_id, ja_sent, zh_sent. The pages are joined to the links alone.

    The table is estimated over all translated paragraphs, also those whose sentences are not asked for.
    """
    rows = table(spark, base, "ocr_paragraphs").select("id", "doc_id", "page_num", F.col("text").alias("source"), F.col("translated_text").alias("target"))
    rows = rows.where(F.col("target").rlike("[\\u3400-\\u9fff\\uf900-\\ufaff]"))
    encoded = cut(alignment.encode_units(rows))
    source, target, info = alignment.unit_frequency(encoded)
    counts = alignment.learn_table(encoded, source, target)
    rows = rows.where((F.length("source") <= 700) & F.col("source").rlike("[。．！？]"))
    model = _defect_model(_prompts_and_answers(spark, base))
    links = cut(alignment.align_pairs(rows, source, target, info, counts, ["id", "doc_id", "page_num"], lambda s, t: model.defect(s, t) is not None))
    on_pages = links.join(translated_pages(spark, base), ["doc_id", "page_num"], "left_semi")
    return on_pages.select(F.col("id").alias("para_id"), F.col("source_sentence").alias("ja_sent"), F.col("target_sentence").alias("zh_sent"))


#: Volumes up to which their titles are broadcast (a title and at most 1 / HEAD_SHARE heads each); more are joined over salts.
TITLE_ROWS, TITLE_SALTS = 50_000, 16


def _with_titles(rows: DataFrame, titles: DataFrame, n_titles: int, id_col: str) -> DataFrame:
    """``rows`` with title and heads of their volume. One volume may hold a third of all rows, so many volumes are repeated over salts."""
    if n_titles <= TITLE_ROWS:
        return rows.join(F.broadcast(titles), "doc_id", "left")
    salted = titles.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(TITLE_SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(TITLE_SALTS)).cast("int")).join(salted, ["doc_id", "_salt"], "left").drop("_salt")


def _noise(spark: SparkSession, base: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Noise of blocks (with the ``keep`` columns, doc_id among them) and of paragraphs."""
    paras, blocks = table(spark, base, "ocr_paragraphs"), table(spark, base, "blocks")
    judge = misreads.learn_judge(paras.select("text").unionAll(blocks.select("text")))
    in_points = F.lit(72.0) / F.when(F.col("coord_dpi") > 0, F.col("coord_dpi"))
    height = F.abs(F.col("y1") - F.col("y0"))
    lines = blocks.withColumns({
        "top": F.least("y0", "y1") * in_points,
        "size": F.when(height > 0, height).otherwise(F.when(F.col("font_size") > 0, F.col("font_size"))) * in_points,
    })
    heads = scan_noise.repeated_heads(lines)
    titles = cut(table(spark, base, "pdf_files").groupBy("doc_id").agg(F.min("title").alias("title")).join(heads, "doc_id", "full"))
    lines = _with_titles(lines.select("block_id", "text", "top", "size", "block_type", *(("doc_id",) if not keep else keep)), titles, titles.count(), "block_id")
    paras = _with_titles(paras.select("id", "doc_id", "text"), titles, titles.count(), "id")
    return scan_noise.find_noise(lines, judge, "block_id", False, keep), scan_noise.find_noise(paras, judge, "id", True)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Kinds of scanning noise in each text: src_table, row_id, noise_kind."""
    return _two(*_noise(spark, base), "blocks", "ocr_paragraphs").select("src_table", "row_id", F.explode("kinds").alias("noise_kind"))


LINE_COLUMNS = ("doc_id", "page_num", "block_idx", "x0", "y0", "x1", "y1", "font_size")


def p4_repaired(spark: SparkSession, base: str) -> DataFrame:
    """Every text repaired to a continuous readable one: src_table, row_id, repaired. Words cut by a line end stand whole in its block."""
    lines, paras = _noise(spark, base, LINE_COLUMNS)
    lines = scan_noise.join_cut_lines(cut(lines))
    return _two(lines.select("row_id", "repaired"), paras.select("row_id", "repaired"), "blocks", "ocr_paragraphs").select("src_table", "row_id", "repaired")


def p4_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    """The repaired printed lines of each page as paragraphs, without page furniture: doc_id, page_num, para_idx, text."""
    lines = scan_noise.join_cut_lines(cut(_noise(spark, base, LINE_COLUMNS)[0]))
    rows = lines.where("repaired != ''").withColumnRenamed("repaired", "text")
    return simple.simple_paragraphs(rows).select("doc_id", "page_num", F.col("para_idx").cast("bigint").alias("para_idx"), "text")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Natural boundaries in paragraphs above the limit: para_id, cut_pos."""
    size, overlap = _limit(spark, base, "paragraph_piece")
    cut_up = splitting.split_long_texts(table(spark, base, "ocr_paragraphs"), size, overlap)
    return cut_up.select(F.col("id").alias("para_id"), F.explode("boundaries").alias("cut_pos"))


def p5_pieces(spark: SparkSession, base: str) -> DataFrame:
    """The pieces of paragraphs above the limit."""
    size, overlap = _limit(spark, base, "paragraph_piece")
    cut_up = splitting.split_long_texts(table(spark, base, "ocr_paragraphs"), size, overlap)
    return cut_up.select(F.col("id").alias("para_id"), F.explode("pieces").alias("p")).select("para_id", "p.*")


def _look_alike_rows(spark: SparkSession, base: str) -> DataFrame:
    blocks, cache = table(spark, base, "blocks"), table(spark, base, "translation_cache")
    frequency = lookalike.member_frequency(blocks.select("text").unionAll(cache.select(F.col("source_text").alias("text"))), "text")
    return _two(lookalike.digests(blocks, "block_id", "text", frequency), lookalike.digests(cache, "cache_id", "source_text", frequency), "blocks", "translation_cache")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows that look the same but differ in code points: src_table, id_a, id_b."""
    return lookalike.equal_looking_pairs(cut(_look_alike_rows(spark, base)), ["src_table"]).select("src_table", "id_a", "id_b")


def p6_classes(spark: SparkSession, base: str) -> DataFrame:
    """Class and number of links of every row that looks like a row of other code points: src_table, row_id, class_id, n_links."""
    return lookalike.look_alike_groups(cut(_look_alike_rows(spark, base)), ["src_table"])


def p6_forms(spark: SparkSession, base: str) -> DataFrame:
    """Every text in its consistent form."""
    blocks, cache = table(spark, base, "blocks"), table(spark, base, "translation_cache")
    frequency = lookalike.member_frequency(blocks.select("text").unionAll(cache.select(F.col("source_text").alias("text"))), "text")
    rows = _two(blocks.select(F.col("block_id").alias("row_id"), "text"), cache.select(F.col("cache_id").alias("row_id"), F.col("source_text").alias("text")), "blocks", "translation_cache")
    return lookalike.consistent_form(rows, "text", frequency).select("src_table", "row_id", "canonical")


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document: doc_id, ids."""
    return encoding.encode_corpus(table(spark, base, "documents"))


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    """Documents in containers of token_container's capacity."""
    capacity, _ = _limit(spark, base, "token_container")
    docs = table(spark, base, "documents")
    return packing.fill_containers(encoding.count_tokens(docs), capacity, n_items=docs.count())


def _reading_levels(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    familiar = reading_level.familiar_words(docs)
    formula = reading_level.fit_formula(reading_level.collect_samples(table(spark, base, "graded_samples")), familiar)
    return reading_level.profile(docs, familiar, formula)


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Reading level of every document of running prose: doc_id, reading_level."""
    return _reading_levels(spark, base).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, base: str) -> DataFrame:
    """The familiar-word formula's terms and level of every document of running prose."""
    return _reading_levels(spark, base)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_records, p3_found, p4_found, p4_repaired, p4_paragraphs, p5_found, p5_pieces, p6_found, p6_classes, p6_forms, p7_ids, p8_containers, p9_found, p9_profile)
}

#: Queries of this package that SQL can express on whole tables.
ORACLES: dict[str, str] = {}
