"""Translation with a content-hashed memory: lookup, batched requests, bounded retry.

A backend is any object with ``translate_json(requests)`` and ``translate_text(texts)``, both DataFrame to DataFrame;
backends that call a service (``services``) do so inside ``mapInPandas``. Replies are checkpointed, so a lost executor
does not ask again. ``DictionaryBackend`` answers from a table. Memory and texts meet on the hash of the text.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut

#: Lines in a request, requests after the first for lines that failed, pages whose lines are numbered together.
CHUNK, RETRIES, BATCH_PAGES = 50, 3, 3


class Backend(Protocol):
    def translate_json(self, requests: DataFrame) -> DataFrame:
        """chunk_id, request -> chunk_id, reply (JSON)."""

    def translate_text(self, texts: DataFrame) -> DataFrame:
        """source_text -> source_text, reply."""


class DictionaryBackend:
    """Replies from a table (source_text, translated_text); deterministic, for tests and offline runs."""

    def __init__(self, table: DataFrame):
        rank = F.row_number().over(Window.partitionBy("source_text").orderBy("translated_text"))
        self.table = table.where("source_text is not null").withColumn("_n", rank).where("_n = 1").select("source_text", F.col("translated_text").alias("_reply"))

    def translate_text(self, texts: DataFrame) -> DataFrame:
        return texts.join(self.table, "source_text", "left").select("source_text", F.coalesce("_reply", F.lit("")).alias("reply"))

    def translate_json(self, requests: DataFrame) -> DataFrame:
        items = requests.select("chunk_id", F.explode(F.from_json("request", t.REQUEST_SCHEMA)["items"]).alias("i"))
        answered = items.select("chunk_id", F.col("i.id").alias("id"), F.col("i.text").alias("source_text")).join(self.table, "source_text", "left")
        rows = answered.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_reply", F.lit("")).alias("text")))).alias("items"))
        return rows.select("chunk_id", F.to_json(F.struct("items")).alias("reply"))


BACKENDS: dict[str, type] = {"dictionary": DictionaryBackend}


def register_backend(name: str, backend: type) -> None:
    BACKENDS[name] = backend


def create_backend(name: str, *args: object, **options: object) -> Backend:
    """A registered backend; an unknown name is an error."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](*args, **options)


def latest_entries(cache: DataFrame) -> DataFrame:
    """One entry for each hash: the one written last (version, then time, then id)."""
    order = Window.partitionBy("source_hash").orderBy(F.desc("version_no"), F.desc_nulls_last("written_at"), F.desc("cache_id"))
    return cache.where("source_hash is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def look_up(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct non-null texts with their cached translation or null: source_text, source_hash, translated_text."""
    distinct = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("source_text"), t.content_hash(F.col(text_col)).alias("source_hash")).groupBy("source_hash").agg(F.min("source_text").alias("source_text"))
    return distinct.join(latest_entries(cache).select("source_hash", "translated_text"), "source_hash", "left").select("source_text", "source_hash", "translated_text")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with ``new`` (source_text, translated_text) put in; a new entry replaces the old one of its hash."""
    fresh = new.withColumn("source_hash", t.content_hash(F.col("source_text"))).groupBy("source_hash").agg(F.max_by("source_text", "translated_text").alias("source_text"), F.max("translated_text").alias("translated_text"))
    old = cache.join(fresh.select("source_hash"), "source_hash", "left_anti")
    return old.select("source_hash", "source_text", "translated_text").unionByName(fresh.select("source_hash", "source_text", "translated_text"))


def number_lines(lines: DataFrame, batch_pages: int | None = None) -> DataFrame:
    """Non-blank lines numbered from 0 over page, paragraph and line, inside each batch of pages of a document."""
    rows = lines.where(~t.is_blank(F.col("text")))
    batch = F.floor((F.col("page_num") - 1) / batch_pages).cast("bigint") if batch_pages else F.lit(0).cast("bigint")
    rows = rows.withColumn("batch_id", batch)
    order = Window.partitionBy("doc_id", "batch_id").orderBy("page_num", "para_idx", "line_idx")
    return rows.withColumn("gid", F.row_number().over(order) - 1)


def chunk_lines(numbered: DataFrame, size: int = CHUNK) -> DataFrame:
    return numbered.withColumn("chunk_no", F.floor(F.col("gid") / size).cast("bigint"))


def build_requests(chunked: DataFrame, source: str = "ja", target: str = "zh") -> DataFrame:
    """One JSON request for each chunk: chunk_id, request."""
    items = F.sort_array(F.collect_list(F.struct(F.col("gid").cast("int").alias("id"), F.col("text").alias("text"))))
    return chunked.groupBy("chunk_id").agg(t.request_json(items, source, target).alias("request"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Usable items of the replies: chunk_id, gid, reply. Null ids, blank and echoing texts are skipped; of repeated ids the last wins."""
    items = replies.select("chunk_id", F.posexplode(t.reply_items(F.col("reply"))).alias("pos", "i"))
    items = items.select("chunk_id", "pos", F.col("i.id").cast("bigint").alias("gid"), t.strip(F.col("i.text")).alias("reply"))
    good = items.where(F.col("gid").isNotNull() & ~t.prompt_echo(F.col("reply")))
    return good.groupBy("chunk_id", "gid").agg(F.max_by("reply", "pos").alias("reply"))


def match_replies(chunked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Lines with their reply, '' where there is none; unknown ids are dropped by the join."""
    return chunked.join(parsed, ["chunk_id", "gid"], "left").withColumn("reply", F.coalesce("reply", F.lit("")))


def accepted(source: Column, reply: Column) -> Column:
    """A line's reply that needs no retry."""
    return t.valid_target(source, reply) & ~t.identity_failure(source, reply)


def storable(source: Column, reply: Column) -> Column:
    """A reply that goes into the memory and may be taken from it."""
    return ~t.identity_failure(source, reply) & ~t.prompt_echo(reply)


MEMORY = ["source_hash", "source_text", "translated_text"]


def _new_entries(answered: DataFrame) -> DataFrame:
    """Entries for the memory from (source_hash, text, reply): one for each hash."""
    return answered.groupBy("source_hash").agg(F.min("text").alias("source_text"), F.max("reply").alias("translated_text"))


def ask_lines(lines: DataFrame, memory: DataFrame, backend: Backend, keys: list[str], size: int = CHUNK, batch_pages: int = BATCH_PAGES) -> tuple[DataFrame, DataFrame]:
    """``keys``, text and reply ('' for none) of non-blank lines: from the memory, else asked in chunks; and the new entries."""
    known = memory.select("source_hash", F.col("translated_text").alias("_known"))
    chunked = chunk_lines(number_lines(lines, batch_pages), size).withColumn("chunk_id", F.concat_ws("-", "doc_id", "batch_id", "chunk_no"))
    found = chunked.withColumn("source_hash", t.content_hash(F.col("text"))).join(known, "source_hash", "left")
    hit = F.col("_known").isNotNull() & storable(F.col("text"), F.col("_known"))
    found = cut(found.withColumn("_known", F.when(hit, F.col("_known"))))
    misses = found.where("_known is null").drop("_known")
    answers = cut(match_replies(misses, parse_replies(backend.translate_json(build_requests(misses)))).select(*keys, "source_hash", "text", "reply"))
    new = _new_entries(answers.where((F.col("reply") != "") & storable(F.col("text"), F.col("reply"))))
    return found.where("_known is not null").select(*keys, "text", F.col("_known").alias("reply")).unionByName(answers.drop("source_hash")), new


def translate_lines(lines: DataFrame, memory: DataFrame, backend: Backend, retries: int = RETRIES, size: int = CHUNK, batch_pages: int = BATCH_PAGES) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, page_num, para_idx, line_idx, text) with translated text, and the new entries of the memory.

    One request, then at most ``retries`` for lines whose reply is blank, not Chinese or the source again; it ends early when
    nothing is left or a retry brings nothing new. A line that is never answered well keeps its first reply. Each round is
    written to the shared checkpoint folder.
    """
    keys = ["doc_id", "page_num", "para_idx", "line_idx"]
    memory = memory.select(*MEMORY)
    first, new = ask_lines(lines.select(*keys, "text"), memory, backend, keys, size, batch_pages)
    good = accepted(F.col("text"), F.col("reply"))
    done, todo, entries = first.where(good), first.where(~good), new
    failed, left = todo, todo.count()
    for _ in range(retries):
        if not left:
            break
        memory = upsert(memory, new)
        answered, new = ask_lines(failed.select(*keys, "text"), memory, backend, keys, size, batch_pages)
        answered = cut(answered)
        entries = entries.unionByName(new)
        better = answered.where(good)
        done = done.unionByName(better)
        failed = answered.where(~good)
        count = failed.count()
        if count == left:
            break
        left = count
    best = done.unionByName(todo.join(done.select(*keys), keys, "left_anti")).select(*keys, F.col("reply").alias("translated"))
    out = lines.join(best, keys, "left").withColumn("translated", F.coalesce("translated", F.lit("")))
    return out, entries.groupBy("source_hash").agg(F.min("source_text").alias("source_text"), F.max("translated_text").alias("translated_text"))


def translate_texts(texts: DataFrame, memory: DataFrame, backend: Backend) -> tuple[DataFrame, DataFrame]:
    """Whole texts: (source_hash, source_text, translation, from_cache), without those that have no translation; and the new entries.

    A known translation holds unless it is empty or the source again. All others are asked one by one in JSON, and freely
    where that reply is blank or repeats the request.
    """
    distinct = texts.where(~t.is_blank(F.col("text"))).withColumn("source_hash", t.content_hash(F.col("text"))).groupBy("source_hash").agg(F.min("text").alias("text"))
    found = cut(distinct.join(memory.select("source_hash", F.col("translated_text").alias("_known")), "source_hash", "left"))
    source = F.col("text")
    hit = F.coalesce(F.col("_known") != "", F.lit(False)) & ~t.identity_failure(source, F.col("_known"))
    hits = found.where(hit).select("source_hash", F.col("text").alias("source_text"), F.col("_known").alias("translation"), F.lit(True).alias("from_cache"))
    misses = found.where(~hit).select(F.col("source_hash").alias("chunk_id"), "text", F.lit(0).cast("bigint").alias("gid"))
    answers = cut(match_replies(misses, parse_replies(backend.translate_json(build_requests(misses)))))
    free = backend.translate_text(answers.where("reply = ''").select(F.col("text").alias("source_text"))).select(t.content_hash(F.col("source_text")).alias("chunk_id"), t.strip(F.coalesce("reply", F.lit(""))).alias("_free"))
    answers = cut(answers.join(free, "chunk_id", "left").select(F.col("chunk_id").alias("source_hash"), "text", F.when(F.col("reply") != "", F.col("reply")).otherwise(F.coalesce("_free", F.lit(""))).alias("reply")))
    new = _new_entries(answers.where(storable(source, F.col("reply"))))
    good = answers.where(~t.is_blank(F.col("reply")) & ~t.identity_failure(source, F.col("reply")))
    return hits.unionByName(good.select("source_hash", F.col("text").alias("source_text"), F.col("reply").alias("translation"), F.lit(False).alias("from_cache"))), new


def compose_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraph translations from their lines, joined by line breaks."""
    return lines.groupBy("doc_id", "page_num", "para_idx").agg(t.ordered_concat(F.col("line_idx"), F.col("translated"), "\n").alias("translation"))
