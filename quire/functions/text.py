"""Text predicates and conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a Unicode-aware strip removes.
BLANK = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
KANA = "[\\u3040-\\u309f\\u30a0-\\u30ff]"
HAN = "[\\u4e00-\\u9fff]"
# Phrases of the request that a reply must not repeat.
ECHO_MARKERS = (
    "translate the following", "output only", "json object", "items array", "simplified chinese", "single paragraph",
    "do not explain", "不要解释", "翻译以下", "简体中文", "只输出", "单个段落",
)
# Bullets that open a paragraph.
BULLETS = "•◦▪●○・·\\-–"
# Names of languages that stand for codes.
LANGUAGE_ALIASES = {"japan": "ja", "ja": "ja", "japanese": "ja", "chinese": "ch_sim", "eng": "en"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def has_kana(c: Column) -> Column:
    return F.coalesce(c.rlike(KANA), F.lit(False))


def has_han(c: Column) -> Column:
    return F.coalesce(c.rlike(HAN), F.lit(False))


def identity_failure(source: Column, reply: Column) -> Column:
    """The reply is the source again although the source needs translating."""
    return F.coalesce(strip(reply) == strip(source), F.lit(False)) & (has_kana(source) | has_han(source))


def prompt_echo(reply: Column, markers: tuple[str, ...] = ECHO_MARKERS) -> Column:
    """The reply is blank or repeats a phrase of the request."""
    low = F.lower(reply)
    found = F.lit(False)
    for m in markers:
        found = found | F.coalesce(low.contains(m), F.lit(False))
    return is_blank(reply) | found


def valid_target(source: Column, reply: Column) -> Column:
    """Non-blank, without kana, and with Han if the source has Han."""
    return ~is_blank(reply) & ~has_kana(reply) & (~has_han(source) | has_han(reply))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def starts_paragraph(c: Column) -> Column:
    """Indent, numbering or a bullet at the start of the text."""
    s = lstrip(c)
    marked = s.rlike("^(?:\\([0-9]{1,2}\\)|[0-9]{1,2}[.)]|[\\u2460-\\u2473\\u2776-\\u277f])(?:[\\s\\u3000]|$)") | s.rlike(f"^[{BULLETS}]")
    return F.coalesce((s != "") & (c.startswith("　") | c.startswith("  ") | marked), F.lit(False))


def language_alias(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), c)


def ordered_concat(order: Column, text: Column, separator: str = "") -> Column:
    """Aggregate: texts joined in the order of ``order`` (a struct or scalar)."""
    items = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(items, lambda x: x["t"]), separator)


REQUEST_SCHEMA = "source string, target string, items array<struct<id:int,text:string>>"
REPLY_SCHEMA = "items array<struct<id:int,text:string>>"


def request_json(ids_and_texts: Column, source: str = "ja", target: str = "zh") -> Column:
    return F.to_json(F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), ids_and_texts.alias("items")))


def reply_items(reply: Column) -> Column:
    """Items of a reply; malformed JSON gives null."""
    return F.from_json(reply, REPLY_SCHEMA, {"mode": "PERMISSIVE"})["items"]


LINES_SCHEMA = "array<array<string>>"


def stored_lines(json: Column) -> Column:
    """Lines of the store's JSON ([[x0, y0, x1, y1], text, font size]) as an array of structs."""
    raw = F.from_json(json, LINES_SCHEMA)
    corner = "array<double>"
    return F.transform(raw, lambda e: F.struct(
        F.from_json(e[0], corner)[0].alias("x0"), F.from_json(e[0], corner)[1].alias("y0"),
        F.from_json(e[0], corner)[2].alias("x1"), F.from_json(e[0], corner)[3].alias("y1"),
        e[1].alias("text"), e[2].cast("double").alias("font_size"),
    ))
