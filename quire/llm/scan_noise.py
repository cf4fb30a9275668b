"""Problem 4: find and repair the noise of scanned pages.

Kinds: 'hyphen' (a word cut by the end of a printed line), 'misread' (wrongly recognised characters, see ``misreads``),
'running_head' and 'page_no' (printed page furniture, as a row of its own or as a line inside a paragraph).

A running head is the volume's title (spaced out, bracketed, with chapter or part, misread in a character, cut off at
either end), or a line that stands first on a good part of the volume's pages (``repeated_heads``). Its place on the page
alone makes no line a head.

Results for the special cases: null and empty texts have no noise and are repaired to themselves; repeated rows are
judged each; a row without geometry is judged by its text alone; extra columns are ignored; empty tables give no rows;
of equally near corrections the more frequent word wins, then the alphabetically first.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .misreads import HYPHENS, INNER_HYPHEN, Judge

#: Larger type, in points, is a title; a short piece of the title is a head only nearer to the edge than this.
TITLE_PT, MARGIN_PT = 16.0, 27.0
#: A line is a head if it stands first on this share of the volume's pages, and on this number at least.
HEAD_SHARE, HEAD_PAGES = 0.2, 3

_BRACKETS = "\\s【】\\[\\]〔〕〈〉《》"
_PAGE_MARK = re.compile(r"[-–—―・]\s*[0-9０-９]{1,4}\s*[-–—―・]|p{1,2}\.?\s?[0-9]{1,4}|P\.\s?[0-9]{1,4}|\[[0-9]{1,4}\]|［[0-9０-９]{1,4}］|[(（][0-9]{1,4}[)）]\s*$|第\s*[0-9０-９一二三四五六七八九十百〇]{1,5}\s*[頁ページ]+|[0-9０-９]{1,4}\s*[/／]\s*[0-9０-９]{1,5}|[0-9]{1,4}\s*(?:頁|ページ)")
_BARE_NUMBER = re.compile(r"[0-9０-９]{1,4}|[一二三四五六七八九十百〇]{1,4}")
_HEAD_EXTRA = re.compile(r"第[0-9一二三四五六七八九十〇]+[章編部節回巻号]|巻[一二三四五六七八九十0-9]+|[上中下続]|その[一二三四五0-9]+")
_END_HYPHEN = re.compile(rf"(?<![A-Za-z0-9\-])([A-Za-z][A-Za-z0-9]*)[{HYPHENS}]\s*$", re.S)


def _flat(text: str) -> str:
    return re.sub(f"[{_BRACKETS}]", "", text)


def is_page_number(line: str) -> bool:
    """Whether the line is nothing but a marked page number such as "- 3 -", "p. 3" or "3/120"."""
    return _PAGE_MARK.fullmatch(line.strip()) is not None


def is_head(line: str, title: str | None, repeated: frozenset[str] | None = None, least: int = 4) -> bool:
    """Whether the line is the volume's title, perhaps spaced out, bracketed, cut off or with chapter and part, or one of its ``repeated`` heads.

    ``least``: letters that a piece of the title needs.
    """
    if repeated and head_key(line) in repeated:
        return True
    if not title or len(line) > 4 * len(title) + 12:
        return False
    flat, own = _flat(line), _flat(title)
    if len(flat) > len(own) + 10 or len(flat) < least:
        return False
    if own in flat:
        return _HEAD_EXTRA.sub("", flat.replace(own, "", 1)) == ""
    core = _HEAD_EXTRA.sub("", flat, count=1) if flat.startswith("第") else flat
    for x in {core, re.sub(r"(?:巻.|[上中下続])$", "", core)}:
        if len(x) == len(own) and sum(a != b for a, b in zip(x, own)) <= max(1, len(own) // 6):
            return True
        # cut off at either end; names of places and houses differ by one character, so only a long piece may hold a misread one
        if least <= len(x) < len(own) <= 2 * len(x) + 2 * (4 - least):
            for part in (own[: len(x)], own[-len(x) :]):
                wrong = sum(a != b for a, b in zip(x, part))
                if wrong == 0 or wrong == 1 and len(x) >= 8 and x[-1] == part[-1] and x[0] == part[0]:
                    return True
    return False


def head_key(line: str) -> str:
    """What a head has in common on all pages: no spaces and brackets, chapter and part left out, figures alike."""
    return re.sub("[0-9０-９]", "9", _HEAD_EXTRA.sub("", _flat(line)))


def parts(text: str, title: str | None, repeated: frozenset[str] | None = None) -> tuple[str, bool, bool]:
    """The paragraph without page furniture, and whether it held a head or a page number."""
    lines = text.split("\n")
    if len(lines) == 1:
        return text, is_head(text, title, repeated), is_page_number(text)
    head = number = False
    kept, kinds = [], []
    for line in lines:
        kinds.append("page" if is_page_number(line) else "head" if is_head(line, title, repeated) else "bare" if _BARE_NUMBER.fullmatch(line.strip()) else "")
    for k, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "bare" and len(lines) > 2:
            # a printed line of a paragraph is never so short unless it is the last
            kind = "page" if k + 1 < len(lines) or kinds[k - 1] == "head" else ""
        if kind == "page":
            number = True
        elif kind == "head":
            head = True
        else:
            kept.append(line)
    return "\n".join(kept), head, number


def apply_repairs(text: str, repairs: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, right in repairs:
        if start >= at:
            out += [text[at:start], right]
            at = end
    return "".join(out) + text[at:]


def join_hyphens(text: str) -> tuple[str, bool]:
    """Words cut by a line end put together again, and whether there was one."""
    found = False

    def one(m: re.Match[str]) -> str:
        nonlocal found
        first, second = m.group(1), m.group(3)
        if len(first) < 2 or first[:2].isupper() or sum(x.isalpha() for x in first) * 2 <= len(first):
            return m.group()
        found = True
        return first + second

    return (INNER_HYPHEN.sub(one, text), found) if any(h in text for h in HYPHENS) else (text, False)


def ends_in_hyphen(text: str) -> bool:
    """Whether a printed line ends inside a word; codes and numbers before the hyphen do not count."""
    m = _END_HYPHEN.search(text)
    if not m:
        return False
    word = m.group(1)
    letters = sum(x.isalpha() for x in word)
    if letters < 2 or letters <= len(word) - letters or word[:2].isupper():
        return False
    if text.rstrip()[-1] in "=¬­" or letters >= 3:
        return True
    before, last = text[: m.start()][-2:-1], text[: m.start()][-1:]
    return last != "" and last in "「『に" or last == " " and before.isascii() and before.isalpha()


def noise_of_paragraph(text: str, title: str | None, repeated: frozenset[str] | None, judge: Judge) -> tuple[list[str], str]:
    """Kinds of noise and the repaired, continuous text."""
    body, head, number = parts(text, title, repeated)
    body, hyphen = join_hyphens(body)
    flat = body.replace("\n", "")
    repairs = judge.repairs(flat, False)
    kinds = [k for k, on in (("hyphen", hyphen), ("misread", bool(repairs)), ("running_head", head), ("page_no", number)) if on]
    return kinds, apply_repairs(flat, repairs)


def noise_of_line(text: str, title: str | None, repeated: frozenset[str] | None, top: float | None, size: float | None, block_type: str | None, judge: Judge) -> tuple[list[str], str]:
    """The same for a printed line; ``top`` and ``size`` in points. Page furniture is repaired to the empty text."""
    stripped = text.strip()
    table = block_type == "table"
    if not table and (is_page_number(stripped) or _BARE_NUMBER.fullmatch(stripped)):
        return ["page_no"], ""
    large = size is not None and size >= TITLE_PT
    in_margin = top is not None and 0 < top < MARGIN_PT
    if not table and not large and stripped and is_head(stripped, title, repeated, 2 if in_margin else 4):
        misread = bool(judge.repairs(text, True))
        return (["misread"] if misread else []) + ["running_head"], ""
    repairs = judge.repairs(text, True)
    kinds = [k for k, on in (("hyphen", ends_in_hyphen(text)), ("misread", bool(repairs))) if on]
    return kinds, apply_repairs(text, repairs)


def repeated_heads(lines: DataFrame, share: float = HEAD_SHARE, least: int = HEAD_PAGES) -> DataFrame:
    """doc_id and heads (at most 1 / share) of the volumes: lines that stand first on many of their pages.

    ``lines``: doc_id, page_num, text, top, size, block_type. Each page gives one line, found with map-side minima, so
    no page and no volume meets in one task.
    """
    flat = F.regexp_replace("text", f"[{_BRACKETS}]", "")
    key = F.regexp_replace(F.regexp_replace(flat, _HEAD_EXTRA.pattern, ""), "[0-9０-９]", "9")
    plain = ~F.trim("text").rlike(f"^(?:{_PAGE_MARK.pattern}|{_BARE_NUMBER.pattern})$") & (F.coalesce("block_type", F.lit("")) != "table") & (F.coalesce("size", F.lit(0.0)) < TITLE_PT)
    rows = lines.where(plain & (F.col("top") > 0)).select("doc_id", "page_num", "top", key.alias("key"))
    first = rows.groupBy("doc_id", "page_num").agg(F.min(F.struct("top", "key")).alias("f"))
    counted = first.groupBy("doc_id", F.col("f.key").alias("key")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    kept = counted.withColumn("_total", total).where((F.col("n") >= least) & (F.col("n") >= share * F.col("_total")) & (F.length("key") >= 2))
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("heads"))


_JUDGES: dict[str, Judge] = {}


def find_noise(df: DataFrame, judge: Judge, id_col: str, paragraphs: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, kinds array<string>, repaired string and the ``keep`` columns for each row of ``df``.

    ``df`` has text, title and heads, for printed lines also top, size (points) and block_type. No shuffle.
    """
    payload = pickle.dumps(judge)
    token = hashlib.sha256(payload).hexdigest()
    names = ["text", "title", "heads"] + ([] if paragraphs else ["top", "size", "block_type"])
    n = 1 + len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _JUDGES:
            _JUDGES.clear()
            _JUDGES[token] = pickle.loads(payload)
        own = _JUDGES[token]
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(1, n)]
            kinds, repaired = [], []
            for row in zip(*cols):
                if not row[0]:
                    k, r = [], row[0]
                else:
                    text, title, heads, *place = row
                    heads = frozenset(heads) if heads else None
                    k, r = noise_of_paragraph(text, title, heads, own) if paragraphs else noise_of_line(text, title, heads, *place, own)
                kinds.append(k)
                repaired.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(repaired, pa.string()), *(batch.column(i) for i in range(n, batch.num_columns))], ["row_id", "kinds", "repaired", *keep])

    extra = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(id_col).alias("row_id"), *names, *keep).mapInArrow(run, f"row_id bigint, kinds array<string>, repaired string{extra}")


def join_cut_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (row_id, kinds, repaired, doc_id, page_num and box) with words that go on in another line put together.

    A line that ends inside a word takes the rest from the nearest line below it on the page that begins with one; every
    rest is taken once. Only lines cut at their end and lines that begin with letters are compared, page by page; a word
    without continuation is left as it is.
    """
    page = ["doc_id", "page_num"]
    fragment = F.regexp_extract("repaired", "^[a-z][a-z0-9]*", 0)
    first = lines.where(F.array_contains("kinds", "hyphen")).select(*page, F.col("row_id").alias("cut_id"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    rest = lines.select(*page, F.col("row_id").alias("rest_id"), "x0", "y0", "x1", fragment.alias("fragment")).where("fragment != ''")
    near = first.join(rest, page).where("rest_id != cut_id and y0 > a_y0 and x0 < a_x1 and x1 > a_x0 and y0 - a_y1 <= 2 * greatest(a_y1 - a_y0, 1.0)")
    of_cut, of_rest = Window.partitionBy("cut_id").orderBy("y0", "x0", "rest_id"), Window.partitionBy("rest_id").orderBy(F.desc("a_y0"), "cut_id")
    pairs = near.withColumn("_n", F.row_number().over(of_cut)).where("_n = 1").withColumn("_m", F.row_number().over(of_rest)).where("_m = 1")
    change = pairs.select(F.col("cut_id").alias("row_id"), F.col("fragment").alias("_take"), F.lit(0).alias("_drop")).unionByName(pairs.select(F.col("rest_id").alias("row_id"), F.lit("").alias("_take"), F.length("fragment").alias("_drop")))
    change = change.groupBy("row_id").agg(F.max("_take").alias("_take"), F.max("_drop").alias("_drop"))
    left = F.ltrim(F.expr("substring(repaired, _drop + 1)"))
    joined = F.when(F.col("_take") != "", F.concat(F.regexp_replace(left, f"[{HYPHENS}]\\s*$", ""), "_take")).otherwise(left)
    return lines.join(change, "row_id", "left").withColumn("repaired", F.when(F.col("_drop").isNull(), F.col("repaired")).otherwise(joined)).drop("_take", "_drop")
