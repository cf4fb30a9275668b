"""Text fitting: width measure, wrapping, font search, splitting of a translation over lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip

WIDE = "[\\u4e00-\\u9fff\\u3000-\\u30ff]"
LINE_SPACING, MIN_FONT, MARGIN = 1.25, 4, 0.95


def text_width(text: Column, font: Column) -> Column:
    """Width without font metrics: a wide character takes the font size, any other half of it."""
    wide = F.length(F.regexp_replace(text, f"[^{WIDE[1:-1]}]", ""))
    return font * wide + font * 0.5 * (F.length(text) - wide)


def line_font(height: Column) -> Column:
    """Font size for a line of ``height`` points without font metrics."""
    return F.when(height < 2, F.lit(0)).otherwise(F.greatest(F.lit(1), (height * 0.72).cast("int")))


def wrap_line(text: str, width: float, font: float) -> list[str]:
    """Greedy lines of at most 95 % of ``width``, one character at least, stripped."""
    if not text.strip():
        return []
    if width < 2:
        return [text]
    lines, start, used, limit = [], 0, 0.0, width * MARGIN
    text = text.strip()
    for at, c in enumerate(text):
        if at == start and c.isspace():
            start += 1
            continue
        w = font if "\u4e00" <= c <= "\u9fff" or "\u3000" <= c <= "\u30ff" else font * 0.5
        if at > start and used + w > limit:
            lines.append(text[start:at].strip())
            start, used = (at + 1, 0.0) if c.isspace() else (at, w)
        else:
            used += w
    if start < len(text):
        lines.append(text[start:].strip())
    return lines


def fit_text(text: str | None, width: float, height: float, initial: int) -> tuple[int, list[str]]:
    """The largest size from ``initial`` down to 4 whose lines fit the height, else 4, with its lines."""
    if not text or not text.strip():
        return initial, []
    if width < 2 or height < 2:
        return initial, [text]
    for size in range(initial, MIN_FONT - 1, -1):
        lines = wrap_line(text, width, size)
        if len(lines) * size * LINE_SPACING <= height:
            return size, lines
    return MIN_FONT, wrap_line(text, width, MIN_FONT)


def wrap(text: Column, width: Column, font: Column) -> Column:
    """``wrap_line`` over Arrow batches; a greedy walk over characters is far slower as a fold of expressions."""
    @F.pandas_udf("array<string>")
    def run(t: pd.Series, w: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([wrap_line(a, b, c) if a is not None else [] for a, b, c in zip(t, w, f)])

    return run(text, width.cast("double"), font.cast("double"))


def fit(text: Column, width: Column, height: Column, initial: Column) -> Column:
    """struct(font, lines) by ``fit_text`` over Arrow batches."""
    @F.pandas_udf("font int, lines array<string>")
    def run(t: pd.Series, w: pd.Series, h: pd.Series, i: pd.Series) -> pd.DataFrame:
        rows = [fit_text(a, b, c, int(d)) for a, b, c, d in zip(t, w, h, i)]
        return pd.DataFrame({"font": pd.Series([r[0] for r in rows], dtype="int32"), "lines": [r[1] for r in rows]})

    return run(text, width.cast("double"), height.cast("double"), initial.cast("int"))


def proportional_parts(text: str | None, lengths: list[int]) -> list[str]:
    """Pieces of ``text`` in proportion to the original line lengths; the rest goes to the last."""
    if not text:
        return ["" for _ in lengths]
    if len(lengths) <= 1:
        return [text]
    total, ends, at = max(1, sum(lengths)), [], 0
    for n in lengths[:-1]:
        at = min(at + len(text) * n // total, len(text))
        ends.append(at)
    return [text[x:y] for x, y in zip([0, *ends], [*ends, len(text)])]


def width_parts(text: str | None, widths: list[float], heights: list[float], min_font: int = 6) -> list[str]:
    """For each line box the longest prefix that fits at ``min_font``, one character at least; boxes under 2 points stay empty; the rest goes to the last."""
    if not text:
        return ["" for _ in widths]
    if len(widths) <= 1:
        return [text]
    parts, at = [], 0
    for w, h in zip(widths, heights):
        if at >= len(text) or w < 2 or h < 2:
            parts.append("")
            continue
        end, used = at, 0.0
        while h * MARGIN >= min_font and end < len(text):
            used += min_font if "\u4e00" <= text[end] <= "\u9fff" or "\u3000" <= text[end] <= "\u30ff" else min_font * 0.5
            if used > w * MARGIN:
                break
            end += 1
        end = max(end, at + 1)
        parts.append(text[at:end])
        at = end
    parts[-1] += text[at:]
    return parts


def _by_width(t: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else width_parts(a, list(b), list(c)) for a, b, c in zip(t, w, h)])


def split_proportionally(text: Column, lengths: Column) -> Column:
    """``proportional_parts`` as one fold over the array of lengths, in the JVM.

    What does not change is worked out once and carried along, as an expression inside the fold runs for every element.
    """
    total = F.greatest(F.lit(1).cast("bigint"), F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.size(lengths).alias("n"), total.alias("total"), F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(a["text"])
        end = F.when(a["k"] + 1 == a["n"], size).otherwise(F.least(a["at"] + F.floor(size * F.coalesce(x, F.lit(0)) / a["total"]).cast("int"), size))
        part = F.substring(a["text"], a["at"] + 1, end - a["at"])
        return F.struct(end.alias("at"), (a["k"] + 1).alias("k"), a["n"].alias("n"), a["total"].alias("total"), a["text"].alias("text"), F.concat(a["parts"], F.array(part)).alias("parts"))

    return F.aggregate(lengths, start, step, lambda a: a["parts"])


def split_by_width(text: Column, widths: Column, heights: Column) -> Column:
    """``width_parts`` over Arrow batches."""
    return F.pandas_udf(_by_width, "array<string>")(text, widths, heights)


def split_cluster_text(text: Column, n_paragraphs: Column) -> Column:
    """Paragraph texts of a cluster's translation if it has as many lines as paragraphs, else null."""
    parts = F.split(text, "\n")
    return F.when(F.size(parts) == n_paragraphs, F.transform(parts, strip))


def one_line_font(text: Column, width: Column, height: Column, largest: int = 200) -> Column:
    """Largest size at which the text stands on one line within 95 % of the box, without font metrics."""
    units = text_width(text, F.lit(1.0))
    size = F.least(F.floor(width * MARGIN / units), F.floor(height * MARGIN), F.lit(largest))
    return F.when(is_blank(text) | (width < 2) | (height < 2), F.lit(0)).otherwise(F.greatest(F.lit(1), size).cast("int"))
