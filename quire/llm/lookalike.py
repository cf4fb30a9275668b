"""Problem 6: one consistent form for texts that look the same.

``look_alike_classes`` joins code points and short strings of the same look by union-find: width variants, decomposed
letters, radicals and compatibility ideographs, unusual spaces, and letters of other scripts of the same shape.
Invisible characters form the class of the empty string. The representative of a class is its most frequent member in
the corpus (counted over all rows, in parallel); ``Rewriter`` replaces all other members, greedily and longest first, by
a multi-pattern automaton.

The classes come from Unicode's own tables, so their size is bounded by Unicode and not by the data.

Results for the special cases: null stays null, the empty text stays empty; case, ordinary white space (space,
ideographic space, tab, line break), punctuation of another shape and voicing marks are kept; repeated rows and exactly
equal texts make no pair; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Greek and Cyrillic with the shape of the Latin letter beside them (Unicode confusables).
LETTERS = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj ԁd һh ԛq ԝw"
).split()
#: Characters without a visible shape of their own.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0)]
SPACES = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F]
VOICED, HALF_VOICED = ("゙", "゛", "ﾞ"), ("゚", "゜", "ﾟ")


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values() if len(g) > 1]


@lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    """All classes of strings of the same look; the class with '' holds what is invisible."""
    uf = UnionFind()
    for c in INVISIBLE:
        uf.union("", chr(c))
    for c in SPACES:
        uf.union(" ", chr(c))
    for pair in LETTERS:
        uf.union(pair[0], pair[1])
    composed: dict[tuple[str, str], str] = {}
    for c in range(0xA1, 0x30000):
        ch = chr(c)
        decomposition = unicodedata.decomposition(ch)
        if not decomposition or 0xAC00 <= c <= 0xD7A3:
            continue
        if decomposition[0] != "<":
            full = unicodedata.normalize("NFD", ch)
            uf.union(ch, full)  # canonical: accents, voicing marks, compatibility ideographs
            short = "".join(chr(int(x, 16)) for x in decomposition.split())
            if short != full:
                uf.union(ch, short)
            if len(short) == 2:
                composed[short[0], short[1]] = ch
        else:
            tag, value = decomposition.split(" ", 1)
            target = "".join(chr(int(x, 16)) for x in value.split())
            if c == 0x3000 or len(target) != 1:
                continue
            if tag in ("<wide>", "<narrow>") or tag == "<compat>" and 0x2E80 <= c <= 0x2FDF:
                uf.union(ch, target)
    kana = [c for c in [*range(0x3041, 0x30FB), *range(0xFF66, 0xFF9E)]]
    for c in kana:
        base = unicodedata.normalize("NFKC", chr(c))
        for marks in (VOICED, HALF_VOICED):
            if full := composed.get((base, marks[0])):
                for mark in marks:
                    uf.union(chr(c) + mark, full)
    return tuple(tuple(g) for g in uf.classes())


@lru_cache(maxsize=1)
def _members() -> frozenset[str]:
    return frozenset(x for g in look_alike_classes() for x in g)


def rewrite_table(frequency: dict[str, int]) -> dict[str, str]:
    """Every class member to the most frequent single character of its class; ties go to a normal form, then to the smallest."""
    table = {}
    for group in look_alike_classes():
        best = "" if "" in group else min((x for x in group if len(x) == 1), key=lambda x: (-frequency.get(x, 0), x != unicodedata.normalize("NFKC", x), x), default=min(group))
        for x in group:
            if x != best:
                table[x] = best
    return table


class Rewriter:
    """Greedy, longest-first replacement by an Aho-Corasick automaton; texts without a member pass at once."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        for x in table:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()
        singles = [x for x in table if len(x) == 1]
        marks = sorted({x[-1] for x in table if len(x) > 1})
        self.screen = re.compile("[" + "".join(map(re.escape, sorted({*singles, *marks}))) + "]")

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.screen.search(text):
            return text
        out = self._once(text)
        # removing what is invisible may bring a letter and its mark together
        while out != text and self.screen.search(out):
            text, out = out, self._once(out)
        return out

    def _once(self, text: str) -> str:
        parts, at = [], 0
        for end, x in self.automaton.iter_long(text):
            parts.append(text[at : end + 1 - len(x)])
            parts.append(self.table[x])
            at = end + 1
        parts.append(text[at:])
        return "".join(parts)


@lru_cache(maxsize=8)
def _rewriter(items: tuple[tuple[str, int], ...]) -> Rewriter:
    return Rewriter(rewrite_table(dict(items)))


def member_frequency(texts: DataFrame, text_col: str) -> dict[str, int]:
    """Number of occurrences of each class member in all rows. The result has at most one row for each class member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        members = _members()
        for batch in batches:
            part = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    part.update(text)
            for ch, n in part.items():
                if ch in members:
                    counts[ch] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["member", "n"])

    rows = texts.select(text_col).mapInArrow(run, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r.member: r.n for r in rows}


def consistent_form(df: DataFrame, text_col: str, frequency: dict[str, int], out_col: str = "canonical") -> DataFrame:
    """``df`` with ``out_col``, the text with every look-alike replaced by its class's representative."""
    items = tuple(sorted(frequency.items()))

    @F.pandas_udf("string")
    def rewrite(texts):  # noqa: ANN001, ANN202
        rewriter = _rewriter(items)
        return texts.map(rewriter, na_action="ignore")

    return df.withColumn(out_col, rewrite(F.col(text_col)))


def digests(df: DataFrame, id_col: str, text_col: str, frequency: dict[str, int]) -> DataFrame:
    """row_id, 128-bit digests of text and of its consistent form, whether the text was changed; null texts are left out."""
    rows = consistent_form(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("_t")), "_t", frequency, "_c")
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    return rows.select("row_id", digest("_c").alias("form"), digest("_t").alias("text_key"), (F.col("_c") != F.col("_t")).alias("changed"))


HOT_SHARE, SALTS = 1000, 64


def equal_looking_pairs(rows: DataFrame, keys: list[str], share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """Pairs id_a < id_b of rows of equal ``keys`` and form whose texts differ.

    Two unchanged texts of one form are the same text, so every pair has a changed row; only these are one side
    of the join, which keeps large groups of equal texts off it. Forms with at least 1 / ``share`` of all rows (at most
    ``share`` of them, so they are broadcast) are spread over ``salts``: each of their rows goes to one salt, the changed
    ones to all. ``rows`` should be a table or a checkpoint.
    """
    on = [*keys, "form"]
    hot = F.broadcast(rows.groupBy(*on).count().where(F.col("count") >= max(2, rows.count() / share)).select(*on, F.lit(True).alias("_hot")))
    marked = rows.join(hot, on, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = marked.where("changed").select(*on, F.col("row_id").alias("_a"), F.col("text_key").alias("_ta"), F.explode(every).alias("_salt"))
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    right = marked.select(*on, F.col("row_id").alias("_b"), F.col("text_key").alias("_tb"), F.col("changed").alias("_changed"), own.alias("_salt"))
    pairs = left.join(right, [*on, "_salt"]).where("_ta != _tb and (not _changed or _a < _b)")
    return pairs.select(*keys, F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))


def look_alike_groups(rows: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """``keys``, row_id, class_id (the smallest id of its form) and n_links (rows of the form with another text) of every row that has links.

    The pairs are counted, not made: the result has one row for each row of ``rows`` at most, however large a form is.
    Counting is combined map-side; rows of texts with at least 1 / ``share`` of all rows get their class by broadcast.
    """
    texts = rows.groupBy(*keys, "form", "text_key").agg(F.count("*").alias("_n"), F.min("row_id").alias("_least"))
    forms = texts.groupBy(*keys, "form").agg(F.sum("_n").alias("_total"), F.min("_least").alias("class_id"), F.count("*").alias("_texts")).where("_texts > 1")
    linked = texts.join(forms, [*keys, "form"]).select(*keys, "text_key", "_n", "class_id", (F.col("_total") - F.col("_n")).alias("n_links"))
    often = F.col("_n") >= max(2, rows.count() / share)
    hot = F.broadcast(linked.where(often).drop("_n").withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, [*keys, "text_key"], "left")
    columns = [*keys, "row_id", "class_id", "n_links"]
    cold = marked.where("_hot is null").select(*keys, "text_key", "row_id").join(linked.where(~often).drop("_n"), [*keys, "text_key"])
    return marked.where("_hot").select(*columns).unionByName(cold.select(*columns))
