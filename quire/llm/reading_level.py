"""Problem 9: reading level of documents of running prose, by the familiar-word formula.

The formula's terms are taken for every sentence:

- the shares of its words outside lists of words of high document frequency in the corpus, one share for each list of the
  ladder ``FAMILIAR_SHARES`` (a list holds the words of that share of the language's documents or more);
- the logarithm of its length in words.

A word is a word in English; in Japanese and Chinese both the single character and the pair of neighbouring characters
count as words, each with its own lists. The weights of the terms are fitted on the graded samples of the language: one
linear formula for each level (linear discriminant with covariance shrunk by ``SHRINK``). A sentence spreads one vote over
the levels by its formula values, and the document gets the level with most votes, so that a few sentences of another
level do not move it. ``profile`` gives the averages of the terms, the average sentence length and the level.

Results for the special cases: null, empty and blank texts, tables, lists of codes, forms and symbol strings are no
running prose and get no level; sentences in several languages are judged each in its own; a tie between levels goes to
the lower; repeated rows are graded each; extra columns are ignored; empty tables give no rows. Without graded samples of
a language (of two levels at least) nothing is graded in it. The samples used are bounded by ``MAX_SAMPLES``. The lists
are bounded by the mean number of words in a document / the least share. Long texts are judged whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

MAX_SAMPLES = 20_000
#: Document frequencies (shares of the language's documents) at which the lists of familiar words end.
FAMILIAR_SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7)
#: Part of the pooled covariance that is replaced by its diagonal.
SHRINK = 0.1
#: Share of a text's letters that must stand in sentences for it to be running prose.
PROSE_SHARE = 0.6
#: Code points that are handled as one array; a longer text is handled alone, but whole.
SLICE = 500_000
LANGUAGES = ("ja", "zh", "en")
_KANA, _HAN = re.compile("[ぁ-ゖァ-ヺ]"), re.compile("[㐀-鿿]")
_END = re.compile(r"[。！？!?．]+[」』）〕”’\"')]*|(?<=°C)\.|(?<![A-Z])(?<!\b[A-Z][a-z])\.+[\"”')\]]*(?=\s|$)|\n+")
_WORDS = re.compile(r"[a-z']+")
_FIELD = re.compile(r"[^：:；;\s]{1,12}[：:][^；;\n]+")
_PAIR = 21  # bits of a code point


def language(text: str) -> str:
    return "ja" if _KANA.search(text) else "zh" if _HAN.search(text) else "en"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 1 letter, 2 figure, 4 other mark, 8 kana, 16 Han character, 32 character of a Japanese or Chinese word; 0 white space."""
    size = 0x32400
    out = np.full(size + 1, 4, np.uint8)
    for c in range(size):
        ch = chr(c)
        out[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 0 if ch.isspace() else 4 if not ch.isalnum() else 0
    out[0x3041:0x3097] |= 8 | 32
    out[0x30A1:0x30FB] |= 8 | 32
    out[0x30FB:0x30FD] |= 32
    out[0x3400:0xA000] |= 16 | 32
    return out


@dataclass
class Sentences:
    """Sentences of several texts as spans of one joined text."""

    joined: str
    codes: np.ndarray
    kinds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    whole: np.ndarray  # ends as a sentence, and is neither a field, nor a code, nor figures alone
    prose: np.ndarray  # by text


def _count(kinds: np.ndarray, bits: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((kinds & bits) != 0)])
    return total[end] - total[start]


def _sentences(texts: list[str]) -> Sentences:
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _classes()
    kinds = table[np.minimum(codes, len(table) - 1)]
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    spans, at = [], 0
    for m in _END.finditer(joined):
        s, e = m.span()
        spans.append((at, s, joined[s] != "\n"))
        at = e
    spans.append((at, len(joined), False))
    a = np.array(spans, np.int64)
    start, end, ended = a[:, 0], a[:, 1], a[:, 2] != 0
    doc = np.minimum(np.searchsorted(edge, start, "right") - 1, len(texts) - 1)
    visible = _count(kinds, 1 | 2 | 4, start, end)
    filled = visible > 0
    last = np.maximum.accumulate(np.where(filled, np.arange(len(doc)), -1))
    for k in np.flatnonzero(~filled & ended):  # a mark by itself ends the sentence before it
        if last[k] >= 0 and doc[last[k]] == doc[k]:
            ended[last[k]] = True
    start, end, doc, ended, visible = (x[filled] for x in (start, end, doc, ended, visible))
    letters = _count(kinds, 1, start, end)
    whole = ended & (letters >= 4) & (letters >= 0.4 * visible)
    cjk = _count(kinds, 8 | 16, start, end)
    colon = np.concatenate([[0], np.cumsum((codes == 0x3A) | (codes == 0xFF1A))])
    for k in np.flatnonzero(whole & (colon[end] - colon[start] >= 2)):
        whole[k] = len(_FIELD.findall(joined[start[k] : end[k]].strip())) < 2
    for k in np.flatnonzero(whole & (cjk == 0)):
        whole[k] = len(re.findall(r"[a-z]{2,}", joined[start[k] : end[k]])) >= 3
    total = np.bincount(doc, visible, len(texts))
    good = np.bincount(doc[whole], visible[whole], len(texts))
    return Sentences(joined, codes, kinds, doc, start, end, ended & (visible > 1), (total > 0) & (good >= PROSE_SHARE * total))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``SLICE`` code points with the number of their first; null counts as empty."""
    at, part, size = 0, [], 0
    for k, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE:
            yield at, part
            at, part, size = k + 1, [], 0
    if part:
        yield at, part


def is_prose(text: str | None) -> bool:
    """Whether most letters of the text stand in complete sentences that are no fields, codes or figures."""
    return bool(text) and bool(_sentences([text]).prose[0])


# --- lists of familiar words ----------------------------------------------------------------------------------------


@dataclass
class Familiar:
    """Words of high document frequency by language, with the number of lists that hold each."""

    chars: dict[str, tuple[np.ndarray, np.ndarray]]  # sorted code points, lists
    pairs: dict[str, tuple[np.ndarray, np.ndarray]]  # sorted packed pairs, lists
    words: dict[str, int]  # English


def _neighbours(codes: np.ndarray, letter: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed pairs of neighbouring letters of one owner, and the owner of each."""
    at = np.flatnonzero(letter[:-1] & letter[1:] & (owner[:-1] == owner[1:]))
    return codes[at].astype(np.int64) << _PAIR | codes[at + 1], owner[at]


def _document_counts(texts: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, 1 or 2 characters, items, number of texts that hold each) of Japanese and Chinese texts."""
    lang = [language(t) for t in texts]
    for name in ("ja", "zh"):
        own = [t for t, x in zip(texts, lang) if x == name]
        if not own:
            continue
        joined = "\n".join(own)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _classes()[np.minimum(codes, len(_classes()) - 1)] & 32 != 0
        owner = np.repeat(np.arange(len(own)), [len(t) + 1 for t in own])[: len(codes)]
        for n in (1, 2):
            item, of = (codes[letter], owner[letter]) if n == 1 else _neighbours(codes, letter, owner)
            items, place = np.unique(item, return_inverse=True)
            each = np.unique(of.astype(np.int64) * max(1, len(items)) + place)  # once for each text
            yield name, n, items, np.bincount(each % max(1, len(items)), minlength=len(items))


def familiar_words(docs: DataFrame, text_col: str = "text", shares: tuple[float, ...] = FAMILIAR_SHARES) -> Familiar:
    """The lists of familiar words from the document frequencies over all rows; partial counts by task, one shuffle."""

    def rows(lang: str, size: int, items: list[int], words: list[str], n: list[int]) -> pa.RecordBatch:
        m = len(n)
        return pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([size] * m, pa.int32()), pa.array(items, pa.int64()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "size", "item", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        english: Counter[str] = Counter()
        totals: Counter[str] = Counter()
        for batch in batches:
            for _, part in _slices(batch.column(0).to_pylist()):
                part = [t for t in part if t.strip()]
                for text in part:
                    lang = language(text)
                    totals[lang] += 1
                    if lang == "en":
                        english.update(set(_WORDS.findall(text.lower())))
                for lang, size, items, n in _document_counts(part):
                    if (lang, size) in held:
                        keys, place = np.unique(np.concatenate([held[lang, size][0], items]), return_inverse=True)
                        items, n = keys, np.bincount(place, np.concatenate([held[lang, size][1], n]), len(keys)).astype(np.int64)
                    held[lang, size] = items, n
                    if len(items) > 1_000_000:  # partial counts are added up after the shuffle
                        yield rows(lang, size, items.tolist(), [""] * len(items), n.tolist())
                        del held[lang, size]
                if len(english) > 1_000_000:
                    yield rows("en", 1, [0] * len(english), list(english), list(english.values()))
                    english.clear()
        for (lang, size), (items, n) in held.items():
            yield rows(lang, size, items.tolist(), [""] * len(items), n.tolist())
        yield rows("en", 1, [0] * len(english), list(english), list(english.values()))
        for lang, n in totals.items():
            yield rows(lang, 0, [0], [""], [n])

    counted = docs.select(text_col).mapInArrow(run, "lang string, size int, item bigint, word string, n bigint").groupBy("lang", "size", "item", "word").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    totals = counted.where("size = 0").select("lang", F.col("n").alias("total"))  # one row for each of three languages
    kept = counted.where("size > 0").join(F.broadcast(totals), "lang").where(F.col("n") >= min(shares) * F.col("total")).select("lang", "size", "item", "word", (F.col("n") / F.col("total")).alias("share")).collect()
    level = lambda x: sum(x >= q for q in shares)
    found: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)
    for r in kept:
        if r.lang != "en":
            found[r.lang, r["size"]].append((r.item, level(r.share)))
    packed = {k: (np.array([x for x, _ in sorted(v)], np.int64), np.array([n for _, n in sorted(v)], np.int64)) for k, v in found.items()}
    return Familiar({k: v for (k, n), v in packed.items() if n == 1}, {k: v for (k, n), v in packed.items() if n == 2}, {r.word: level(r.share) for r in kept if r.lang == "en"})


def _levels(items: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Number of lists that hold each item."""
    if known is None or not len(known[0]):
        return np.zeros(len(items), np.int64)
    at = np.searchsorted(known[0], items)
    at[at == len(known[0])] = 0
    return np.where(known[0][at] == items, known[1][at], 0)


# --- terms of the formula ---------------------------------------------------------------------------------------------


def _shares(owner: np.ndarray, levels: np.ndarray, n: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of words outside each list by owner, and the number of words."""
    by_level = np.bincount(owner * (lists + 1) + levels, minlength=n * (lists + 1)).reshape(n, lists + 1)
    count = by_level.sum(1)
    return np.cumsum(by_level, 1)[:, :lists] / np.maximum(count, 1)[:, None], count


def sentence_terms(s: Sentences, familiar: Familiar, chosen: np.ndarray, lists: int = len(FAMILIAR_SHARES)) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language: numbers of the ``chosen`` sentences and their terms (shares outside the lists, logarithm of the length)."""
    start, end = s.start[chosen], s.end[chosen]
    kana, han = _count(s.kinds, 8, start, end) > 0, _count(s.kinds, 16, start, end) > 0
    out = {}
    for lang, mask in (("ja", kana), ("zh", han & ~kana)):
        at = np.flatnonzero(mask)
        if not len(at):
            continue
        size = (end - start)[at]
        owner = np.repeat(np.arange(len(at)), size)
        place = np.arange(size.sum()) + np.repeat(start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        codes, letter = s.codes[place].astype(np.int64), s.kinds[place] & 32 != 0
        single, count = _shares(owner[letter], _levels(codes[letter], familiar.chars.get(lang)), len(at), lists)
        pair, of = _neighbours(codes, letter, owner)
        double, _ = _shares(of, _levels(pair, familiar.pairs.get(lang)), len(at), lists)
        out[lang] = chosen[at], np.column_stack([single, double, np.log(np.maximum(count, 1))])
    at = np.flatnonzero(~kana & ~han)
    if len(at):
        words = [_WORDS.findall(s.joined[a:b].lower()) for a, b in zip(start[at].tolist(), end[at].tolist())]
        owner = np.repeat(np.arange(len(at)), [len(w) for w in words])
        levels = np.array([familiar.words.get(w, 0) for ws in words for w in ws], np.int64)
        share, count = _shares(owner, levels, len(at), lists)
        filled = count > 0
        out["en"] = chosen[at[filled]], np.column_stack([share, np.log(np.maximum(count, 1))])[filled]
    return out


Formula = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def fit_formula(samples: list[tuple[str, int]], familiar: Familiar, shrink: float = SHRINK) -> Formula:
    """By language: levels, and for each the weights of the terms and a constant, from the sentences of the graded samples."""
    texts = [t or "" for t, _ in samples]
    if not texts:
        return {}
    s = _sentences(texts)
    level = np.array([n for _, n in samples])[s.doc]
    out: Formula = {}
    for lang, (at, x) in sentence_terms(s, familiar, np.flatnonzero(s.whole)).items():
        y = level[at]
        levels = np.unique(y)
        if len(levels) < 2 or len(y) <= len(levels):
            continue
        means = np.stack([x[y == k].mean(0) for k in levels])
        inner = x - means[np.searchsorted(levels, y)]
        pooled = inner.T @ inner / (len(y) - len(levels))
        pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + 1e-9 * np.eye(len(pooled))
        weights = np.linalg.solve(pooled, means.T).T
        out[lang] = levels, weights, -0.5 * (weights * means).sum(1)
    return out


def grade_texts(texts: list[str | None], familiar: Familiar, formula: Formula) -> dict[int, tuple[int, float, float, float]]:
    """Number of each text of running prose to level, mean level, share outside the middle list, sentence length in words."""
    out = {}
    for first, part in _slices(texts):
        s = _sentences(part)
        chosen = np.flatnonzero(s.whole & s.prose[s.doc])
        levels = sorted({int(k) for f in formula.values() for k in f[0]})
        votes, terms, count = np.zeros((len(part), len(levels))), np.zeros((len(part), 2)), np.zeros(len(part))
        for lang, (at, x) in sentence_terms(s, familiar, chosen).items():
            if lang not in formula:
                continue
            own, weights, constant = formula[lang]
            value = x @ weights.T + constant
            value = np.exp(value - value.max(1, keepdims=True))
            value /= value.sum(1, keepdims=True)
            doc = s.doc[at]
            for j, k in enumerate(own):
                votes[:, levels.index(k)] += np.bincount(doc, value[:, j], len(part))
            middle = x[:, len(FAMILIAR_SHARES) // 2 + (len(FAMILIAR_SHARES) if lang != "en" else 0)]
            terms += np.column_stack([np.bincount(doc, middle, len(part)), np.bincount(doc, np.exp(x[:, -1]), len(part))])
            count += np.bincount(doc, minlength=len(part))
        for k in np.flatnonzero(count):
            share = votes[k] / count[k]
            out[first + int(k)] = levels[int(np.argmax(share.round(12)))], float(share @ levels), float(terms[k, 0] / count[k]), float(terms[k, 1] / count[k])
    return out


def collect_samples(graded: DataFrame, max_samples: int = MAX_SAMPLES) -> list[tuple[str, int]]:
    rows = graded.where("text is not null and reading_level is not null").orderBy("sample_id").limit(max_samples).select("text", "reading_level").collect()
    return [(r.text, int(r.reading_level)) for r in rows]


def profile(docs: DataFrame, familiar: Familiar, formula: Formula, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, reading_level, mean_level (fractional), unfamiliar_share and sentence_length of every document of running prose. Map-side only.

    unfamiliar_share is that of the middle list (English words, pairs of characters else).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = grade_texts(batch.column(1).to_pylist(), familiar, formula)
            rows = list(found.values())
            columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.float64()) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(list(found), pa.int64())), *columns], [id_col, "reading_level", "mean_level", "unfamiliar_share", "sentence_length"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, reading_level bigint, mean_level double, unfamiliar_share double, sentence_length double")
