"""Misread characters (problem 4): lexicon, learned confusions, correction candidates, repairs.

1. ``count_lexicon`` counts over all rows the Latin words and, of Han characters and kana, all triples and pairs.
2. ``learn_characters`` and ``learn_letters`` find out what is read for what: a triple that is rare, and whose two pairs
   are rare, beside a frequent one with another middle; a rare word beside a far more frequent one of the symmetric-delete
   index that differs in one or two short places. What recurs (over several contexts, words) is a confusion pair.
3. ``count_contexts`` counts the contexts (both neighbours, the two before, the two after) of the characters of these
   pairs, and ``decide`` picks the contexts in which such a character is wrong.
4. ``Judge`` repairs texts: characters of confusion pairs by one context that decides for the right one; any other
   character if its triple is rare and a frequent triple with another middle fits the pairs around it; Latin words by the
   index, ranked by an edit distance in which confusion pairs are cheap.

What reaches the tasks is bounded by shares of totals: frequent words and triples by 1 / ``SHARE``, confusion pairs by
1 / ``PAIR_SHARE``; the contexts in which a character is wrong belong each to a frequent one.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Share of all counted words (contexts) that a word (context) needs to serve as a correction.
SHARE = 1e-5
#: A correction must be this many times as frequent as what it replaces.
RATIO = 10
#: Share of all suspicious contexts (words) in which two characters must stand for each other to be a confusion pair.
PAIR_SHARE = 1e-3
#: Cost of a confusion pair in the edit distance; any other edit costs 1.
CHEAP = 0.3
# Letters that stand for figures inside numbers.
FIGURES = str.maketrans("IlOoBSZ〇", "11008520")

Wrong = dict[tuple[str, str, str, str], str]
Pairs = list[tuple[str, str]]

_WORD = re.compile(r"(?<![A-Za-z0-9])[0159]?[A-Za-z][A-Za-z0-9]*")
_CODE = re.compile(r"(?:[A-Za-z]{2}-?[0-9]{3,7}|[0-9]{4}-?[A-Za-z]{2}[0-9]*|[A-Za-z]{2}[0-9]{3}-)")
_NUMBER = re.compile(r"(?<![A-Za-z0-9＀-￯.\-])[-]?[0-9IlOoBSZ〇][0-9IlOoBSZ〇,.]*(?![A-Za-z0-9\-])")
_DIGITS = str.maketrans("0123456789", "9999999999")
HYPHENS = "=¬­‐-"
INNER_HYPHEN = re.compile(rf"([A-Za-z][A-Za-z0-9]*)[{HYPHENS}][ \t\r]*(\n?)[ \t]*([a-z][a-z0-9]*|[01589][a-z][a-z0-9]+)")


def latin_words(text: str) -> Iterator[re.Match[str]]:
    """Latin words that are no codes, figures with units or abbreviations."""
    for m in _WORD.finditer(text):
        w = m.group()
        if len(w) < 3 or (m.start() and (text[m.start() - 1].isdigit() or text[m.start() - 1] == "-")):
            continue
        letters = sum(x.isalpha() for x in w)
        if letters < 3 or letters <= len(w) - letters or _CODE.match(w) or w[:2].isupper():
            continue
        yield m


def contexts(text: str, at: int) -> list[tuple[str, str, str]]:
    """(kind, before, after) of the character at ``at``: both neighbours, the two before, the two after."""
    before, after = text[max(0, at - 2) : at].translate(_DIGITS), text[at + 1 : at + 3].translate(_DIGITS)
    out = []
    if before and after:
        out.append(("m", before[-1], after[0]))
    if len(before) == 2 and before.isalnum():
        out.append(("b", before, ""))
    if len(after) == 2 and after.isalnum():
        out.append(("a", "", after))
    return out


# --- counting -------------------------------------------------------------------------------------------------------


def _letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are Han characters or kana."""
    kana = (codes >= 0x3041) & (codes <= 0x3096) | (codes >= 0x30A1) & (codes <= 0x30FA) | (codes == 0x30FC)
    return kana | (codes >= 0x3400) & (codes <= 0x9FFF) | (codes >= 0x20000) & (codes <= 0x3FFFF)


def _runs(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``length`` letters packed into integers, 21 bits a letter, and how often each occurs."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter, m = _letter(codes), len(codes) - length + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.logical_and.reduce([letter[k : m + k] for k in range(length)]))
    packed = np.zeros(len(at), np.int64)
    for k in range(length):
        packed = packed << 21 | codes[at + k]
    return np.unique(packed, return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return keys, total


_NAMES = ["kind", "before", "after", "item", "n"]
_SCHEMA = "kind string, before string, after string, item string, n bigint"


def _run_rows(kind: str, packed: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = lambda shift: [chr(c) for c in (packed >> shift & 0x1FFFFF).tolist()]
    before, item, after = (at(42), at(21), at(0)) if kind == "t" else (at(21), at(0), [""] * len(packed))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in ([kind] * len(packed), before, after, item)), pa.array(n, pa.int64())], _NAMES)


def _count_rows(counts: Counter[tuple[str, str, str, str]]) -> pa.RecordBatch:
    keys = list(counts)
    batch = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([counts[k] for k in keys], pa.int64())], _NAMES)
    counts.clear()
    return batch


def count_lexicon(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, before, after, item, n over all rows: Latin words ('w'), triples ('t') and pairs ('p', ``before`` and ``item``) of Han characters and kana."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, str, str]] = Counter()
        letters: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"t": [], "p": []}
        for batch in batches:
            flats = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                flats.append(text.replace("\n", ""))
                joined = INNER_HYPHEN.sub(lambda m: m.group(1) + m.group(3), text)
                for m in latin_words(joined):
                    counts["w", "", "", m.group().lower()] += 1
            for kind, length in (("t", 3), ("p", 2)):
                letters[kind] = [_merged([*letters[kind], _runs(flats, length)])]
                if len(letters[kind][0][0]) > 1_000_000:
                    yield _run_rows(kind, *letters[kind].pop())
            if len(counts) > 200_000:
                yield _count_rows(counts)
        for kind, parts in letters.items():
            for part in parts:
                yield _run_rows(kind, *part)
        yield _count_rows(counts)

    return texts.select(text_col).mapInArrow(run, _SCHEMA).groupBy("kind", "before", "after", "item").agg(F.sum("n").alias("n"))


def count_contexts(texts: DataFrame, watched: str, text_col: str = "text") -> DataFrame:
    """kind ('m', 'b', 'a'), before, after, item, n of the ``watched`` characters over all rows."""
    pattern = f"[{re.escape(watched)}]" if watched else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, str, str]] = Counter()
        watch = re.compile(pattern) if pattern else None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or watch is None:
                    continue
                flat = text.replace("\n", "")
                for m in watch.finditer(flat):
                    for kind, before, after in contexts(flat, m.start()):
                        counts[kind, before, after, m.group()] += 1
            if len(counts) > 200_000:
                yield _count_rows(counts)
        yield _count_rows(counts)

    return texts.select(text_col).mapInArrow(run, _SCHEMA).groupBy("kind", "before", "after", "item").agg(F.sum("n").alias("n"))


# --- learning and deciding ------------------------------------------------------------------------------------------


def suspicious_triples(lexicon: DataFrame, least: float, ratio: float = RATIO) -> DataFrame:
    """before, after, item, right, n, n_right, n_left, n_after: a triple beside a far more frequent one with another middle, whose pairs are far more frequent too."""
    triples = lexicon.where("kind = 't'").select("before", "item", "after", "n")
    pairs = lexicon.where("kind = 'p'")
    left = pairs.select("before", "item", F.col("n").alias("n_left"))
    right = pairs.select(F.col("before").alias("item"), F.col("item").alias("after"), F.col("n").alias("n_after"))
    sides = triples.join(left, ["before", "item"]).join(right, ["item", "after"])
    good = sides.where(F.col("n") >= least).withColumnsRenamed({"item": "right", "n": "n_right", "n_left": "r_left", "n_after": "r_after"})
    bad = sides.join(good, ["before", "after"]).where(F.col("item") != F.col("right"))
    return bad.where((F.col("n_right") >= ratio * F.col("n")) & (F.col("r_left") >= ratio * F.col("n_left")) & (F.col("r_after") >= ratio * F.col("n_after"))).select("before", "after", "item", "right", "n", "n_right", "n_left", "n_after")


def learn_characters(lexicon: DataFrame, suspicious: DataFrame, least: float, share: float = PAIR_SHARE) -> Pairs:
    """(read, printed) characters that stand for each other in several contexts; at most 1 / share of them.

    Every suspicious context counts for one printed character, the one that goes with the read one in most contexts. The
    pair must be seen in a good part of the printed character's occurrences or be most of the read character's, or all of
    them nearly in a single context.
    """
    pair = Window.partitionBy("item", "right")
    place = Window.partitionBy("before", "after", "item").orderBy(F.desc("_k"), F.desc("n_right"), "right")
    one = suspicious.withColumn("_k", F.count("*").over(pair)).withColumn("_r", F.row_number().over(place)).where("_r = 1")
    counted = one.groupBy("item", "right").agg(F.count("*").alias("contexts"), F.sum("n").alias("read_n"), F.sum("n_right").alias("printed_n"))
    triples = lexicon.where("kind = 't'")
    every = triples.groupBy("item").agg(F.sum("n").alias("item_n"))
    frequent = triples.where(F.col("n") >= least).groupBy(F.col("item").alias("right")).agg(F.sum("n").alias("right_n"))
    rated = counted.join(every, "item").join(frequent, "right")
    systematic = (F.col("contexts") >= 3) & (F.col("printed_n") >= 0.2 * F.col("right_n"))
    always = (F.col("contexts") >= 2) & (F.col("read_n") >= 0.4 * F.col("item_n")) | (F.col("read_n") >= 4) & (F.col("read_n") >= 0.8 * F.col("item_n"))
    total = counted.agg(F.sum("contexts")).first()[0] or 0
    kept = rated.where((systematic | always) & (F.col("contexts") >= total * share)).select("item", "right").collect()
    # characters of one look are taken for each other both ways
    return sorted({p for r in kept for p in ((r["item"], r["right"]), (r["right"], r["item"]))})


def differences(read: str, printed: str) -> Pairs:
    """Where two words differ: one or two exchanged letters, or one place of up to two letters against up to two."""
    if len(read) == len(printed):
        out = [(a, b) for a, b in zip(read, printed) if a != b]
        return out if len(out) <= 2 else []
    a = 0
    while a < min(len(read), len(printed)) and read[a] == printed[a]:
        a += 1
    b = 0
    while b < min(len(read), len(printed)) - a and read[-1 - b] == printed[-1 - b]:
        b += 1
    x, y = read[a : len(read) - b], printed[a : len(printed) - b]
    return [(x, y)] if x and y and len(x) + len(y) == 3 else []


def learn_letters(words: DataFrame, index: Index, ratio: float = RATIO, share: float = PAIR_SHARE) -> Pairs:
    """(read, printed) Latin letters and figures that recur between rare words (item, n) and far more frequent ones; at most 1 / share."""
    payload = pickle.dumps(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = pickle.loads(payload)
        counts: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(word) < 6 or known.words.get(word, 0) >= n * ratio:
                    continue
                found = {w: d for w in known.near(word) if known.words[w] >= ratio * n and (d := differences(word, w))}
                if len(found) == 1:  # of several words none is surely meant
                    counts.update(next(iter(found.values())))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["item", "right", "k"])

    counted = words.select("item", "n").mapInArrow(run, "item string, right string, k bigint").groupBy("item", "right").agg(F.sum("k").alias("k"))
    total = counted.agg(F.sum("k")).first()[0] or 0
    return sorted((r["item"], r["right"]) for r in counted.where(F.col("k") >= max(2, total * share)).collect())


def decide(seen: DataFrame, pairs: Pairs, least: float, ratio: float = RATIO) -> Wrong:
    """Contexts in which a character of a confusion pair is wrong, with the right one."""
    if not pairs:
        return {}
    named = seen.sparkSession.createDataFrame(pairs, "item string, right string")
    good = seen.where(F.col("n") >= least).select("kind", "before", "after", F.col("item").alias("right"), F.col("n").alias("n_right"))
    bad = seen.join(F.broadcast(named), "item").join(good, ["kind", "before", "after", "right"]).where(F.col("n_right") >= ratio * F.col("n"))
    return {(r.kind, r.before, r.after, r["item"]): r.right for r in bad.orderBy("n_right", F.desc("right")).collect()}


def decide_others(lexicon: DataFrame, suspicious: DataFrame, least: float, ratio: float = RATIO) -> Wrong:
    """Decisions of kind 't' for every character, and of kind 'f' the two characters before or after that fit a right one of these.

    Outside the confusion pairs a character is judged only where both pairs with its neighbours are rare in the whole corpus.
    """
    rare = suspicious.where((F.col("n_left") < least) & (F.col("n_after") < least))
    best = rare.groupBy("before", "after", "item").agg(F.sort_array(F.collect_list(F.struct((-F.col("n_right")).alias("n"), "right"))).alias("rights")).collect()
    wrong = {("t", r.before, r.after, r["item"]): "".join(x.right for x in r.rights) for r in best}
    rights = sorted(set("".join(wrong.values())))
    if rights:
        frequent = lexicon.where((F.col("kind") == "t") & (F.col("n") >= max(4, least / ratio)))
        for r in frequent.where(F.col("after").isin(rights)).collect():
            wrong["f", r.before + r["item"], "", r.after] = r.after
        for r in frequent.where(F.col("before").isin(rights)).collect():
            wrong["f", "", r["item"] + r.after, r.before] = r.before
    return wrong


# --- words ----------------------------------------------------------------------------------------------------------


def _deletes(word: str) -> set[str]:
    return {"".join(x) for k in range(3) for x in combinations(word, len(word) - k)} if len(word) > 2 else {word}


class Index:
    """Symmetric-delete index of the frequent words: checksums of all words with up to two letters left out, as two arrays.

    Words above ``LONG`` letters would have too many deletes; they are few and compared by length instead.
    """

    LONG = 24

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.names = sorted(w for w in words if len(w) <= self.LONG)
        self.long: dict[int, list[str]] = {}
        for w in sorted(words):
            if len(w) > self.LONG:
                self.long.setdefault(len(w), []).append(w)
        keys, ids = [], []
        for k, w in enumerate(self.names):
            own = {zlib.crc32(d.encode()) for d in _deletes(w)}
            keys.extend(own)
            ids.extend([k] * len(own))
        order = np.argsort(np.array(keys, np.uint32), kind="stable")
        self.keys, self.ids = np.array(keys, np.uint32)[order], np.array(ids, np.int32)[order]

    def near(self, word: str) -> set[str]:
        """Frequent words that may be within two edits of ``word`` (deletes agree); the word itself is left out."""
        found = {w for n in range(len(word) - 2, len(word) + 3) for w in self.long.get(n, ())}
        if 0 < len(word) <= self.LONG + 2 and len(self.keys):
            own = np.array([zlib.crc32(d.encode()) for d in _deletes(word)], np.uint32)
            a, b = np.searchsorted(self.keys, own), np.searchsorted(self.keys, own, "right")
            for x, y in zip(a[a < b].tolist(), b[a < b].tolist()):
                found.update(self.names[k] for k in self.ids[x:y].tolist())
        found.discard(word)
        return found


def distance(read: str, printed: str, cheap: dict[str, set[str]], plain: float = 1.0) -> float:
    """Edit distance from the read word to the printed one; a confusion pair (one or two letters a side) costs ``CHEAP``."""
    rows = [[float(j) * plain for j in range(len(printed) + 1)]]
    for i, x in enumerate(read, 1):
        row = [i * plain]
        for j, y in enumerate(printed, 1):
            best = min(rows[-1][j] + plain, row[-1] + plain, rows[-1][j - 1] + (0.0 if x == y else CHEAP if y in cheap.get(x, ()) else plain))
            if j > 1 and printed[j - 2 : j] in cheap.get(x, ()):
                best = min(best, rows[-1][j - 2] + CHEAP)
            if i > 1 and y in cheap.get(read[i - 2 : i], ()):
                best = min(best, rows[-2][j - 1] + CHEAP)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


class Lexicon:
    """Frequent words, and corrections of others; words that are misreadings of far more frequent ones are left out."""

    def __init__(self, words: dict[str, int], pairs: Pairs, ratio: float = RATIO):
        self.ratio = ratio
        self.cheap: dict[str, set[str]] = {}
        for a, b in pairs:
            self.cheap.setdefault(a, set()).add(b)
        # one letter for each class of confused letters, so that a word finds its originals however many letters are exchanged
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        self.letters = {x: root(x) for x in parent}
        self.pattern = re.compile("|".join(sorted(map(re.escape, parent), key=lambda x: (-len(x), x)))) if parent else None
        self._fill(words)
        wrong = {w for w, n in words.items() if (best := self._confused(w, False)) is not None and words[best] >= ratio * n}
        if wrong:
            self._fill({w: n for w, n in words.items() if w not in wrong})
        self.least = ratio * min(self.index.words.values(), default=0)

    def _fill(self, words: dict[str, int]) -> None:
        self.index = Index(words)
        self.forward = sorted((self.canonical(w), w) for w in words)
        self.backward = sorted((self.canonical(w)[::-1], w) for w in words)
        self.starts, self.ends = sorted(words), sorted(w[::-1] for w in words)
        self.forward_keys, self.backward_keys = [k for k, _ in self.forward], [k for k, _ in self.backward]

    def canonical(self, word: str) -> str:
        return self.pattern.sub(lambda m: self.letters[m.group()], word) if self.pattern else word

    def _is_part(self, w: str) -> bool:
        """Whether ``w`` begins or ends a frequent word."""
        for part, names in ((w, self.starts), (w[::-1], self.ends)):
            k = bisect_left(names, part)
            if k < len(names) and names[k].startswith(part):
                return True
        return False

    def correction(self, word: str, edge: bool) -> str | None:
        """The right word if ``word`` is misread; ``edge``: it may be a fragment cut by the end of a line."""
        w = word.lower()
        if w in self.index.words or edge and self._is_part(w):
            return None
        return self._confused(w, edge) or (self._near(w) if len(w) > 4 else None)

    def _only_confused(self, read: str, printed: str) -> float | None:
        """Cost if the two differ in confused letters alone, and in no more than half of them."""
        cost = distance(read, printed, self.cheap, 100.0)
        return cost if 0 < cost <= CHEAP * max(1, len(read) // 2) + 1e-9 else None

    def _confused(self, w: str, edge: bool) -> str | None:
        key, found = self.canonical(w), []
        k = bisect_left(self.forward_keys, key)
        while k < len(self.forward) and (self.forward_keys[k] == key):
            found.append(self.forward[k][1])
            k += 1
        if edge and not found and len(w) > 2:
            # beginnings and ends of words; of those with the same letters the first word stands for all
            k = bisect_left(self.forward_keys, key)
            while k < len(self.forward) and self.forward_keys[k].startswith(key):
                found += [self.forward[k][1][:n] for n in range(len(w) - 2, len(w) + 3) if 0 < n <= len(self.forward[k][1]) and self.canonical(self.forward[k][1][:n]) == key]
                k += 1
            back = key[::-1]
            k = bisect_left(self.backward_keys, back)
            while k < len(self.backward) and self.backward_keys[k].startswith(back):
                found += [self.backward[k][1][-n:] for n in range(len(w) - 2, len(w) + 3) if 0 < n <= len(self.backward[k][1]) and self.canonical(self.backward[k][1][-n:]) == key]
                k += 1
        ranked = sorted((cost, -self.index.words.get(x, 0), x) for x in set(found) if x != w and (cost := self._only_confused(w, x)) is not None)
        # letters that are taken for other letters need a longer word than figures that stand in one
        return ranked[0][2] if ranked and (len(w) > 4 or any(c.isdigit() for c in w)) else None

    def _near(self, w: str) -> str | None:
        """The nearest word of the index: confused letters alone, or one other error in a far more frequent word."""
        ranked = sorted((distance(w, x, self.cheap), -self.index.words[x], x) for x in self.index.near(w))
        if not ranked:
            return None
        cost, n, best = ranked[0]
        if cost < 1:
            return best
        if cost > 1.0 + 3 * CHEAP or len(w) < (6 if cost <= 1 else 8) or -n < self.least:
            return None
        if len(w) == len(best):
            return best
        # words that are longer or shorter at an end are inflected or compound
        return None if w.startswith(best) or best.startswith(w) or any(x.isdigit() for x in w) else best


class Judge:
    """Misread characters of a text, by the decisions and the lexicon of the whole corpus."""

    def __init__(self, wrong: Wrong, lexicon: Lexicon):
        self.wrong, self.lexicon = wrong, lexicon
        as_class = lambda kinds: f"[{''.join(map(re.escape, sorted({c for k, _, _, c in wrong if k in kinds})))}]"
        self.doubtful = re.compile(as_class("mba")) if any(k[0] in "mba" for k in wrong) else None
        self.others = re.compile(as_class("t")) if any(k[0] == "t" for k in wrong) else None
        self._prepare()

    def _prepare(self) -> None:
        self.correction = lru_cache(maxsize=200_000)(self.lexicon.correction)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "correction"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def repairs(self, text: str, cut_edges: bool) -> list[tuple[int, int, str]]:
        """(start, end, right text) of each misread place. ``cut_edges``: the first and last word may go on elsewhere."""
        out = []
        for m in self.doubtful.finditer(text) if self.doubtful else ():
            for kind, before, after in contexts(text, m.start()):
                if right := self.wrong.get((kind, before, after, m.group())):
                    out.append((m.start(), m.end(), right))
                    break
        if self.others:
            done = {start for start, _, _ in out}
            out += [(m.start(), m.end(), right) for m in self.others.finditer(text) if m.start() not in done and (right := self._other(text, m.start()))]
        for m in latin_words(text):
            edge = cut_edges and (m.start() == 0 or not text[m.end() :].strip(HYPHENS + " "))
            if right := self.correction(m.group(), edge):
                out.append((m.start(), m.end(), right.capitalize() if m.group()[0].isupper() else right))
        for m in _NUMBER.finditer(text):
            w = m.group()
            if not any(x.isdigit() for x in w) or not any(x in "IlOoBSZ〇" for x in w):
                continue
            if cut_edges and (m.start() == 0 and w[0] in "Bo" or m.end() == len(text) and w[-1] == "B"):
                continue
            if m.end() < len(text) and text[m.end()].isascii() and text[m.end()] not in "%.," or re.search(r"[A-Za-z]{3}", w):
                continue
            out.append((m.start(), m.end(), w.translate(FIGURES)))
        return sorted(out)

    def _other(self, text: str, at: int) -> str | None:
        """The right character of a suspicious triple; the more of the two characters before and after it fits the better, one at least if there are such."""
        rights = self.wrong.get(("t", text[at - 1 : at], text[at + 1 : at + 2], text[at]))
        if not rights:
            return None
        before, after = text[max(0, at - 2) : at], text[at + 1 : at + 3]
        alone = not (len(before) == 2 and before.isalnum() or len(after) == 2 and after.isalnum())
        fit = [(("f", before, "", r) in self.wrong) + (("f", "", after, r) in self.wrong) for r in rights]
        return rights[fit.index(max(fit))] if alone or max(fit) else None


def learn_judge(texts: DataFrame, share: float = SHARE, ratio: float = RATIO, text_col: str = "text") -> Judge:
    """The judge of a corpus: two counting passes over all rows, everything else from the counts."""
    lexicon = cut(count_lexicon(texts, text_col))
    totals = {r.kind: r.n for r in lexicon.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # three rows
    least = max(4, totals.get("t", 0) * share)
    suspicious = cut(suspicious_triples(lexicon, least, ratio))
    characters = learn_characters(lexicon, suspicious, least)
    others = decide_others(lexicon, suspicious, least, ratio)
    words = lexicon.where("kind = 'w'")
    frequent = words.where((F.col("n") >= max(3, totals.get("w", 0) * share)) & (F.length("item") > 3) & ~F.col("item").rlike("[0-9]"))
    known = {r["item"]: r.n for r in frequent.select("item", "n").collect()}
    letters = learn_letters(words, Index(known), ratio) if known else []
    seen = cut(count_contexts(texts, "".join(sorted({c for p in characters for c in p})), text_col))
    total = seen.agg(F.sum("n")).first()[0] or 0
    return Judge(others | decide(seen, characters, max(4, total * share), ratio), Lexicon(known, letters, ratio))
