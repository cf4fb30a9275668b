"""Problem 5: cut oversized texts at natural boundaries, with an overlap.

``natural_boundaries`` finds the places where a sentence or a list item ends. ``split_text`` computes the least number
of pieces, places equally spaced targets, snaps each to the strongest boundary near it and takes further pieces when a
limit would fail or as long as more cuts than need be miss a natural boundary.

Results for the special cases: null and empty texts and texts within the limit give one piece (null and empty: none)
and no boundaries; a text without any boundary is cut at clause marks, else anywhere; repeated rows are split each.
Consecutive pieces share exactly ``overlap`` code points; no piece is longer than ``max_size``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSERS = "」』）〕”】》)]"
OPENERS = {"」": "「", "』": "『", "）": "（", "〕": "〔", "”": "“", "】": "【", "》": "《", ")": "(", "]": "["}
_BRACKETS = re.compile("[" + re.escape("".join([*OPENERS, *OPENERS.values()])) + "]")
BLANK = " \t\r\n　 "
TERMINAL = re.compile(r"[。．！？!?…]+|\.+")
ITEM = re.compile(r"[ \t　]*(?:[(（][0-9０-９a-zA-Z]{1,3}[)）]|[0-9０-９]{1,3}[.)．）](?=[ \t　])|[①-⑳]|[・•‣◦●○■□◆◇※]|[-–−*](?=[ \t　]))[ \t　]*\S")
PAGE_MARK = re.compile(r"[ \t　]*[-–−][ \t　]*[0-9０-９]+[ \t　]*[-–−]")
#: Words before a point that end no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof st no nos fig figs sec secs eq eqs ref refs vol vols ch p pp ed eds approx e.g i.e cf vs etc al inc ltd co corp dept est max min ca resp jr sr".split())
WORD_BEFORE = re.compile(r"[A-Za-z][A-Za-z.]*$")
#: Strength of a cut: end of a line or list item, end of a sentence, clause mark, any place.
LINE, SENTENCE, CLAUSE, ANY = 3, 2, 1, 0


def _partners(text: str) -> dict[int, int]:
    """Position of each closing mark to that of its opening mark; a mark closes the last open one of its kind and drops those inside it."""
    stack: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {ch: [] for ch in OPENERS.values()}
    pairs: dict[int, int] = {}
    for m in _BRACKETS.finditer(text):
        ch, i = m.group(), m.start()
        if ch in depths:
            depths[ch].append(len(stack))
            stack.append((ch, i))
        elif depths[OPENERS[ch]]:
            k = depths[OPENERS[ch]][-1]
            pairs[i] = stack[k][1]
            for inner, _ in stack[k:]:
                depths[inner].pop()
            del stack[k:]
    return pairs


def _point_ends(text: str, at: int, end: int) -> bool:
    """Whether the point(s) at [at, end) end an English sentence."""
    if end < len(text) and text[end] not in BLANK + CLOSERS and text[end].isascii():
        return False
    if end - at == 1:
        word = WORD_BEFORE.search(text, max(0, at - 12), at)
        if word and (word.group().lower() in ABBREVIATIONS or len(word.group()) == 1 and word.group().isupper()):
            return False
        if not word and at and text[at - 1].isdigit() and end < len(text) and text[end].isdigit():
            return False
    rest = text[end : end + 20].lstrip(BLANK + CLOSERS)
    return not (rest and rest[0].isascii() and rest[0].islower())


def natural_boundaries(text: str | None) -> list[int]:
    """Positions after which a sentence or list item has ended; the end of the text is none."""
    if not text:
        return []
    n = len(text.rstrip(BLANK))
    pairs = _partners(text)
    depth = [0] * (len(text) + 1)
    for close, start in pairs.items():
        depth[start + 1] += 1
        depth[close] -= 1
    for i in range(1, len(depth)):
        depth[i] += depth[i - 1]
    found: set[int] = set()
    for m in TERMINAL.finditer(text):
        at, end = m.span()
        if m.group()[0] == "." and not _point_ends(text, at, end):
            continue
        if m.group().strip("…") == "" and text[end : end + 1] not in ("", *BLANK):
            continue
        closed = end
        while closed < len(text) and text[closed] in CLOSERS and (closed in pairs):
            closed += 1
        if depth[closed] > 0:
            continue
        if closed > end:
            after = text[closed : closed + 1]
            if after and after not in BLANK and ("ぁ" <= after <= "ゟ" or after in "、，,。．"):
                continue
        found.add(closed)
    at = 0
    for line in text.split("\n"):
        body = line.rstrip(BLANK)
        if body and ITEM.match(body) and not PAGE_MARK.fullmatch(body):
            found.add(at + len(body))
        at += len(line) + 1
    return sorted(p for p in found if 0 < p < n)


def cut_points(text: str, boundaries: list[int]) -> dict[int, int]:
    """Every usable cut with its strength; blanks after a boundary stay with the piece before it."""
    cuts = {m.end(): CLAUSE for m in re.finditer(r"[、，,；;：:\n　 ]+", text)}
    for p in boundaries:
        q = p
        while q < len(text) and text[q] in BLANK:
            q += 1
        cuts[q] = LINE if "\n" in text[p:q] else SENTENCE
    return cuts


def _place(length: int, count: int, max_size: int, overlap: int, cuts: dict[int, int], natural: list[int], clauses: list[int]) -> tuple[list[int], int] | None:
    """Cut positions for ``count`` pieces and how many of them are no natural boundary, or None if a limit fails.

    Every target is snapped to the strongest boundary in reach: a natural one, else a clause mark, else the target itself.
    """
    step, ends, weak = (length - overlap) / count, [0], 0
    for j in range(1, count):
        target = overlap + j * step
        first = max(ends[-1] + 1, length - (count - j) * (max_size - overlap), overlap + 1)
        last = min((ends[-1] - overlap if j > 1 else 0) + max_size, length - 1, int(target + step / 2))
        first = max(first, int(target - step / 2))
        if first > last:
            return None
        near = natural[bisect.bisect_left(natural, first) : bisect.bisect_right(natural, last)]
        if not near:
            weak += 1
            near = clauses[bisect.bisect_left(clauses, first) : bisect.bisect_right(clauses, last)] or [min(max(first, int(target)), last)]
        ends.append(max(near, key=lambda p: (cuts.get(p, ANY), -abs(p - target), -p)))
    return ends[1:], weak


def _fewest_weak(length: int, max_size: int, overlap: int, natural: list[int]) -> int:
    """Cuts that no choice of natural boundaries can avoid: the walk to the last boundary in reach fails there."""
    weak = done = 0
    while length - (done - overlap if done else 0) > max_size:
        last = (done - overlap if done else 0) + max_size
        k = bisect.bisect_right(natural, last)
        if k and natural[k - 1] > max(done, overlap):
            done = natural[k - 1]
        else:
            done, weak = last, weak + 1
    return weak


def split_text(text: str | None, max_size: int, overlap: int, boundaries: list[int] | None = None) -> list[tuple[int, int]]:
    """Pieces [start, end) of at most ``max_size``; consecutive pieces overlap by ``overlap``."""
    if not text:
        return []
    if overlap >= max_size or max_size < 1:
        raise ValueError("overlap must be smaller than max_size")
    length = len(text)
    if length <= max_size:
        return [(0, length)]
    boundaries = natural_boundaries(text) if boundaries is None else boundaries
    cuts = cut_points(text, boundaries)
    natural = sorted(p for p, s in cuts.items() if s >= SENTENCE and p < length)
    clauses = sorted(p for p in cuts if p < length)
    least = -(-(length - overlap) // (max_size - overlap))
    fewest = _fewest_weak(length, max_size, overlap, natural)
    best: tuple[int, list[int]] | None = None
    # with twice the least number of pieces every target is within the limits
    for count in range(least, 2 * least + 3):
        placed = _place(length, count, max_size, overlap, cuts, natural, clauses)
        if placed is not None and (best is None or placed[1] < best[0]):
            best = placed[1], placed[0]
            if best[0] <= fewest:
                break
    ends = best[1] if best else list(range(max_size, length, max_size - overlap))
    edges = [*ends, length]
    return [(0 if k == 0 else edges[k - 1] - overlap, e) for k, e in enumerate(edges)]


def split_long_texts(df: DataFrame, max_size: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows whose text is longer than ``max_size``: ``id_col``, boundaries array<bigint>, pieces array<struct<start, end, text>>.

    The length filter runs in the JVM, so only oversized texts reach Python. No shuffle.
    """
    piece = pa.struct([("piece_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pieces = [], []
            for text in batch.column(1).to_pylist():
                b = natural_boundaries(text)
                found.append(b)
                pieces.append([{"piece_no": k, "start_pos": s, "end_pos": e, "text": text[s:e]} for k, (s, e) in enumerate(split_text(text, max_size, overlap, b))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(pieces, pa.list_(piece))], [id_col, "boundaries", "pieces"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).where(F.length(text_col) > max_size).mapInArrow(run, f"`{id_col}` {kind}, boundaries array<bigint>, pieces array<struct<piece_no:int,start_pos:bigint,end_pos:bigint,text:string>>")
