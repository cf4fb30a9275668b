"""Problem 3: pair up the sentences of rough translations.

A translation table between the units of both languages is estimated by distributed expectation-maximization over all
text pairs (``learn_table``): each task adds up expected counts over its rows and gives out those that are not zero as
(cell of the table, count), which Spark adds up with partial sums; the sums are the table of the next round. ``align`` then links sentences competitively: the pair of sentences that explains most of one of its
sides is accepted, what it explains is used up, and so on anywhere in the text, until no pair explains enough. So a
sentence may have no, one or several partners, in any order.

Units are Han characters, runs of katakana, and (matched by identity) figures, codes and Latin words. Nothing is left out of
the table: every unit has its row, however rare, and every pair of units that stands in one text pair keeps its count and
its association. So the table has as many entries as there are different pairs of units, which follows the vocabulary.
Where its sides are long, no process holds it whole: a round goes over blocks of target units, one after another (a target
unit's expected counts need no other target unit), the driver keeps the entries in temporary files, and the tasks that link
sentences map the file of associations into memory. No task holds a matrix of more than ``BLOCK_CELLS`` or ``TABLE_CELLS``
cells (or of one target unit); what is held whole everywhere is the list of units.

Sentences without a unit (kana alone) have nothing to be judged by and get no partner.

Results for the special cases: null or blank sides give no pairs; a text without sentence mark is one sentence; equal
sentences are paired in order; repeated rows are paired each; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITERATIONS = 5
#: Share of its source unit's count below which an entry is dropped after a round: none is.
LEAST_SHARE = 0.0
#: Cells of the dense matrices of a task: in a round of expectation-maximization (two of them), and of associations.
BLOCK_CELLS, TABLE_CELLS = 8 << 20, 16 << 20
#: Bytes of packed units in a task of expectation-maximization, as far as there are tasks enough for all cores.
TASK_BYTES = 256 << 20
#: A link must explain this share of the lighter of its two sentences; and of the sentence it is judged by.
LINK_SHARE = 0.42
#: The same if one of the two sentences has no partner yet, and if neither has.
HALF_FREE_SHARE, FREE_SHARE = 0.25, 0.15
_SENTENCE = re.compile(r"[^。．！？]*[。．！？]+[」』）〕”]*|[^。．！？]+$")
_UNIT = re.compile(r"[0-9][0-9,.]*[0-9]|[0-9]|[a-z][a-z0-9]*|[\u30a1-\u30fa\u30fc]{2,}|[\u3400-\u9fff]")
_KATAKANA = re.compile(r"[\u30a1-\u30fa\u30fc]{2,}")
_CODE_HYPHEN = re.compile(r"(?<=[a-z0-9])[-¬­‐/・]+(?=[a-z0-9])")


def sentences(text: str) -> list[str]:
    return _SENTENCE.findall(text)


def _flat(text: str) -> str:
    return unicodedata.normalize("NFKC", text.replace("\n", "").replace("\r", "").replace("\t", "").replace("\u3000", ""))


def units(text: str) -> list[str]:
    return _UNIT.findall(_CODE_HYPHEN.sub("", _flat(text).lower()))


def _is_anchor(unit: str) -> bool:
    return unit[0].isascii()


def unit_code(unit: str) -> int:
    """A number for each unit: the code point of a single character, else a checksum above all code points."""
    return ord(unit) if len(unit) == 1 else 1 << 31 | zlib.crc32(unit.encode())


def encode_units(pairs: DataFrame) -> DataFrame:
    """Each text pair as the sorted sets of its units' codes, packed as 32-bit integers. Anchors are left out."""

    def codes(text: str) -> bytes:
        flat = _flat(text)
        found = {ord(c) for c in set(flat) if "\u3400" <= c <= "\u9fff"}
        found.update(map(unit_code, set(_KATAKANA.findall(flat))))
        return np.array(sorted(found), np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[codes(text) for text in batch.column(col).to_pylist()] for col in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["s", "t"])

    return pairs.select("source", "target").mapInArrow(run, "s binary, t binary")


def unit_frequency(encoded: DataFrame) -> tuple[list[int], list[int], dict[int, float]]:
    """Codes of all units of each side, and the information of each by document frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, code, n = [pa.array([2], pa.int32())], [pa.array([0], pa.int64())], [pa.array([batch.num_rows], pa.int64())]
            for col in (0, 1):
                codes, counts = np.unique(np.frombuffer(b"".join(batch.column(col).to_pylist()), np.uint32), return_counts=True)
                side.append(pa.array(np.full(len(codes), col), pa.int32()))
                code.append(pa.array(codes.astype(np.int64), pa.int64()))
                n.append(pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (side, code, n)], ["side", "code", "n"])

    counted = encoded.mapInArrow(run, "side int, code bigint, n bigint").groupBy("side", "code").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    total = sum(r["n"] for r in counted if r["side"] == 2)
    kept = sorted((r for r in counted if r["side"] < 2), key=lambda r: r["side"])  # of a code on both sides the target's information holds
    source = sorted(r["code"] for r in kept if r["side"] == 0)
    target = sorted(r["code"] for r in kept if r["side"] == 1)
    return source, target, {r["code"]: float(np.log(1 + total / r["n"])) for r in kept}


#: Numbers of source and target units, and expected count of each pair that is not zero, in order of target and source unit.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]
NO_COUNTS: Counts = (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))


class _Columns:
    """Arrays that are written block by block to temporary files of the driver, and read as mapped memory."""

    def __init__(self, *types: type):
        self.types, self.files = types, [tempfile.TemporaryFile() for _ in types]

    def add(self, *blocks: np.ndarray) -> None:
        for f, kind, block in zip(self.files, self.types, blocks):
            f.write(np.ascontiguousarray(block, kind).data)

    def arrays(self) -> tuple[np.ndarray, ...]:
        for f in self.files:
            f.flush()
        return tuple(np.memmap(f, kind, "r") if f.tell() else np.empty(0, kind) for f, kind in zip(self.files, self.types))


def learn_table(encoded: DataFrame, source: list[int], target: list[int], iterations: int = ITERATIONS) -> Counts:
    """Expected counts of (source unit, target unit) after ``iterations`` rounds of expectation-maximization.

    A round shuffles the non-zero counts of each task, block by block. ``encoded`` should be a table or a checkpoint.
    """
    n_source, n_target = len(source), len(target)
    known = (np.array(source, np.uint32), np.array(target, np.uint32))
    if not n_source or not n_target:
        return NO_COUNTS
    size = encoded.agg(F.sum(F.length("s") + F.length("t"))).first()[0] or 0
    encoded = encoded.coalesce(max(encoded.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    width = min(n_target, max(1, BLOCK_CELLS // n_source))

    def place(packed: bytes, side: int) -> np.ndarray:
        codes = np.frombuffer(packed, np.uint32)
        at = np.searchsorted(known[side], codes)
        at[at == len(known[side])] = 0
        return at[known[side][at] == codes]

    def expected(first: int, entries: Counts | None) -> pa.Table:
        """Expected counts of ``width`` target units from ``first`` on, by target unit * ``n_source`` + source unit."""
        n_cols = min(width, n_target - first)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_source, n_cols), np.float32)
            flat = total.ravel()
            table = None
            if entries is not None:
                table = np.zeros((n_source, n_cols), np.float32)
                table[entries[0], entries[1]] = entries[2]
            for batch in batches:
                for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows, cols = place(s, 0), place(t, 1)
                    if n_cols < n_target:
                        cols = cols[(cols >= first) & (cols < first + n_cols)] - first
                    if not len(rows) or not len(cols):
                        continue
                    at = (rows[:, None] * n_cols + cols).ravel()
                    if table is None:
                        flat[at] += np.float32(1.0 / len(rows))
                    else:
                        part = table.take(at).reshape(len(rows), len(cols))
                        part /= np.maximum(part.sum(0), np.float32(1e-37))  # shares of rare units are small, but count in full
                        flat[at] += part.ravel()  # each pair of units once
            used = np.flatnonzero(flat)
            for k in range(0, len(used), 100_000):
                at = used[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((at % n_cols + first) * n_source + at // n_cols, pa.int64()), pa.array(flat[at], pa.float32())], ["cell", "n"])

        return encoded.mapInArrow(expect, "cell bigint, n float").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()

    counts: Counts | None = None
    for _ in range(iterations):
        columns, totals = _Columns(np.int32, np.int32, np.float64), np.zeros(n_source)
        for first in range(0, n_target, width):
            entries = None
            if counts is not None:
                own = slice(*np.searchsorted(counts[1], [first, first + width]))
                entries = np.array(counts[0][own]), counts[1][own] - np.int32(first), (counts[2][own] / of_source[counts[0][own]]).astype(np.float32)
            summed = expected(first, entries)
            cells, n = summed.column("cell").to_numpy(), summed.column("n").to_numpy()
            order = np.argsort(cells)
            rows, cols, n = cells[order] % n_source, cells[order] // n_source, n[order]
            columns.add(rows, cols, n)
            totals += np.bincount(rows, n, n_source)
        counts, of_source = columns.arrays(), totals
    return counts


def _totals(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size)
    for k in range(0, len(at), BLOCK_CELLS):
        total += np.bincount(at[k : k + BLOCK_CELLS], n[k : k + BLOCK_CELLS], size)
    return np.maximum(total, 1e-9)


def associations(counts: Counts, n_source: int, n_target: int) -> Counts:
    """Association of units, 0 to 1, from the expected counts of both directions, in the order of ``counts``."""
    of_source, of_target = _totals(counts[0], counts[2], n_source), _totals(counts[1], counts[2], n_target)
    columns = _Columns(np.int32, np.int32, np.float32)
    for k in range(0, len(counts[0]), BLOCK_CELLS):
        rows, cols, n = (x[k : k + BLOCK_CELLS] for x in counts)
        columns.add(rows, cols, np.minimum(1.0, 1.8 * np.sqrt(n / of_source[rows] * (n / of_target[cols]))))
    return columns.arrays()


def _is_large(n_source: int, n_target: int) -> bool:
    return (n_source + 1) * (n_target + 1) > TABLE_CELLS


class Table:
    """Units with their numbers, weights and associations (for a large table in order, as ``learn_table`` gives them)."""

    def __init__(self, source: list[int], target: list[int], info: dict[int, float], linked: Counts):
        self.source, self.target, self.info = {u: k for k, u in enumerate(source)}, {u: k for k, u in enumerate(target)}, info
        # one more row and column for units without an entry
        self.dense: np.ndarray | None = None
        if _is_large(len(source), len(target)):
            self.rows, self.values = linked[0], linked[2]
            self.starts = np.searchsorted(linked[1], np.arange(len(target) + 2))
        else:
            self.dense = np.zeros((len(source) + 1, len(target) + 1), np.float32)
            self.dense[linked[0], linked[1]] = linked[2]
        # number on each side and weight of a unit, as units come up
        self.known: dict[str, tuple[int, int, float]] = {}

    def look_up(self, unit: str) -> tuple[int, int, float]:
        found = self.known.get(unit)
        if found is None:
            code = unit_code(unit)
            found = self.source.get(code, len(self.source)), self.target.get(code, len(self.target)), self._weight(unit)
            if len(self.known) < 1_000_000:
                self.known[unit] = found
        return found

    def scores(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Associations of each of ``rows`` with each of ``cols``, by their numbers."""
        if self.dense is not None:
            return self.dense.take(rows[:, None] * self.dense.shape[1] + cols)
        own_rows, row_at = np.unique(rows, return_inverse=True)
        own_cols, col_at = np.unique(cols, return_inverse=True)
        found = np.zeros((len(own_rows), len(own_cols)), np.float32)
        for k, col in enumerate(own_cols):
            there, values = (x[self.starts[col] : self.starts[col + 1]] for x in (self.rows, self.values))
            if len(there):
                at = np.minimum(np.searchsorted(there, own_rows), len(there) - 1)
                found[:, k] = np.where(there[at] == own_rows, values[at], 0)
        return found[row_at[:, None], col_at]

    def _weight(self, unit: str) -> float:
        if _is_anchor(unit):
            return 1.0 if len(unit) < 2 else 2.5 if len(unit) < 5 else 5.0
        return self.info.get(unit_code(unit), 3.0) * (1.0 if len(unit) == 1 else 1.5)


def _grouped(text: str) -> list[tuple[int, list[str]]]:
    """Sentences that have units, by their number from 1, with each unit once."""
    return [(k, g) for k, x in enumerate(sentences(text), 1) if (g := list(dict.fromkeys(units(x))))]


def align(source: str, target: str, table: Table, share: float = LINK_SHARE, half_free_share: float = HALF_FREE_SHARE, free_share: float = FREE_SHARE) -> list[tuple[int, int]]:
    """Links (source sentence, target sentence), counted from 1."""
    left, right = _grouped(source), _grouped(target)
    if not left or not right:
        return []
    if len(left) == len(right) == 1 and sum(len(u) > 4 for u in set(left[0][1]).intersection(right[0][1]) if u[0] <= "z"):
        return [(left[0][0], right[0][0])]  # one sentence each and the same code in both
    ul, ur = [u for _, g in left for u in g], [u for _, g in right for u in g]
    sizes_l, sizes_r = [len(g) for _, g in left], [len(g) for _, g in right]
    from_l, from_r = np.cumsum([0, *sizes_l[:-1]]), np.cumsum([0, *sizes_r[:-1]])
    look_up = table.look_up
    units_l, units_r = [look_up(u) for u in ul], [look_up(u) for u in ur]
    m = table.scores(np.array([x[0] for x in units_l]), np.array([x[1] for x in units_r]))
    where: dict[str, list[int]] = {}
    for j, u in enumerate(ur):
        if u[0] <= "z":
            where.setdefault(u, []).append(j)
    for i, u in enumerate(ul):
        if u[0] <= "z" and u in where:
            m[i, where[u]] = 1.0
    # what a unit without any counterpart weighs is unknown: it counts little
    free_l, free_r = np.array([x[2] for x in units_l], np.float32), np.array([x[2] for x in units_r], np.float32)
    free_l[m.max(1) < 0.2] *= 0.35
    free_r[m.max(0) < 0.2] *= 0.35
    nl, nr = len(left), len(right)
    by_l = np.maximum.reduceat(m, from_l, axis=0)  # how well a source sentence explains each target unit
    by_r = np.maximum.reduceat(m, from_r, axis=1)
    all_l, all_r = np.maximum(np.add.reduceat(free_l, from_l), 1e-6)[:, None], np.maximum(np.add.reduceat(free_r, from_r), 1e-6)
    got_r = np.add.reduceat(by_l * free_r, from_r, axis=1)  # weight of target units explained, by pair of sentences
    got_l = np.add.reduceat(by_r * free_l[:, None], from_l, axis=0)
    # the matrices of sentences are small: plain lists are faster than array calls from here on
    value_r, value_l, total_l, total_r = got_r.tolist(), got_l.tolist(), all_l.ravel().tolist(), all_r.tolist()
    free_row, free_col = [True] * nl, [True] * nr
    done = set()

    def rate(i: int, j: int) -> float:
        a, b = value_r[i][j], value_l[i][j]
        if a <= 1.0 or b <= 1.0 or (i, j) in done:
            return -1.0
        # place on the page breaks ties between equal sentences
        v = max(min(a, 1.6 * b) / total_r[j], min(b, 1.6 * a) / total_l[i]) - 1e-3 * abs(i / nl - j / nr)
        return v / (share if not free_row[i] and not free_col[j] else free_share if free_row[i] and free_col[j] else half_free_share)

    rates = [[rate(i, j) for j in range(nr)] for i in range(nl)]
    links = []
    while True:
        tops = [max(r) for r in rates]
        top = max(tops)
        if top < 1:
            return sorted(links)
        i = tops.index(top)
        j = rates[i].index(top)
        links.append((left[i][0], right[j][0]))
        done.add((i, j))
        free_row[i] = free_col[j] = False
        own_l, own_r = slice(from_l[i], from_l[i] + sizes_l[i]), slice(from_r[j], from_r[j] + sizes_r[j])
        free_r[own_r] *= np.maximum(0, 1 - 1.25 * by_l[i, own_r])
        free_l[own_l] *= np.maximum(0, 1 - 1.25 * by_r[own_l, j])
        for k, v in enumerate((by_l[:, own_r] @ free_r[own_r]).tolist()):
            value_r[k][j] = v
        value_l[i] = (free_l[own_l] @ by_r[own_l]).tolist()
        rates[i] = [rate(i, k) for k in range(nr)]
        for k in range(nl):
            rates[k][j] = rate(k, j)


def _sent(df: DataFrame, arrays: tuple[np.ndarray, ...]) -> list[str]:
    """Names of files, one for each array, that Spark copies to each executor. They go when the session ends."""
    context = df.sparkSession.sparkContext
    folder = tempfile.mkdtemp(dir=SparkFiles.getRootDirectory())
    paths = [f"{folder}/{os.path.basename(folder)}-{k}.npy" for k in range(len(arrays))]
    for path, array in zip(paths, arrays):
        np.save(path, array)
        context.addFile(path)
    return [os.path.basename(path) for path in paths]


def align_pairs(pairs: DataFrame, source: list[int], target: list[int], info: dict[int, float], counts: Counts, keep: list[str], skip=None) -> DataFrame:  # noqa: ANN001
    """``keep`` columns, source_sentence, target_sentence of every link. ``skip(source, target)`` leaves a row out. Map-side only."""
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)
    linked, files = associations(counts, len(source), len(target)), []
    if _is_large(len(source), len(target)):
        files, linked = _sent(pairs, linked), ()
    else:
        linked = tuple(map(np.array, linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(source, target, info, linked or tuple(np.load(SparkFiles.get(f), mmap_mode="r") for f in files))
        for batch in batches:
            rows, a, b = [], [], []
            for k, (s, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if skip is not None and skip(s, t):
                    continue
                for i, j in align(s, t, table):
                    rows.append(k)
                    a.append(i)
                    b.append(j)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(2, batch.num_columns)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*keep, "source_sentence", "target_sentence"])

    return pairs.select("source", "target", *keep).mapInArrow(run, f"{schema}, source_sentence bigint, target_sentence bigint")
