"""Layout clustering: recursive cuts, lines, paragraphs, merging, classes and reading order.

All of it depends on one page alone (which is bounded by its printed size), so ``layout_paragraphs`` lays out each page in
one grouped Arrow function after one shuffle. The single steps also stand alone, as window expressions or joins on the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import BLANK, BULLETS, ordered_concat, starts_paragraph
from .boxes import PAGE

Rect = tuple[float, float, float, float]


def _median(heights: list[float], default: float = 12.0) -> float:
    positive = sorted(h for h in heights if h > 0)
    return positive[len(positive) // 2] if positive else default


def axis_gaps(spans: list[tuple[float, float]], extent: float) -> list[tuple[int, int]]:
    """Runs of [0, extent] that no span covers, at a resolution of one unit, from the running maximum of the span ends."""
    size = max(1, int(extent) + 1)
    covered = sorted((max(0, int(a)), min(size, int(b) + 1)) for a, b in spans)
    gaps, reach = [], 0
    for start, end in covered:
        if start >= end:
            continue
        if start > reach:
            gaps.append((reach, start))
        reach = max(reach, end)
    if reach < size:
        gaps.append((reach, size))
    return gaps


def _inner(gaps: list[tuple[int, int]], least: int, low: float, high: float) -> list[float]:
    """Middles of the gaps that are wide enough and touch the inside of the content."""
    return [(a + b) / 2 for a, b in gaps if b - a >= least and b > low and a < high]


def _parts(members: list[int], middles: list[float], value: Callable[[int], float]) -> list[list[int]]:
    if not middles:
        return [members]
    bins: dict[int, list[int]] = {}
    for i in members:
        bins.setdefault(sum(m <= value(i) for m in middles), []).append(i)
    return [bins[k] for k in sorted(bins)]


def cut_regions(rects: list[Rect], width: float, height: float, wide: float = 0.45) -> list[list[int]]:
    """Leaves of the recursive cut, in order. Columns first, without banners next, then rows; worked off with a stack."""
    leaves: list[list[int]] = []
    stack = [list(range(len(rects)))] if rects else []
    while stack:
        group = stack.pop()
        parts = [group]
        if len(group) > 1:
            own = [rects[i] for i in group]
            mid = _median([r[3] - r[1] for r in own])
            columns, rows = max(4, int(mid * 0.35)), max(8, int(mid * 0.8))
            low, high = min(r[0] for r in own), max(r[2] for r in own)
            x_mid = lambda i: (rects[i][0] + rects[i][2]) / 2
            y_mid = lambda i: (rects[i][1] + rects[i][3]) / 2
            found = _inner(axis_gaps([(r[0], r[2]) for r in own], width), columns, low, high)
            if not found and wide > 0:
                found = _inner(axis_gaps([(r[0], r[2]) for r in own if r[2] - r[0] <= width * wide], width), columns, low, high)
            parts = _parts(group, found, x_mid)
            if len(parts) == 1:
                found = _inner(axis_gaps([(r[1], r[3]) for r in own], height), rows, min(r[1] for r in own), max(r[3] for r in own))
                parts = _parts(group, found, y_mid)
        if len(parts) == 1:
            leaves.append(group)
        else:
            stack.extend(reversed(parts))
    return leaves


def text_lines(rects: list[Rect], overlap: float = 0.4, gap_factor: float = 1.8) -> list[list[int]]:
    """Lines of boxes: each box joins the line whose last box it overlaps in y with the smallest gap in x; flat boxes are skipped."""
    reach = max(15.0, _median([r[3] - r[1] for r in rects]) * gap_factor)
    lines: list[list[int]] = []
    for i in sorted(range(len(rects)), key=lambda k: (rects[k][1], rects[k][0])):
        x0, y0, _, y1 = rects[i]
        if y1 <= y0:
            continue
        fits = []
        for n, line in enumerate(lines):
            last = rects[line[-1]]
            shared = max(0.0, min(last[3], y1) - max(last[1], y0))
            if shared / min(last[3] - last[1], y1 - y0) >= overlap and x0 - last[2] <= reach:
                fits.append((x0 - last[2], n))
        if fits:
            lines[min(fits)[1]].append(i)
        else:
            lines.append([i])
    for line in lines:
        line.sort(key=lambda k: rects[k][0])
    return sorted(lines, key=lambda line: sum(rects[k][1] for k in line) / len(line))


def reading_order(rects: list[Rect], overlap: float = 0.4) -> list[int]:
    """Order of boxes: strips by the running average of their span, left to right inside a strip."""
    strips: list[list[int]] = []
    sums: list[list[float]] = []
    for i in sorted(range(len(rects)), key=lambda k: (rects[k][1], rects[k][0])):
        y0, y1 = rects[i][1], rects[i][3]
        for strip, total in zip(strips, sums):
            top, bottom = total[0] / len(strip), total[1] / len(strip)
            if y0 < bottom and y1 > top and (min(y1, bottom) - max(y0, top)) / min(max(1.0, y1 - y0), max(1.0, bottom - top)) >= overlap:
                strip.append(i)
                total[0] += y0
                total[1] += y1
                break
        else:
            strips.append([i])
            sums.append([y0, y1])
    return [i for strip in strips for i in sorted(strip, key=lambda k: rects[k][0])]


def _rects(part: pa.Table) -> list[Rect]:
    return list(zip(*(part.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1"))))


def lay_out_lines(blocks: DataFrame, sizes: DataFrame, wide: float = 0.45) -> DataFrame:
    """region_no, line_no (inside the region) and box_no (inside the line) of every block; boxes without height are left out."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("block_idx")
        rects = _rects(part)
        width, height = (part.column(c)[0].as_py() or 0.0 for c in ("width", "height"))
        out: list[tuple[int, int, int, int]] = []
        for r, region in enumerate(cut_regions(rects, width, height, wide)):
            for n, line in enumerate(text_lines([rects[i] for i in region])):
                out += [(region[k], r, n, at) for at, k in enumerate(line)]
        rows = part.take(pa.array([o[0] for o in out], pa.int64())).drop_columns(["width", "height"])
        for k, name in enumerate(("region_no", "line_no", "box_no"), 1):
            rows = rows.append_column(name, pa.array([o[k] for o in out], pa.int32()))
        return rows

    own = blocks.select(*PAGE, "block_idx", "x0", "y0", "x1", "y1", "text", "font_size")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.join(sizes, PAGE, "left").groupBy(*PAGE).applyInArrow(run, f"{schema}, region_no int, line_no int, box_no int")


def break_paragraphs(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``lines`` (box and text of each line) with para_no: text starts, large gaps, changed heights, short and indented lines.

    ``keys`` name the block of lines that is looked at together, ``order`` the order of its lines.
    """
    region = Window.partitionBy(*keys)
    run = region.orderBy(*order)
    lag = lambda c: F.lag(c).over(run)
    height = F.col("y1") - F.col("y0")
    gap = F.col("y0") - lag("y1")
    rows = lines.withColumns({"_h": height, "_gap": gap})
    rows = rows.withColumns({
        "_mean": F.avg("_h").over(region), "_left": F.min("x0").over(region), "_right": F.max("x1").over(region),
        "_mean_gap": F.avg(F.when(F.col("_gap") >= 0, F.col("_gap"))).over(region),
        "_ph": lag("_h"), "_pr": lag("x1"), "_pl": lag("x0"), "_first": F.row_number().over(run) == 1,
    })
    c = F.col
    limit = F.greatest(c("_mean") * 0.5, F.coalesce(c("_mean_gap"), c("_mean") * 0.25) * 1.4, F.lit(5.0))
    ratio = F.when((c("_ph") > 0) & (c("_h") > 0), F.greatest("_ph", "_h") / F.least("_ph", "_h")).otherwise(F.lit(1.0))
    broad = c("_right") - c("_left") > c("_mean") * 2.5
    short = broad & (c("_right") - c("_pr") > c("_mean")) & (c("_gap") > 0)
    indent = broad & (c("x0") - c("_left") > c("_mean") * 0.4) & (F.abs(c("_pl") - c("_left")) < c("_mean") * 0.5)
    split = starts_paragraph(c("text")) | (c("_gap") > limit) | (ratio > 1.25) | short | indent
    rows = rows.withColumn("_s", (~c("_first") & F.coalesce(split, F.lit(False))).cast("int"))
    return rows.withColumn("para_no", F.sum("_s").over(run.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop(*(n for n in rows.columns if n.startswith("_")))


def merge_edges(paragraphs: DataFrame, medians: DataFrame) -> DataFrame:
    """Pairs a_idx < b_idx of paragraphs of a page that belong together. ``medians``: median_height of each page's lines.

    The rule of two boxes that overlap in both directions (20 % and 80 %) is implied by the row rule and left out.
    """
    a_side = paragraphs.select(*PAGE, F.col("para_idx").alias("a_idx"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b_side = paragraphs.select(*PAGE, F.col("para_idx").alias("b_idx"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    a, b = g.box("a_"), g.box("b_")
    floor = lambda c: F.greatest(F.lit(1.0), c)
    x_ratio = g.horizontal_overlap(a, b) / F.least(floor(a.width), floor(b.width))
    y_ratio = g.vertical_overlap(a, b) / F.least(floor(a.height), floor(b.height))
    med = F.col("median_height")
    joined = (
        (g.iou(a, b) > 0.12) | (g.overlap_min(a, b) > 0.60)
        | ((x_ratio >= 0.55) & (g.vertical_separation(a, b) <= F.greatest(F.lit(6.0), med * 0.65)))
        | ((y_ratio >= 0.55) & (g.horizontal_separation(a, b) <= F.greatest(F.lit(8.0), med * 0.75)))
    )
    return a_side.join(b_side, PAGE).where("a_idx < b_idx").join(medians, PAGE).where(joined).select(*PAGE, "a_idx", "b_idx")


def _components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    label = list(range(n))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in edges:
        ra, rb = root(a), root(b)
        label[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(n)]


def group_paragraphs(paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """``paragraphs`` with group_idx, the smallest para_idx of its connected component; one pass over the pages' edges."""

    def run(part: pa.Table) -> pa.Table:
        idx = part.column("para_idx").to_pylist()
        at = {x: k for k, x in enumerate(idx)}
        links = [(at[a], at[b]) for x, a in zip(part.column("links").to_pylist(), idx) for b in x or ()]
        label = _components(len(idx), links)
        lowest: dict[int, int] = {}
        for k, root in enumerate(label):
            lowest[root] = min(lowest.get(root, idx[k]), idx[k])
        return part.drop_columns(["links"]).append_column("group_idx", pa.array([lowest[r] for r in label], pa.int32()))

    links = edges.groupBy(*PAGE, F.col("a_idx").alias("para_idx")).agg(F.collect_list("b_idx").alias("links"))
    own = paragraphs.select(*PAGE, F.col("para_idx").cast("int").alias("para_idx"))
    return own.join(links, [*PAGE, "para_idx"], "left").groupBy(*PAGE).applyInArrow(run, f"doc_id bigint, page_num bigint, para_idx int, group_idx int")


def merged_paragraphs(lines: DataFrame, paragraphs: DataFrame, medians: DataFrame, order: tuple[str, ...] = ("y0", "x0", "para_idx", "block_idx")) -> DataFrame:
    """Merged paragraphs: group_idx, box, text and n_lines over all lines (``lines`` has para_idx and the box of each line)."""
    groups = group_paragraphs(paragraphs, merge_edges(paragraphs, medians))
    rows = lines.join(groups, [*PAGE, "para_idx"])
    fs = g.font_estimate(F.col("font_size"), g.box())
    return rows.groupBy(*PAGE, "group_idx").agg(
        ordered_concat(F.struct(*order), F.col("text")).alias("text"), *g.union_box(),
        F.count("*").alias("n_lines"), F.coalesce(F.avg(F.when(fs > 0, fs)), F.lit(0.0)).alias("font_size"),
    )


def order_pages(boxes: DataFrame, id_col: str) -> DataFrame:
    """doc_id, page_num, ``id_col`` and reading_no of the boxes of each page."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("y0", "ascending"), ("x0", "ascending"), (id_col, "ascending")])
        order = reading_order(_rects(part))
        rows = part.select([*PAGE, id_col]).take(pa.array(order, pa.int64()))
        return rows.append_column("reading_no", pa.array(range(len(order)), pa.int32()))

    kind = boxes.schema[id_col].dataType.simpleString()
    return boxes.select(*PAGE, id_col, "x0", "y0", "x1", "y1").groupBy(*PAGE).applyInArrow(run, f"doc_id bigint, page_num bigint, {id_col} {kind}, reading_no int")


_NUMBERED = re.compile(f"(?:\\([0-9]{{1,2}}\\)|[0-9]{{1,2}}[.)]|[\u2460-\u2473\u2776-\u277f])(?:[\\s\u3000]|$)|[{BULLETS}]")
_LEADING = re.compile(f"^{BLANK}+")


def opens_paragraph(text: str) -> bool:
    """``starts_paragraph`` of one text."""
    bare = _LEADING.sub("", text)
    return bare != "" and (text.startswith(("\u3000", "  ")) or _NUMBERED.match(bare) is not None)


def split_lines(rects: list[Rect], texts: list[str]) -> list[int]:
    """Paragraph number of each line of a region, by the rules of ``break_paragraphs``."""
    if not rects:
        return []
    heights = [r[3] - r[1] for r in rects]
    gaps = [b[1] - a[3] for a, b in zip(rects, rects[1:])]
    mean, left, right = sum(heights) / len(heights), min(r[0] for r in rects), max(r[2] for r in rects)
    positive = [g for g in gaps if g >= 0]
    limit = max(mean * 0.5, (sum(positive) / len(positive) if positive else mean * 0.25) * 1.4, 5.0)
    broad, out = right - left > mean * 2.5, [0]
    for k in range(1, len(rects)):
        gap, before, h = gaps[k - 1], heights[k - 1], heights[k]
        changed = before > 0 and h > 0 and max(before, h) / min(before, h) > 1.25
        short = broad and right - rects[k - 1][2] > mean and gap > 0
        indent = broad and rects[k][0] - left > mean * 0.4 and abs(rects[k - 1][0] - left) < mean * 0.5
        out.append(out[-1] + (opens_paragraph(texts[k]) or gap > limit or changed or short or indent))
    return out


def joined_pairs(rects: list[Rect], median: float) -> list[tuple[int, int]]:
    """Pairs of paragraph boxes that belong together, by the rules of ``merge_edges``."""
    if len(rects) < 2:
        return []
    a = np.array(rects, float)
    at, to = np.triu_indices(len(a), 1)
    a, b = a[at], a[to]
    wide, high = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    width, height = (np.stack([x[:, k + 2] - x[:, k] for x in (a, b)]) for k in (0, 1))
    common = np.where((wide > 0) & (high > 0), wide * high, 0.0)
    area = width * height
    ratio = lambda part, whole: np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)
    x_ratio = np.maximum(wide, 0) / np.minimum(*np.maximum(1.0, width))
    y_ratio = np.maximum(high, 0) / np.minimum(*np.maximum(1.0, height))
    apart = lambda k: np.maximum(0.0, np.maximum(b[:, k] - a[:, k + 2], a[:, k] - b[:, k + 2]))
    joined = (
        (ratio(common, area.sum(0) - common) > 0.12) | (ratio(common, area.min(0)) > 0.60)
        | ((x_ratio >= 0.55) & (apart(1) <= max(6.0, median * 0.65)))
        | ((y_ratio >= 0.55) & (apart(0) <= max(8.0, median * 0.75)))
    )
    return list(zip(at[joined].tolist(), to[joined].tolist()))


def _union(rects: list[Rect]) -> Rect:
    return min(r[0] for r in rects), min(r[1] for r in rects), max(r[2] for r in rects), max(r[3] for r in rects)


def lay_out_page(rects: list[Rect], texts: list[str], width: float, height: float, wide: float = 0.45) -> list[list[int]]:
    """Boxes of a page (in order of block_idx) to merged paragraphs in reading order, each with its boxes in order."""
    paragraphs: list[list[int]] = []
    for region in cut_regions(rects, width, height, wide):
        lines = [[region[k] for k in line] for line in text_lines([rects[i] for i in region])]
        numbers = split_lines([_union([rects[i] for i in line]) for line in lines], ["".join(texts[i] for i in line) for line in lines])
        own: list[list[int]] = [[] for _ in range(numbers[-1] + 1 if numbers else 0)]
        for number, line in zip(numbers, lines):
            own[number] += line
        paragraphs += own
    if len(paragraphs) == 1:
        return paragraphs  # a page of one paragraph keeps its line order
    boxes = [_union([rects[i] for i in p]) for p in paragraphs]
    label = _components(len(boxes), joined_pairs(boxes, _median([rects[i][3] - rects[i][1] for p in paragraphs for i in p])))
    groups: dict[int, list[tuple[float, float, int, int]]] = {}
    for k, p in enumerate(paragraphs):
        groups.setdefault(label[k], []).extend((rects[i][1], rects[i][0], k, i) for i in p)
    merged = [[i for _, _, _, i in sorted(groups[root])] for root in sorted(groups)]
    return [merged[k] for k in reading_order([_union([rects[i] for i in m]) for m in merged])]


LINE = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double>"


def lay_out_pages(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, page_num, para_idx (reading order) and lines array<struct> of the merged paragraphs of each page, and the page's size.

    One shuffle by page; boxes without height are left out, as in line detection.
    """
    line = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "font_size"))])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("block_idx")
        rects, texts, fonts = _rects(part), [x or "" for x in part.column("text").to_pylist()], part.column("font_size").to_pylist()
        width, height = (part.column(c)[0].as_py() or 0.0 for c in ("width", "height"))
        found = lay_out_page(rects, texts, width, height)
        lines = [[{"text": texts[i], "x0": rects[i][0], "y0": rects[i][1], "x1": rects[i][2], "y1": rects[i][3], "font_size": fonts[i]} for i in p] for p in found]
        n = len(found)
        columns = [*(pa.array([part.column(c)[0].as_py()] * n, pa.int64()) for c in PAGE), pa.array(range(n), pa.int32()), pa.array(lines, pa.list_(line)), pa.array([width] * n, pa.float64()), pa.array([height] * n, pa.float64())]
        return pa.Table.from_arrays(columns, [*PAGE, "para_idx", "lines", "width", "height"])

    own = blocks.select(*PAGE, "block_idx", "x0", "y0", "x1", "y1", "text", "font_size")
    schema = f"doc_id bigint, page_num bigint, para_idx int, lines array<{LINE}>, width double, height double"
    return own.join(sizes, PAGE, "left").groupBy(*PAGE).applyInArrow(run, schema)


def paragraphs_of(pages: DataFrame) -> DataFrame:
    """Classified paragraphs of ``lay_out_pages``: reading_no, layout_type, text, box, n_lines, font_size."""
    item = lambda c: F.transform("lines", lambda x: x[c])
    fonts = F.filter(F.transform("lines", lambda x: F.when(x["font_size"] > 0, x["font_size"]).otherwise(x["y1"] - x["y0"])), lambda x: x > 0)
    mean = F.when(F.size(fonts) > 0, F.aggregate(fonts, F.lit(0.0), lambda a, x: a + x) / F.size(fonts)).otherwise(F.lit(0.0))
    rows = pages.select(*PAGE, F.col("para_idx").alias("reading_no"), F.array_join(item("text"), "").alias("text"), F.array_min(item("x0")).alias("x0"), F.array_min(item("y0")).alias("y0"), F.array_max(item("x1")).alias("x1"), F.array_max(item("y1")).alias("y1"), F.size("lines").cast("bigint").alias("n_lines"), mean.alias("font_size"), "width", "height")
    kind = g.layout_class(g.box(), F.col("width"), F.col("height"), F.col("font_size"), F.length("text"), F.col("n_lines"))
    return rows.select(*PAGE, "reading_no", kind.alias("layout_type"), "text", "x0", "y0", "x1", "y1", "n_lines", "font_size")


def layout_paragraphs(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Classified paragraphs of every page in reading order: reading_no, layout_type, text, box, n_lines, font_size."""
    return paragraphs_of(lay_out_pages(blocks, sizes))


def page_gaps(blocks: DataFrame, sizes: DataFrame, axis: str) -> DataFrame:
    """Inner gaps of each page along ``axis`` ('x' or 'y'), as windows: gap_start, gap_end.

    A gap lies between the running maximum of the span ends and the next span start; the page's edges close the ends.
    """
    lo, hi, extent = (f"{axis}0", f"{axis}1", "width" if axis == "x" else "height")
    factor, least = (0.35, 4) if axis == "x" else (0.8, 8)
    page = Window.partitionBy(*PAGE)
    size = F.greatest(F.lit(1), F.col(extent).cast("int") + 1)
    rows = blocks.join(sizes, PAGE).withColumns({"_size": size, "_low": F.min(lo).over(page), "_high": F.max(hi).over(page), "_n": F.count("*").over(page)})
    medians = blocks.groupBy(*PAGE).agg(g.upper_median(F.col("y1") - F.col("y0")).alias("_med"))
    spans = rows.withColumns({"_s": F.greatest(F.lit(0), F.col(lo).cast("int")), "_e": F.least("_size", F.col(hi).cast("int") + 1)}).where("_s < _e and _n > 1")
    order = page.orderBy("_s", "_e", "block_idx")
    spans = spans.withColumns({"_reach": F.coalesce(F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_last": F.max("_e").over(page), "_k": F.row_number().over(order)})
    between = spans.where("_s > _reach").select(*PAGE, F.col("_reach").alias("gap_start"), F.col("_s").alias("gap_end"), "_low", "_high")
    behind = spans.where("_k = 1 and _last < _size").select(*PAGE, F.col("_last").alias("gap_start"), F.col("_size").alias("gap_end"), "_low", "_high")
    gaps = between.unionAll(behind).join(medians, PAGE)
    wide = F.col("gap_end") - F.col("gap_start") >= F.greatest(F.lit(least), (F.col("_med") * factor).cast("int"))
    return gaps.where(wide & (F.col("gap_end") > F.col("_low")) & (F.col("gap_start") < F.col("_high"))).select(*PAGE, "gap_start", "gap_end")


def cut_once(blocks: DataFrame, gaps: DataFrame) -> DataFrame:
    """First vertical cut of each page: region_no, the number of gap middles at or left of the box's middle."""
    middles = gaps.groupBy(*PAGE).agg(F.collect_list((F.col("gap_start") + F.col("gap_end")) / 2).alias("_m"))
    mid = (F.col("x0") + F.col("x1")) / 2
    region = F.size(F.filter(F.coalesce("_m", F.array().cast("array<double>")), lambda m: m <= mid))
    return blocks.join(middles, PAGE, "left").withColumn("region_no", region).drop("_m")


ALGORITHMS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_algorithm(name: str, algorithm: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Add a clustering algorithm (blocks, sizes) -> paragraphs."""
    ALGORITHMS[name] = algorithm


def cluster(blocks: DataFrame, sizes: DataFrame, algorithm: str = "simple") -> DataFrame:
    """Paragraphs by a registered algorithm; an unknown name is an error."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; there are {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[algorithm](blocks, sizes)


def cluster_with_lines(blocks: DataFrame, sizes: DataFrame, algorithm: str = "simple") -> tuple[DataFrame, DataFrame]:
    """Paragraphs (para_idx, text, box, n_lines) and their printed lines (para_idx, line_idx, text, box, font_size)."""
    from .simple import numbered_blocks, simple_paragraphs

    line = ["text", "x0", "y0", "x1", "y1", "font_size"]
    if algorithm == "simple":
        paragraphs = simple_paragraphs(blocks).select(*PAGE, F.col("para_idx").cast("int").alias("para_idx"), "text", "x0", "y0", "x1", "y1", "n_lines")
        return paragraphs, numbered_blocks(blocks).select(*PAGE, "para_idx", "line_idx", F.coalesce("text", F.lit("")).alias("text"), *line[1:])
    if algorithm != "layout":
        raise ValueError(f"no lines from algorithm {algorithm!r}")
    pages = lay_out_pages(blocks, sizes)
    lines = pages.select(*PAGE, "para_idx", F.posexplode("lines").alias("line_idx", "l")).select(*PAGE, "para_idx", "line_idx", *(f"l.{c}" for c in line))
    return paragraphs_of(pages).withColumnRenamed("reading_no", "para_idx").select(*PAGE, "para_idx", "text", "x0", "y0", "x1", "y1", "n_lines"), lines


def _simple(blocks: DataFrame, _: DataFrame) -> DataFrame:
    from .simple import simple_paragraphs

    return simple_paragraphs(blocks)


register_algorithm("simple", _simple)
register_algorithm("layout", layout_paragraphs)
