import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import layout, simple

SCHEMA = "doc_id bigint, page_num bigint, block_idx int, x0 double, y0 double, x1 double, y1 double, text string, source string, font_size double"


def blocks(spark, boxes, source="native"):
    return spark.createDataFrame([(1, 1, i, *map(float, b[:4]), b[4], source, 0.0) for i, b in enumerate(boxes)], SCHEMA)


def texts(df):
    return [r.text for r in df.orderBy("para_idx").collect()]


@pytest.mark.parametrize(
    ("boxes", "expected"),
    [
        ([(0, 0, 100, 20, "Hello")], ["Hello"]),
        ([(0, 0, 100, 20, "Line 1"), (0, 25, 100, 45, "Line 2")], ["Line 1Line 2"]),
        ([(0, 0, 100, 20, "Para 1"), (0, 100, 100, 120, "Para 2")], ["Para 1", "Para 2"]),
        ([(0, 0, 100, 20, "Left 1"), (0, 25, 100, 45, "Left 2"), (200, 0, 300, 20, "Right 1")], ["Left 1Left 2", "Right 1"]),
        ([(400, 0, 500, 20, "Right"), (200, 0, 300, 20, "Middle"), (0, 0, 100, 20, "Left")], ["Left", "Middle", "Right"]),
        ([], []),
    ],
)
def test_simple_clustering(spark, boxes, expected):
    assert texts(simple.simple_paragraphs(blocks(spark, boxes))) == expected


def test_merge_of_fragments(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 1, 80.0, 30.0, 180.0, 70.0), (1, 2, 0, 20.0, 0.0, 220.0, 40.0), (1, 2, 1, 22.0, 46.0, 218.0, 86.0), (1, 3, 0, 0.0, 0.0, 50.0, 10.0), (1, 3, 1, 300.0, 400.0, 350.0, 410.0)]
    paras = spark.createDataFrame(rows, "doc_id bigint, page_num bigint, para_idx int, x0 double, y0 double, x1 double, y1 double")
    medians = spark.createDataFrame([(1, 1, 12.0), (1, 2, 12.0), (1, 3, 12.0)], "doc_id bigint, page_num bigint, median_height double")
    groups = layout.group_paragraphs(paras, layout.merge_edges(paras, medians)).collect()
    assert {(r.page_num, r.para_idx): r.group_idx for r in groups} == {(1, 0): 0, (1, 1): 0, (2, 0): 0, (2, 1): 0, (3, 0): 0, (3, 1): 1}


ITEMS = [(0, 0, 100, 20, "1. First item"), (0, 24, 100, 44, "continuation"), (0, 60, 100, 80, "2. Second item"), (0, 84, 100, 104, "continuation")]


def test_numbered_items_are_split(spark):
    rows = layout.break_paragraphs(blocks(spark, ITEMS), ["doc_id", "page_num"], ["y0", "x0", "block_idx"]).orderBy("y0").collect()
    assert [r.para_no for r in rows] == [0, 0, 1, 1]


def test_layout_end_to_end(spark):
    sizes = spark.createDataFrame([(1, 1, 200.0, 200.0)], "doc_id bigint, page_num bigint, width double, height double")
    rows = layout.layout_paragraphs(blocks(spark, ITEMS, "ocr"), sizes).orderBy("reading_no").collect()
    assert [r.text[:8] for r in rows] == ["1. First", "2. Secon"]


def cut_by_profile(rects, width, height):
    """Plain recursive cut over a pixel profile, as an independent statement of the rule."""

    def gaps(spans, extent):
        profile = [0] * max(1, int(extent) + 1)
        for a, b in spans:
            for k in range(max(0, int(a)), min(len(profile), int(b) + 1)):
                profile[k] += 1
        out, k = [], 0
        while k < len(profile):
            if profile[k]:
                k += 1
                continue
            start = k
            while k < len(profile) and not profile[k]:
                k += 1
            out.append((start, k))
        return out

    def run(ids):
        if len(ids) <= 1:
            return [ids]
        own = [rects[i] for i in ids]
        heights = sorted(r[3] - r[1] for r in own if r[3] > r[1])
        med = heights[len(heights) // 2] if heights else 12.0
        low, high = min(r[0] for r in own), max(r[2] for r in own)
        pick = lambda g, least, lo, hi: [x for x in g if x[1] - x[0] >= least and x[1] > lo and x[0] < hi]
        found = pick(gaps([(r[0], r[2]) for r in own], width), max(4, int(med * 0.35)), low, high)
        if not found:
            found = pick(gaps([(r[0], r[2]) for r in own if r[2] - r[0] <= width * 0.45], width), max(4, int(med * 0.35)), low, high)
        for g, a, b in ((found, 0, 2), (pick(gaps([(r[1], r[3]) for r in own], height), max(8, int(med * 0.8)), min(r[1] for r in own), max(r[3] for r in own)), 1, 3)):
            bins = {}
            for i in ids:
                mid, k = (rects[i][a] + rects[i][b]) / 2, 0
                for s, e in g:
                    if mid < s or (mid <= e and mid - s < e - mid):
                        break
                    k += 1
                    if s <= mid <= e:
                        break
                bins.setdefault(k, []).append(i)
            if len(bins) > 1:
                return [leaf for k in sorted(bins) for leaf in run(bins[k])]
        return [ids]

    return run(list(range(len(rects)))) if rects else []


RECT = st.tuples(st.integers(-10, 180), st.integers(-10, 180), st.integers(-5, 90), st.integers(0, 40)).map(lambda t: (t[0] / 1.0, t[1] / 1.0, (t[0] + t[2]) / 1.0, (t[1] + t[3]) / 1.0))


@settings(max_examples=300, deadline=None)
@given(st.lists(RECT, max_size=12))
def test_recursive_cut_equals_profile_cut(rects):
    leaves = layout.cut_regions(rects, 200.0, 200.0)
    assert leaves == cut_by_profile(rects, 200.0, 200.0)
    assert sorted(i for leaf in leaves for i in leaf) == list(range(len(rects)))


@settings(max_examples=100, deadline=None)
@given(st.lists(RECT, max_size=15))
def test_order_and_lines_keep_every_box(rects):
    assert sorted(layout.reading_order(rects)) == list(range(len(rects)))
    lines = layout.text_lines(rects)
    assert sorted(i for line in lines for i in line) == [i for i, r in enumerate(rects) if r[3] > r[1]]


def test_engine_merge_keeps_longer_text(spark):
    from quire.operators.boxes import merge_engines, merge_horizontally

    rows = merge_engines(blocks(spark, [(0, 0, 100, 20, "ab"), (2, 1, 101, 21, "abc"), (0, 50, 10, 60, "x"), (1, 1, 99, 20, "z")], "ocr")).collect()
    assert sorted(r.text for r in rows) == ["abc", "x"]
    rows = merge_horizontally(blocks(spark, [(0, 0, 10, 10, "a"), (12, 0, 20, 11, "b"), (21, 0, 30, 10, "c"), (80, 0, 90, 10, "d")])).orderBy("x0").collect()
    assert [r.text for r in rows] == ["abc", "d"]


def test_engine_merge_equals_loop(spark):
    from quire.operators.boxes import merge_engines

    rnd = random.Random(3)
    boxes = []
    for _ in range(40):
        x, y = rnd.randint(0, 100), rnd.randint(0, 100)
        boxes.append((x, y, x + rnd.randint(0, 40), y + rnd.randint(0, 15), "t" * rnd.randint(1, 5)))
    kept = []
    for b in sorted(enumerate(boxes), key=lambda p: (p[1][1], p[1][0], p[0])):
        b = b[1]
        for k, o in enumerate(kept):
            w, h = min(o[2], b[2]) - max(o[0], b[0]), min(o[3], b[3]) - max(o[1], b[1])
            least = min((o[2] - o[0]) * (o[3] - o[1]), (b[2] - b[0]) * (b[3] - b[1]))
            if w > 0 and h > 0 and least > 0 and w * h / least > 0.3:
                if len(b[4]) > len(o[4]):
                    kept[k] = b
                break
        else:
            kept.append(b)
    rows = merge_engines(blocks(spark, boxes, "ocr")).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1, r.text) for r in rows) == sorted((*map(float, k[:4]), k[4]) for k in kept)


def test_image_filter(spark):
    from quire.operators.boxes import filter_image_text

    images = spark.createDataFrame([(1, 1, 0, 100.0, 100.0, 220.0, 220.0, 595.0, 842.0, 300)], "doc_id bigint, page_num bigint, image_idx int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, dpi int")
    rows = blocks(spark, [(450, 2700, 520, 2750, "731"), (40, 40, 100, 70, "Caption")], "ocr")
    assert [r.text for r in filter_image_text(rows, images).collect()] == ["Caption"]
    assert filter_image_text(rows, images.limit(0)).count() == 2
