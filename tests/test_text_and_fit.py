from pyspark.sql import functions as F

from quire.functions import fit
from quire.functions import text as t


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


def test_predicates(spark):
    assert one(spark, "　 日本 ", t.strip) == "日本"
    assert one(spark, None, t.is_blank) and one(spark, "　", t.is_blank)
    for value, expected in (("　字下げ", True), ("  x", True), ("(1) a", True), ("①", True), ("① x", True), ("- a", True), ("3.5", False), ("本文", False), ("", False), (None, False)):
        assert one(spark, value, t.starts_paragraph) is expected, value
    assert one(spark, "Output ONLY the text", t.prompt_echo)
    pair = spark.createDataFrame([("日本", " 日本"), ("abc", "abc"), ("かな", "中文"), ("漢字", "abc")], "a string, b string")
    rows = pair.select(t.identity_failure(F.col("a"), F.col("b")).alias("i"), t.valid_target(F.col("a"), F.col("b")).alias("v")).collect()
    assert [(r.i, r.v) for r in rows] == [(True, True), (False, True), (False, True), (False, False)]


def test_replies(spark):
    from quire.operators.translate import parse_replies

    rows = [("a", '{"items":[{"id":0,"text":" 甲 "},{"id":0,"text":"乙"},{"id":null,"text":"x"},{"id":2,"text":null}]}'), ("b", "not json"), ("c", '{"items":[{"id":1,"text":"json object"}]}')]
    out = parse_replies(spark.createDataFrame(rows, "chunk_id string, reply string")).collect()
    assert [(r.chunk_id, r.gid, r.reply) for r in out] == [("a", 0, "乙")]


def wrap_by_prefix(text, width, font):
    measure = lambda s: sum(font if "一" <= c <= "鿿" or "　" <= c <= "ヿ" else font * 0.5 for c in s)
    if not text.strip() or width < 2:
        return [text] if text.strip() else []
    lines, rest = [], text.strip()
    while rest:
        n = 0
        while n < len(rest) and measure(rest[: n + 1]) <= width * 0.95:
            n += 1
        n = max(n, 1)
        lines.append(rest[:n].strip())
        rest = rest[n:].strip()
    return lines


def test_wrap_and_fit():
    for text in ("漢字かな交じりの文 with English words", "a b  c", "　", "", "x" * 50, "あ い　う"):
        for width in (1.0, 8.0, 30.0, 100.0):
            for font in (4, 7, 12):
                assert fit.wrap_line(text, width, font) == wrap_by_prefix(text, width, font), (text, width, font)
    assert fit.fit_text("漢字" * 30, 100.0, 30.0, 12)[0] == 6
    assert fit.fit_text("漢字", 100.0, 30.0, 12) == (12, ["漢字"])
    assert fit.fit_text(None, 100.0, 30.0, 12) == (12, [])


def test_splits():
    assert fit.proportional_parts("abcdef", [1, 1, 1]) == ["ab", "cd", "ef"]
    assert fit.proportional_parts("abc", [0, 0]) == ["", "abc"]
    assert fit.proportional_parts("", [3, 4]) == ["", ""] and fit.proportional_parts(None, []) == []
    assert fit.width_parts("漢字漢字漢字", [13.0, 1.0, 40.0], [20.0, 20.0, 20.0]) == ["漢字", "", "漢字漢字"]


def test_cluster_split(spark):
    rows = spark.createDataFrame([("第一段落译文\n第二段落译文",)], "v string").select(fit.split_cluster_text(F.col("v"), F.lit(2)).alias("r"), fit.split_cluster_text(F.col("v"), F.lit(3)).alias("n")).first()
    assert rows.r == ["第一段落译文", "第二段落译文"] and rows.n is None
