"""Problems 1, 3, 4, 5, 6, 7, 9 on single texts."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import alignment, encoding, lookalike, misreads, pairs, reading_level, scan_noise, splitting

LABELS = re.compile("(?:品名|型番|数量)" + pairs.SEPARATOR)
ENDS = frozenset({"水泵", "0台"})


@pytest.mark.parametrize(
    ("prompt", "answer", "defect"),
    [
        (None, "x", None), ("　\n", "", None), ("本件の番号は1である。", None, "empty"), ("本件の番号は1である。", " ​", "empty"), ("本件の番号は1である。", "（空）", "empty"),
        ("本件の番号は1である。", "抱歉，我无法翻译这段内容。", "refusal"), ("本件の番号は1である。", "抱歉，我无法翻译“本件の番号……”这一句。", "refusal"),
        ("本件の番号は1である。", "I'm sorry, but this request cannot be completed.", "refusal"), ("本件の番号は1である。", "この文章は翻訳できません。", "refusal"),
        ("申し訳ありませんが、館では貸出しを行っておりません。", "很抱歉，馆不提供出借服务。", None),
        ("本件の番号は1である。", "Translation: 本件の番号は1である。", "copy"), ("本件の番号は1である。", "本件の番号は\n1である", "copy"),
        ("AB-123", "AB-123", None), ("图书", "图书", None), ("図書", "図書", "copy"),
        ("本件の番号は1である。", "The number of this case is one.", "wrong_language"), ("本件の番号は1である。", "창고에 3개의 부품이 보관되어 있습니다.", "wrong_language"), ("本件の番号は1である。", "この文章は別の話です。", "wrong_language"),
        ("外箱にGreat Exampleの文字がある。", "箱上有Great Example。", None),
        ("本件の番号は1である。次もある。", "本件的番号为1。", None), ("本件の番号は1である。", "本件的番", "truncated"), ("本件の番号は1である。", "本件的番号……", "truncated"),
        ("品名：ポンプ；型番：AB-1；数量：10台", "品名：水泵；型号：AB-1；数量：10台", None), ("品名：ポンプ；型番：AB-1；数量：10台", "品名：水泵；型号：AB-1；", "truncated"), ("品名：ポンプ；型番：AB-1；数量：10台", "品名：水泵；型号：AB-1", "truncated"),
        ("図5　水門の点検 AB-1234", "图5　水闸的检查 AB-1234", None), ("図5　水門の点検 AB-1234", "图5　水闸的检查 AB-1", "truncated"),
    ],
)
def test_defects(prompt, answer, defect):
    assert pairs.classify(prompt, answer, LABELS, ENDS) == defect


def test_very_long_pair():
    text = "本件の番号は1である。" * 5000
    assert pairs.classify(text, text, LABELS, ENDS) == "copy"


def test_long_refusals():
    source, reason = "本件の番号は1である。次の番号も記す。" * 30, "原文涉及的资料缺失较多，文字模糊难以辨认。" * 40
    for answer in (f"抱歉，我无法翻译这段内容。{reason}", f"{source}抱歉，我无法翻译这段内容。", f"I cannot translate this. {source}", f"抱歉，我无法翻译“{source}”这一句。"):
        assert pairs.classify(source, answer, LABELS, ENDS) == "refusal"
    assert not pairs.is_refusal(f"{reason}他们说明无法翻译这段内容的原因。{reason}")


def test_long_copies_by_common_subsequence():
    text = "".join(chr(0x3042 + k * 7 % 80) + chr(0x4E00 + k) for k in range(2500))
    answer = "".join(c for k, c in enumerate(text) if k % 7)  # 6 of 7 characters in order, 4 of 7 shingles
    for size in (1000, 5000):
        assert pairs.is_copy(text[:size], answer[: size * 6 // 7])


@given(st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.lcs_length(a, b) == table[-1][-1]


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        (None, []), ("", []), ("一文だけ。", []), ("一。二。", [2]), ("彼は「一。二。」と述べた。次。", [13]), ("本（一。）という。次。", [9]), ("「一。」\n次。", [4]),
        ("値は3.5である。See Fig. 3 and No. 2. 次", [9, 30]), ("Dr. A came e.g. by car. Then", [23]), ("・項目　一\n(2) 二\n終わり", [5, 11]), ("何だ！？そう…。はい。", [4, 8]), ("途中…続く。次", [6]), ("閉じない「文。次。", [7]),
    ],
)
def test_boundaries(text, ends):
    assert splitting.natural_boundaries(text) == ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["文である。", "短い", "、", "\n・項目\n", "長い長い文が続いている。", "x" * 37]), max_size=60).map("".join), st.integers(20, 60), st.integers(0, 9))
def test_pieces(text, size, overlap):
    pieces = splitting.split_text(text, size, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= size for s, e in pieces)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))


def test_look_alikes():
    rewrite = lookalike.Rewriter(lookalike.rewrite_table({"A": 9, "Ａ": 1, "：": 5, ":": 1, "，": 2, "ガ": 3, "4": 2, "-": 3}))
    assert rewrite("Ａ А Α A") == "A A A A"
    assert rewrite("ｶﾞｶ゙が") == "ガガが" and rewrite("ﾊﾟ") == "パ"
    assert rewrite("４－2 x​­⽴:") == "4-2 x立："
    assert rewrite(None) is None and rewrite("") == ""
    assert rewrite("か​゙") == "が"
    assert rewrite("あ　い ，、・") == "あ　い ，、・"
    assert rewrite("е" * 10_000) == "e" * 10_000


def test_look_alikes_of_ascii_texts():
    rewrite = lookalike.Rewriter(lookalike.rewrite_table({"(": 5, "（": 16, ")": 5, "）": 16, "A": 3}))
    assert rewrite("A(1)") == rewrite("A（1)") == rewrite("Ａ（１）") == "A（1）"


VOCAB = encoding.DEFAULT_VOCAB
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")


@needs_vocab
@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab 1' 。、漢あ\n\t　'sé😀.-")), max_size=80))
def test_ids_do_not_depend_on_cuts(text):
    whole = encoding.encoder(VOCAB).encode_ordinary(text)
    assert encoding.encode_text(text, VOCAB, 5) == whole
    assert encoding.decode_ids(whole, VOCAB) == text


@needs_vocab
def test_empty_texts_have_no_ids():
    assert encoding.encode_text(None) == [] and encoding.encode_text("") == []


def test_hyphens_heads_and_numbers():
    assert scan_noise.ends_in_hyphen("the temporary stan-") and scan_noise.ends_in_hyphen("「te-") and scan_noise.ends_in_hyphen("of the au-")
    assert not scan_noise.ends_in_hyphen("番号は847-") and not scan_noise.ends_in_hyphen("型番：KD-") and not scan_noise.ends_in_hyphen("資料bc-")
    assert scan_noise.join_hyphens("the stan-\ndard of KD-\n752") == ("the standard of KD-\n752", True)
    for line in ("- 3 -", "p. 12", "[7]", "第4頁", "3／120"):
        assert scan_noise.is_page_number(line)
    assert not scan_noise.is_page_number("3") and not scan_noise.is_page_number("-14℃")
    title = "青森図書館年報"
    assert scan_noise.is_head("青 森 図 書 館 年 報", title) and scan_noise.is_head("第3章　【青森図書館年報】", title) and scan_noise.is_head("青森図書館年報　巻二", title)
    assert not scan_noise.is_head("青森図書館年報が保管する図面", title) and not scan_noise.is_head("本文", None)
    assert scan_noise.parts("一行目の\n- 3 -\n青森図書館年報\n続き。", title) == ("一行目の\n続き。", True, True)


def test_cut_off_heads():
    title = "白取岡図書館年報"
    for line in ("白取岡図書", "白 取 岡 図 書", "【白取岡図書館】", "図書館年報", "第3章　白取岡図書"):
        assert scan_noise.is_head(line, title)
    assert scan_noise.is_head("霧取沢センサ一取扱説明", "霧取沢センサー取扱説明書")  # ー read as 一
    assert scan_noise.is_head("白取岡", title, least=2) and not scan_noise.is_head("本文の行", title, least=2)
    assert scan_noise.is_head("【第2章】 年 次 報告 3", None, frozenset({scan_noise.head_key("年次報告 12")})) is False
    assert scan_noise.is_head("年 次 報告 4", None, frozenset({scan_noise.head_key("年次報告 3")}))
    assert not scan_noise.is_head("白取岡", title) and not scan_noise.is_head("白取野図書館", title) and not scan_noise.is_head("白取岡図書館の", title)
    judge = misreads.Judge({}, misreads.Lexicon({}, []))
    assert scan_noise.noise_of_paragraph("地区の\n9\n白取岡図書\nロボットを", title, None, judge) == (["running_head", "page_no"], "地区のロボットを")
    assert scan_noise.noise_of_line("白取岡図書", title, None, 185.0, 12.0, "text", judge) == (["running_head"], "")
    assert scan_noise.noise_of_line("白取岡図書", title, None, 185.0, 12.0, "table", judge)[0] == []
    assert scan_noise.noise_of_line("本文の最初の行である。", title, None, 20.0, 10.0, "text", judge) == ([], "本文の最初の行である。")
    assert scan_noise.noise_of_line("館内報", title, frozenset({"館内報"}), 20.0, 10.0, "text", judge) == (["running_head"], "")


LETTERS = [("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("c", "e"), ("rn", "m")]


def test_misread_words():
    wrong = {("m", "倉", "に", "康"): "庫"}
    judge = misreads.Judge(wrong, misreads.Lexicon({"additional": 50, "installation": 50, "temperature": 90}, LETTERS))
    fix = lambda s, e=False: scan_noise.apply_repairs(s, judge.repairs(s, e))
    assert fix("倉康に additi0na1 in5tallation ternperature") == "倉庫に additional installation temperature"
    assert fix("健康に additional") == "健康に additional"
    assert fix("2O21年 1B台 KB1998 35l台") == "2021年 18台 KB1998 351台"
    assert fix("llation", True) == "llation" and fix("1lation", True) == "llation" and fix("ternper", True) == "temper"
    assert scan_noise.noise_of_line("12", None, None, 800.0, 9.0, "table", judge)[0] == [] and scan_noise.noise_of_line("12", None, None, 800.0, 9.0, "text", judge)[0] == ["page_no"]


def test_words_of_any_length_and_many_exchanged_letters():
    long = "electroencephalographicallysounding"
    lexicon = misreads.Lexicon({long: 900, "oscilloscopes": 800, "zebra": 3}, LETTERS)
    assert lexicon.correction(long[:9] + "x" + long[10:], False) == long and lexicon.correction(long.replace("o", "0").replace("l", "1"), False) == long
    assert lexicon.correction("o5c1110scope5", False) == "oscilloscopes"
    assert lexicon.correction("x" * 5000, False) is None


def test_words_are_searched_when_the_cache_is_full():
    judge = misreads.Judge({}, misreads.Lexicon({"inspection": 900, "zebra": 3}, LETTERS))
    judge.correction = misreads.lru_cache(maxsize=1)(judge.lexicon.correction)
    for _ in range(2):
        assert judge.correction("inspcction", False) == "inspection" and judge.correction("inspectiom", False) == "inspection"


def test_plain_errors_in_words():
    lexicon = misreads.Lexicon({"inspection": 900, "valve": 800, "generator": 700, "complete": 3, "procedure": 900, "temperature": 900}, LETTERS)
    for read, printed in (("inspextion", "inspection"), ("insp3ction", "inspection"), ("genertor", "generator"), ("procadure", "procedure"), ("procdure", "procedure"), ("proccedure", "procedure"), ("temparature", "temperature"), ("proeedure", "procedure")):
        assert lexicon.correction(read, False) == printed
    assert lexicon.correction("inspections", False) is None and lexicon.correction("valves", False) is None and lexicon.correction("compléte", False) is None


@given(st.text("abcd1", min_size=3, max_size=9), st.lists(st.text("abcd", min_size=4, max_size=9), min_size=1, max_size=8, unique=True))
def test_index_finds_all_words_within_two_edits(word, names):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    index = misreads.Index({n: 1 for n in names})
    assert {n for n in names if n != word and edits(word, n) <= 2} <= index.near(word)
    assert misreads.distance(word, names[0], {}) == edits(word, names[0])


def test_differences():
    assert misreads.differences("additi0na1", "additional") == [("0", "o"), ("1", "l")] and misreads.differences("modern", "modem") == [("rn", "m")]
    assert misreads.differences("valves", "valve") == [] and misreads.differences("abc", "xyz") == []


def test_sentences_are_linked_anywhere():
    import numpy as np

    source, target = sorted(map(ord, "水門点検費用電池")), sorted(map(ord, "水闸检查费用电池"))
    counts = np.zeros((len(source), len(target)), np.float32)
    for a, b in zip("水門点検費用電池", "水闸检查费用电池"):
        counts[source.index(ord(a)), target.index(ord(b))] = 10
    rows, cols = np.nonzero(counts)
    table = alignment.Table(source, target, {}, alignment.associations((rows, cols, counts[rows, cols]), len(source), len(target)))
    assert alignment.align("水門を点検した。費用は電池AB12345に。", "费用为电池AB12345。检查水闸。", table) == [(1, 2), (2, 1)]
    assert alignment.align("水門を点検した。費用は電池に。", "检查水闸，费用为电池。", table) == [(1, 1), (2, 1)]
    assert alignment.align("", "检查。", table) == [] and alignment.align("水門。", "", table) == []


def test_reading_levels():
    assert not reading_level.is_prose(None) and not reading_level.is_prose(" \n") and not reading_level.is_prose("1.2\t3.4\n5.6\t7.8") and not reading_level.is_prose("品名：ポンプ；型番：AB-1\n品名：水門；型番：AB-2") and not reading_level.is_prose("= = = =")
    assert reading_level.is_prose("The pump is checked every day. It was 3 °C.")
    easy, hard = ["The cat sat on the mat.", "The dog ran to the cat.", "A dog is on the mat."], ["Stress analysis requires the constitutive equation of the material.", "Boundary separation depends on turbulent diffusion of the layer.", "Uncertainty evaluation governs the design margin severely."]
    familiar = reading_level.Familiar({}, {}, {w: 11 for w in "the a cat dog on to is of sat ran mat".split()})
    formula = reading_level.fit_formula([(t, 1) for t in easy] + [(t, 4) for t in hard], familiar)
    grade = lambda t: {k: v[0] for k, v in reading_level.grade_texts([t], familiar, formula).items()}
    assert grade("The cat is on the dog.") == {0: 1} and grade("Material separation governs severely the constitutive evaluation.") == {0: 4}
    assert grade("The cat sat. Material separation governs the evaluation. The dog ran to the cat.") == {0: 1}
    assert grade(None) == {} and grade("") == {} and grade("12345") == {} and grade("猫がいます。犬もいます。") == {}
    assert grade("The dog ran to the cat. " * 40_000) == {0: 1}
    assert reading_level.fit_formula([], familiar) == {} and reading_level.fit_formula([(t, 1) for t in easy], familiar) == {}


def test_terms_of_the_formula():
    import numpy as np

    familiar = reading_level.Familiar({"ja": (np.array(sorted(map(ord, "ねこ")), np.int64), np.array([11, 11]))}, {"ja": (np.array([ord("ね") << 21 | ord("こ")]), np.array([3]))}, {})
    s = reading_level._sentences(["ねこねこと。", "x"])
    (at, x) = reading_level.sentence_terms(s, familiar, np.array([0]))["ja"]
    n = len(reading_level.FAMILIAR_SHARES)
    assert at.tolist() == [0] and np.allclose(x[0, :n], 0.2) and np.allclose(x[0, n : 2 * n], [0.5] * 3 + [1.0] * (n - 3)) and np.isclose(x[0, -1], np.log(5))


def test_defects_do_not_depend_on_length():
    for size in (300, 3000, 6000, 50_000):
        text = ("".join(chr(0x3042 + k * 7 % 80) + chr(0x4E00 + k * 13 % 5000) for k in range(size)))[:size]
        spoilt = "".join(c + "中" * (k % 3 == 2) for k, c in enumerate(text))
        assert pairs.is_copy(text, spoilt)
        assert pairs.classify(text + "。", "抱歉，我无法翻译这段内容。" + "原文涉及的资料缺失较多。" * (size // 12), LABELS, ENDS) == "refusal"
        assert pairs.is_empty("（" + "—" * size + "）") and pairs.classify("図書館" * size, "译文：" + "図書館" * size + "（备注：照录）" * (size // 300), LABELS, ENDS) == "copy"


def test_every_template_passes_its_own_screen():
    for t in pairs.REFUSALS:
        grams = sorted(pairs.shingles(pairs.flat(t), 3 if t.isascii() else 2))
        for drop in range(len(grams)):
            left = grams[:drop] + grams[drop + int(len(grams) * 0.2) :]
            assert pairs._MAY_REFUSE.search("|".join(left))


def test_deep_brackets():
    text = "「" + "（" * 30 + "一。" + "）" * 30 + "」である。次。"
    assert splitting.natural_boundaries(text) == [len(text) - 2]


def test_gap_without_boundaries():
    text = "文である。" * 20 + "x" * 300 + "文である。" * 20
    pieces = splitting.split_text(text, 60, 5)
    weak = [e for _, e in pieces[:-1] if text[e - 1] != "。"]
    assert all(e - s <= 60 for s, e in pieces) and 100 < min(weak) and max(weak) < 400 and len(weak) <= 6
