"""Problem 1: defective prompt and response pairs.

``find_defects`` gives each pair at most one kind of defect, the first that holds of:

- 'empty': nothing, or nothing but marks or a placeholder;
- 'refusal': the response aligns with a refusal template (share of the template's shingles that it contains);
- 'copy': the response contains the prompt's shingles (only those with kana count, or letters foreign to the target
  script, as codes and quoted words are rightly repeated), or aligns with it by longest common subsequence;
- 'wrong_language': most of what the response does not share with the prompt is not Chinese;
- 'truncated': the response breaks off: no sentence end where the prompt has sentences, a dangling mark, fewer fields
  than the form, a last value or code of another shape, an ending at which no field of the corpus ends.

Results for the special cases: rows with a null or blank prompt have no defect; a prompt without kana and Han that is
repeated is sound; very long texts are judged whole; repeated rows are judged each; extra columns are ignored; an empty
table gives no rows. Leaving out, joining or moving whole sentences is no defect.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# What stands for an empty response.
PLACEHOLDERS = frozenset("无 無 空 暂无 暂缺 无内容 无译文 暂无译文 未翻译 待翻译 待译 略 null none nil n/a na nan tbd todo undefined empty".split())
# Cores of refusals in Chinese, English and Japanese.
REFUSALS = (
    "无法翻译这段内容", "无法翻译这一句", "无法翻译该文本", "不能提供该文本的译文", "无法提供译文", "拒绝翻译以上文字", "此内容不便处理", "这个请求我帮不上忙",
    "作为语言模型我没有办法完成这项翻译", "无法完成翻译请求", "不能协助翻译", "无法处理该请求",
    "unable to translate the given text", "can't help with translating this passage", "won't be able to provide a translation", "must decline to process this content",
    "this request cannot be completed", "i cannot translate this", "i'm not able to help with that", "cannot assist with this request",
    "この文章は翻訳できません", "翻訳を提供することができかねます", "ご依頼の内容にはお答えできません", "その処理はお断りいたします", "翻訳することはできません", "お手伝いできません",
)
REFUSAL_SHARE, COPY_SHARE, LCS_SHARE = 0.8, 0.6, 0.85
#: Letters that a label may add to a copied prompt however short it is; a longer prompt may be added to in proportion.
ADDITION = 24
#: Share of all field ends that an ending needs to count as one.
ENDING_SHARE = 1e-5

KANA, HAN = "\\u3041-\\u3096\\u30a1-\\u30fa", "\\u3400-\\u9fff\\uf900-\\ufaff"
_KANA = re.compile(f"[{KANA}]")
_HAN = re.compile(f"[{HAN}]")
_CJK = re.compile(f"[{KANA}{HAN}]")
_NO_SHAPE = re.compile(r"[\s\u00ad\u200b-\u200f\u2028-\u202f\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_MARKS = re.compile(r"[\W_]+")
_LETTER = re.compile(r"[^\W_]")
_QUOTED = re.compile(r"[“「『\"][^”」』\"]*[”」』\"]")
_OTHER = re.compile(r"[\u0370-\u052f\u0590-\u06ff\u0900-\u0e7f\u1100-\u11ff\uac00-\ud7a3]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]+")
_TAIL = "。．！？!?.…"
_CLOSERS = "」』）〕”】》)]’\"'"
_TOKEN = re.compile(r"[0-9A-Za-z][0-9A-Za-z.,\-]*")
_ITEM = re.compile(r"\s*(?:[(][0-9]{1,3}[)]|[0-9]{1,2}|[・•]|-\s)\s*\S")
SEPARATOR = "(?:[：:・…/＝=]|-+|—+)"


def shingles(text: str, n: int = 2) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)} or ({text} if text else set())


def containment(part: set[str], whole: str) -> float:
    """Share of the shingles that occur in ``whole``."""
    return sum(s in whole for s in part) / len(part) if part else 0.0


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the letters of ``a``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def flat(text: str) -> str:
    """Letters and figures alone, compatibility forms folded, lower case."""
    return _MARKS.sub("", unicodedata.normalize("NFKC", text)).lower()


_TEMPLATES = [(flat(t), shingles(flat(t), 3 if t.isascii() else 2)) for t in REFUSALS]
_REACH = max(60 + 4 * len(t) for t, _ in _TEMPLATES)


def _needed(grams: set[str], seen: Counter[str]) -> set[str]:
    """Shingles of which an answer that contains ``REFUSAL_SHARE`` of all must hold one; those of fewest templates."""
    missing = int(len(grams) * (1 - REFUSAL_SHARE) + 1e-9)
    return set(sorted(grams, key=lambda g: (seen[g], g))[: missing + 1])


_SEEN = Counter(g for _, grams in _TEMPLATES for g in grams)
_MAY_REFUSE = re.compile("|".join(sorted(map(re.escape, set().union(*(_needed(grams, _SEEN) for _, grams in _TEMPLATES))))))


def is_empty(answer: str | None) -> bool:
    if not answer:
        return True
    bare = _NO_SHAPE.sub("", answer)
    if not bare:
        return True
    word = bare.strip("()（）[]【】「」『』\"'“”<>〈〉-—–_.…。·*").lower()
    return word in PLACEHOLDERS or not _LETTER.search(word)


def is_refusal(answer: str) -> bool:
    """Whether a template stands near the start or the end of the answer, however long the rest is."""
    bare = flat(_QUOTED.sub("", answer))
    ends = {bare[:_REACH], bare[-_REACH:]}
    if not any(_MAY_REFUSE.search(end) for end in ends):  # no template can be contained
        return False
    for template, grams in _TEMPLATES:
        most = 60 + 4 * len(template)
        if any(containment(grams, end) >= REFUSAL_SHARE for end in {bare[:most], bare[-most:]}):
            return True
    return False


def is_copy(prompt: str, answer: str) -> bool:
    if _KANA.search(prompt):
        if not _KANA.search(answer):
            return False
        source, given = flat(prompt), flat(answer)
        cjk = "".join(_CJK.findall(source))
        grams = {g for g in shingles(cjk, 3) if _KANA.search(g)} or {g for g in shingles(cjk) if _KANA.search(g)}
        share = containment(grams, "".join(_CJK.findall(given)))
        if share >= COPY_SHARE:
            return True
        return share >= COPY_SHARE / 2 and lcs_length(source, given) >= LCS_SHARE * len(source)
    if not _HAN.search(prompt):
        return False
    source, given = flat(prompt), flat(answer)
    if source not in given or len(given) - len(source) > max(ADDITION, (1 - COPY_SHARE) / COPY_SHARE * len(source)):
        return False
    try:
        "".join(_HAN.findall(prompt)).encode("gb2312")
    except UnicodeEncodeError:
        return True  # characters that simplified Chinese does not use
    return False


def is_wrong_language(prompt: str, answer: str) -> bool:
    han, kana = len(_HAN.findall(answer)), len(_KANA.findall(answer))
    if kana and kana >= 0.25 * (han + kana):
        return True
    other = len(_OTHER.findall(answer))
    own = {w.lower() for w in _LATIN.findall(prompt)}
    joined = "".join(_LATIN.findall(prompt)).lower()
    latin = sum(1 for w in _LATIN.findall(answer) if w.lower() not in own and w.lower() not in joined)
    foreign = max(other / 2, 0) + 1.5 * latin
    return foreign > 3 and foreign > han


def shape(token: str) -> str:
    return re.sub(r"[0-9]", "9", token.lower()).replace("-", "").replace(",", "").rstrip(".")


def fields_of(prompt: str, label_pattern: re.Pattern[str] | None) -> int:
    return len(label_pattern.findall(re.sub(r"\s", "", prompt))) if label_pattern else 0


def is_truncated(prompt: str, answer: str, label_pattern: re.Pattern[str] | None, endings: frozenset[str]) -> bool:
    a, s = answer.strip(" \t\r\n　​"), unicodedata.normalize("NFKC", prompt).strip()
    if not a or not _CJK.search(prompt):
        return False
    core = a.rstrip(_CLOSERS + " ")
    if core.endswith(("…", "...", "，", "、", "：", "；", "—", "-")):
        return not s.rstrip(_CLOSERS).endswith(("…", "..."))
    if core and (core[-1] in "。！？!?" or re.search(r"(?:[a-z]{3}|[0-9])[.]$", core) and s.endswith(".")):
        return False
    last_line = s.rsplit("\n", 1)[-1]
    if "\n" in s and _ITEM.match(last_line) and not last_line.endswith("。"):
        figures = re.findall(r"[0-9][0-9.,]*", last_line)
        given = re.findall(r"[0-9][0-9.,]*", unicodedata.normalize("NFKC", a).rsplit("\n", 1)[-1])
        return bool(figures) and (not given or len(given[-1]) < len(figures[-1]) and figures[-1].startswith(given[-1]))
    n_fields = fields_of(s, label_pattern)
    if n_fields >= 2:
        given = [f for f in re.split("[；;\n]", a) if f.strip()]
        if len(given) < n_fields:
            return True
        last = re.split("[：:]", given[-1], maxsplit=1)
        if len(last) < 2 or not last[1].strip():
            return True
        value = unicodedata.normalize("NFKC", last[1]).strip()
        return _bad_end(value, s, endings)
    if "。" in prompt or "．" in prompt or _KANA.match(s[-1:]) and s[-1:] in "たるいすくうむつぬぐぶん":
        if core != a and a[-1] in _CLOSERS and _balanced(a):
            return False
        return True
    if prompt.rstrip()[-1:] in _CLOSERS and a[-1] not in _CLOSERS:
        return True
    return _bad_end(unicodedata.normalize("NFKC", core), s.rstrip(_CLOSERS), endings, True)


def _balanced(text: str) -> bool:
    return all(text.count(a) <= text.count(b) for a, b in ("（）", "“”", "「」", "《》", "()"))


def _tail_code(text: str) -> str:
    """Letters and figures at the end of the text, without the marks between them."""
    return re.search(f"[^{KANA}{HAN}ー]*$", text).group() and "".join(c for c in re.search(f"[^{KANA}{HAN}ー]*$", text).group() if c.isalnum())


def _bad_end(value: str, prompt: str, endings: frozenset[str], heading: bool = False) -> bool:
    """Whether a last value or heading ends where none does."""
    if heading and (code := _tail_code(prompt)):
        return len(_tail_code(value)) != len(code)
    tokens = _TOKEN.findall(re.sub(r"(?<=[0-9A-Za-z\-])\s+(?=[0-9A-Za-z\-])", "", prompt))
    shapes = {shape(t) for t in tokens}
    m = re.search(r"[0-9A-Za-z][0-9A-Za-z.,\-]*$", value)
    if m:
        return shape(m.group()) not in shapes and not any(x.endswith(shape(m.group())) for x in shapes)
    if heading:
        return len(value) < 0.4 * len(prompt)  # nothing to compare the end with
    return len(value) >= 2 and value[-2:] not in endings and value[-1:] not in endings


def classify(prompt: str | None, answer: str | None, label_pattern: re.Pattern[str] | None, endings: frozenset[str]) -> str | None:
    """The defect of a pair, or None."""
    if prompt is None or not _NO_SHAPE.sub("", prompt):
        return None
    if is_empty(answer):
        return None if answer and flat(prompt) == flat(answer) and flat(prompt) else "empty"
    if not _CJK.search(prompt):
        if flat(prompt) == flat(answer):
            return None
        if is_refusal(answer):
            return "refusal"
        return "wrong_language" if is_wrong_language(prompt, answer) else None
    if is_refusal(answer):
        return "refusal"
    if is_copy(prompt, answer):
        return "copy"
    if is_wrong_language(prompt, answer):
        return "wrong_language"
    return "truncated" if is_truncated(prompt, answer, label_pattern, endings) else None


def learn_endings(pairs: DataFrame, answer_col: str = "answer", share: float = ENDING_SHARE) -> frozenset[str]:
    """Last characters (one and two) of fields that are not the last of their form, by corpus share; at most 1 / share."""
    fields = F.split(F.col(answer_col), "[；;]")
    whole = pairs.where(F.col(answer_col).contains("；")).select(F.explode(F.slice(fields, 1, F.size(fields) - 1)).alias("f")).where(F.length("f") > 1)
    ends = cut(whole.select(F.substring("f", -2, 2).alias("e")).groupBy("e").count())
    total = ends.agg(F.sum("count")).first()[0] or 0
    return frozenset(r.e for r in ends.where(F.col("count") >= max(1, total * share)).select("e").collect())


class DefectModel:
    """What ``classify`` needs to know of the corpus: field labels and field endings."""

    def __init__(self, labels: list[str], endings: frozenset[str]):
        self.labels, self.endings = labels, endings
        self.pattern = re.compile(f"(?:{'|'.join(map(re.escape, labels))}){SEPARATOR}") if labels else None

    def defect(self, prompt: str | None, answer: str | None) -> str | None:
        return classify(prompt, answer, self.pattern, self.endings)


def find_defects(pairs: DataFrame, model: DefectModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``defect`` of the defective rows of ``pairs`` (columns prompt and answer). Map-side only."""
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.defect(p, a) for p, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            at = pa.array([i for i, d in enumerate(found) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(2, batch.num_columns)), pa.array([d for d in found if d], pa.string())], [*keep, "defect"])

    return pairs.select("prompt", "answer", *keep).mapInArrow(run, f"{schema}, defect string")
