"""Problem 7: token ids of every text by a public byte-level BPE.

``encode_corpus`` turns each text into the ids of a tiktoken vocabulary read from a local rank file.
Results for the special cases: a null or empty text gives the empty list; every other text, however long, is
encoded whole. Repeated rows are encoded each, extra columns of the input are ignored, an empty table gives an
empty table. Long texts are cut before encoding, but only where the vocabulary's pre-tokenizer must cut too
(``safe_cuts``), so the ids equal those of the whole text. ``decode_corpus`` joins the raw bytes of the ids before
decoding, so characters that are spread over several ids come back intact.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer pattern of the byte-level vocabularies (fixed value of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many code points are cut at safe places before encoding.
CHUNK = 20_000


@lru_cache(maxsize=4)
def encoder(vocab: str):
    """The vocabulary, loaded once per Python worker."""
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(ch: str) -> str:
    if ch.isspace():
        return "Z"
    first = unicodedata.category(ch)[0]
    return first if first in "LN" else "P"


def safe_cuts(text: str, chunk: int = CHUNK) -> list[int]:
    """Cut places that the pre-tokenizer respects, about ``chunk`` apart.

    A place is safe before white space that follows a visible character, and between two visible characters of
    different kind (letter, number, other) unless the first is an apostrophe, which may open a contraction.
    A stretch without such a place stays whole.
    """
    cuts, start, n = [], 0, len(text)
    while n - start > chunk:
        at = start + chunk
        while at < n:
            a, b = text[at - 1], text[at]
            ka, kb = _kind(a), _kind(b)
            if ka != "Z" and ka != kb and a != "'":
                break
            at += 1
        if at >= n:
            break
        cuts.append(at)
        start = at
    return cuts


def encode_text(text: str | None, vocab: str = DEFAULT_VOCAB, chunk: int = CHUNK) -> list[int]:
    if not text:
        return []
    enc = encoder(vocab)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    edges = [0, *safe_cuts(text, chunk), len(text)]
    ids: list[int] = []
    for a, b in zip(edges, edges[1:]):
        ids += enc.encode_ordinary(text[a:b])
    return ids


def decode_ids(ids: list[int], vocab: str = DEFAULT_VOCAB) -> str:
    enc = encoder(vocab)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, chunk: int = CHUNK) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row. Map-side only: no shuffle, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [encode_text(t, vocab, chunk) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, chunk: int = CHUNK) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(encode_text(t, vocab, chunk)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """The inverse of ``encode_corpus``: raw bytes are joined first. Null ids give a null text, no ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, vocab) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
