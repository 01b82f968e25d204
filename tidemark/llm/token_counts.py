"""Token counts of texts of any length by overlap resynchronisation.

A text longer than ``chunk`` bytes is encoded in overlapping chunks, each token with its place in
the text. Two neighbours are spliced where both have a token boundary in their overlap that is proven
stable: no piece of the vocabulary holds a space mark after another character, so the encoder never
merges across the place where a run of spaces begins after an ASCII character, whatever follows. Where an
overlap holds no such place, it is widened, in the end to the rest of the text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, byte_column, column_of, text_slices

CHUNK, OVERLAP = 1 << 15, 1 << 9
MARK = "▁"  # how pieces spell a space


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sp, not any(MARK in p.lstrip(MARK) for p in pieces)


def _cut(raw: bytes, at: int) -> int:
    """The first byte of the character at ``at``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _chunk(sp, raw: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """First bytes in ``raw`` of the tokens of raw[a:b], and which of these places are stable boundaries."""
    pieces = sp.encode(raw[a:b].decode("utf-8"), return_type="proto").pieces
    begin = np.array([p.begin for p in pieces], np.int64) + a
    stable = np.array([i > a and raw[i] == 32 and raw[i - 1] < 128 and raw[i - 1] != 32 for i in begin.tolist()], bool)
    stable[1:] &= begin[1:] > begin[:-1]
    return begin, stable


def chunked_count(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text; the same number as encoding it whole. ``chunk`` and ``overlap`` are bytes."""
    sp, provable = _model(path)
    raw = text.encode("utf-8")
    if len(raw) <= chunk or not provable:
        return len(sp.encode(text))
    total, done, a, b = 0, 0, 0, _cut(raw, chunk)  # done: tokens of the left chunk that are counted
    begin, stable = _chunk(sp, raw, a, b)
    while b < len(raw):
        width = overlap
        while True:
            start = _cut(raw, max(a, b - width))
            end = _cut(raw, min(len(raw), start + max(chunk, 2 * width)))
            after, after_stable = _chunk(sp, raw, start, end)
            common = np.intersect1d(begin[stable], after[after_stable])
            if len(common) or start <= a:
                break
            width *= 2
        if len(common):
            at = common[-1]
            total += int(np.searchsorted(begin, at)) - done
            a, b, begin, stable, done = start, end, after, after_stable, int(np.searchsorted(after, at))
        else:  # no stable place back to the left chunk's start: make one chunk of both
            place = begin[done] if done else None
            b = _cut(raw, min(len(raw), b + max(chunk, b - a)))
            begin, stable = _chunk(sp, raw, a, b)
            done = int(np.searchsorted(begin, place)) if place is not None else 0
    return total + len(begin) - done


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens, over_limit. One pass, no shuffle.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are answered row by row;
    other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def count(batches):
        for part in text_slices(batches, "_text"):
            column = column_of(part, "_text")
            _, offsets = byte_column(column)
            texts = column.to_pylist()
            size = np.diff(offsets)
            sp, _ = _model(tokenizer)
            counts = iter([len(x) for x in sp.encode([t for t, b in zip(texts, size) if b <= chunk], num_threads=1)])
            n = [next(counts) if b <= chunk else chunked_count(tokenizer, t, chunk, overlap) for t, b in zip(texts, size)]
            yield pa.RecordBatch.from_arrays([column_of(part, "_id"), pa.array(size), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = rows.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
