"""Quality rules from tokenizer fertility: how well public vocabularies fit a text.

Per text and vocabulary: characters per token, token entropy, and the share of byte-fallback tokens. A text whose measures
fall outside the band of its language and script is rejected: shouting, symbols, broken encodings, other languages under a wrong
label and endless repetition all cost more, or more uniform, tokens than prose does.

A band reaches ``FENCE`` interquartile ranges beyond the quartiles of the distinct texts of a language and script. A mean over
few tokens varies more, so the reach grows as sqrt(1 + SHORT / tokens); a range counts as at least ``NARROW`` of the median, so
that a group of much the same texts does not reject all others. Groups with fewer than ``LEAST_TEXTS`` distinct texts take
the band of their script over all languages; where that has too few as well, nothing is rejected.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, byte_column, column_of, grams, text_slices, words_of
from tidemark.llm.vocabularies import byte_vocabulary, piece_vocabulary
from tidemark.session import pin

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FENCE, SHORT, NARROW, LEAST_TEXTS = 2.5, 512, 0.01, 20
CELLS = 1024  # measures are compared in cells of 1/1024
#: measure -> which side of the band rejects: both, only above, only below
SIDES = {"piece_fertility": 0, "byte_fertility": 0, "fallback_share": 1, "piece_entropy": -1, "byte_entropy": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# First and last code point of the letters of a script.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF),
           ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF))
NO_SCRIPT = "none"


@lru_cache(maxsize=1)
def _script_table() -> tuple[np.ndarray, list[str]]:
    names = [NO_SCRIPT, *dict.fromkeys(s for s, _, _ in SCRIPTS)]
    table = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        table[a : b + 1] = names.index(name)
    table[:0x80][[not chr(c).isalpha() for c in range(0x80)]] = 0
    return table, names


def script_of(text: str) -> str:
    """The script of most letters of a text, the first listed of equals; a kana text with han is kana, as Japanese is written."""
    table, names = _script_table()
    counts = np.bincount(table[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=len(names))
    kana, han = names.index("kana"), names.index("han")
    if counts[kana] * 8 > counts[han]:
        counts[kana] += counts[han]
        counts[han] = 0
    counts[0] = 0
    return names[int(counts.argmax())] if counts.any() else NO_SCRIPT


def entropy(ids: np.ndarray) -> float:
    """Entropy of the ids against that of as many different ones: 0 for one id repeated, 1 where none repeats; 1 for one id."""
    if len(ids) < 2:
        return 1.0
    times = np.sort(np.unique(ids, return_counts=True)[1])  # in order, so that the sum does not depend on the ids
    share = times / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def base_counts(column: pa.Array, texts: list[str]) -> dict[str, np.ndarray]:
    """The rule counts of all rows of a slice."""
    raw, offsets = byte_column(column)
    words = words_of(column)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    symbol = np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))
    window, whole = grams(words, 3)
    at = np.flatnonzero(whole)
    order = at[np.lexsort((window[at], words.row[at]))]
    same = (window[order[1:]] == window[order[:-1]]) & (words.row[order[1:]] == words.row[order[:-1]])
    covered = np.zeros(len(words.hash) + 2, bool)
    for first in (order[1:][same], order[:-1][same]):
        for k in range(3):
            covered[first + k] = True
    repeat = np.concatenate([[0], np.cumsum(covered)])
    dup = [(lambda lines: len(lines) - len(set(lines)))([x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]) for t in texts]
    return {"n_words": np.diff(words.first), "word_chars": per_row(~blank & (raw & 0xC0 != 0x80)), "n_symbols": per_row(symbol),
            "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeat[words.first[1:]] - repeat[words.first[:-1]]}


def measured(docs: DataFrame, piece_path: str, byte_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, lang, script, text hash, the rule counts, tokens by both vocabularies and the measures (0 without tokens)."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), lang.alias("_lang"),
                       F.xxhash64(text_col).alias("_hash"))

    def measure(batches):
        piece, byte = piece_vocabulary(piece_path), byte_vocabulary(byte_path)
        for part in text_slices(batches, "_text"):
            column = column_of(part, "_text")
            texts = column.to_pylist()
            base = base_counts(column, texts)
            pieces = [np.array(x, np.int64) for x in piece.encode(texts, num_threads=1)]
            merged = [np.array(byte.encode(t), np.int64) for t in texts]
            n_piece, n_byte = (np.array([len(x) for x in xs], np.int64) for xs in (pieces, merged))
            values = {
                "piece_fertility": base["word_chars"] / np.maximum(n_piece, 1), "byte_fertility": base["word_chars"] / np.maximum(n_byte, 1),
                "fallback_share": np.array([piece.is_byte[x].sum() for x in pieces]) / np.maximum(n_piece, 1),
                "piece_entropy": np.array([entropy(x) for x in pieces]), "byte_entropy": np.array([entropy(x) for x in merged])}
            yield pa.RecordBatch.from_arrays(
                [column_of(part, "_id"), column_of(part, "_lang"), column_of(part, "_hash"), pa.array([script_of(t) for t in texts]),
                 *[pa.array(base[c].astype(np.int64)) for c in BASE], pa.array(n_piece), pa.array(n_byte),
                 *[pa.array(values[c].astype(np.float64)) for c in SIDES]],
                ["_id", "_lang", "_hash", "_script", *BASE, "n_pieces", "n_bytes_merged", *SIDES])

    longs = ", ".join(f"{c} long" for c in (*BASE, "n_pieces", "n_bytes_merged"))
    return rows.mapInArrow(measure, f"_id {kind}, _lang string, _hash long, _script string, {longs}, {', '.join(f'{c} double' for c in SIDES)}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def quartiles(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of distinct texts: ``texts`` and a struct (q1, q2, q3) per measure, exact to a cell.

    Texts are counted per cell before they are ordered, so a group's running count has at most one row per cell.
    """
    texts = measures.groupBy(*keys, "_hash").agg(*[F.first(c).alias(c) for c in SIDES])  # equal texts measure alike
    cells = texts.select(*keys, F.explode(F.create_map(*[x for c in SIDES for x in (F.lit(c), F.floor(F.col(c) * CELLS))])).alias("measure", "cell"))
    cells = cells.groupBy(*keys, "measure", "cell").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("cell"))
    placed = cells.select(*keys, "measure", "cell", upto.alias("upto"), F.sum("n").over(group).alias("texts"))
    q = placed.groupBy(*keys, "measure").agg(
        F.first("texts").alias("texts"),
        *[(F.min(F.when(F.col("upto") * 4 >= F.col("texts") * k, F.col("cell"))) / CELLS).alias(f"q{k}") for k in (1, 2, 3)])
    one = lambda c: F.max(F.when(F.col("measure") == c, F.struct("q1", "q2", "q3"))).alias(f"_{c}")
    return q.groupBy(*keys).agg(F.first("texts").alias("texts"), *[one(c) for c in SIDES])


def bands(measures: DataFrame) -> DataFrame:
    """Quartiles per (_lang, _script), and with a null ``_lang`` and ``any`` true per _script over all languages."""
    sound = measures.where(~base_failed())
    own = quartiles(sound, ["_lang", "_script"]).withColumn("any", F.lit(False))
    script = quartiles(sound, ["_script"]).withColumn("any", F.lit(True)).withColumn("_lang", F.lit(None).cast("string"))
    return own.unionByName(script).where(F.col("texts") >= LEAST_TEXTS)


def _outside(measure: str, band: Column, tokens: Column) -> Column:
    reach = FENCE * F.greatest(band["q3"] - band["q1"], F.lit(NARROW) * band["q2"], F.lit(1 / CELLS)) * F.sqrt(1 + SHORT / F.greatest(tokens, F.lit(1)))
    x, side = F.floor(F.col(measure) * CELLS) / CELLS, SIDES[measure]
    low, high = x < band["q1"] - reach, x > band["q3"] + reach
    return low | high if side == 0 else high if side > 0 else low


def quality(docs: DataFrame, piece_path: str, byte_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: id, the rule counts, base_failed, kept, the measures, and ``rejected_by``, the measures out of band.

    A null or empty text has zero words and fails the base rules. Repeated rows and null ids are judged row by row, and
    copies of a text count once in the bands. A null language is a language of its own. Texts of any length are measured whole.
    Other columns are not read. An empty table gives an empty result.
    """
    found = pin(measured(docs, piece_path, byte_path, id_col, text_col, lang_col), "fertility")
    told = pin(bands(found), "bands")
    own = told.where(~F.col("any")).select(F.col("_lang").alias("_l"), F.col("_script").alias("_s"), *[F.col(f"_{c}").alias(f"own_{c}") for c in SIDES])
    script = told.where("any").select(F.col("_script").alias("_t"), *[F.col(f"_{c}").alias(f"script_{c}") for c in SIDES])
    out = found.join(own, F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("_script") == F.col("_s")), "left").join(script, F.col("_script") == F.col("_t"), "left")
    tokens = {c: F.col("n_pieces" if c in ("piece_fertility", "fallback_share", "piece_entropy") else "n_bytes_merged") for c in SIDES}
    tests = [F.when(F.coalesce(_outside(c, F.coalesce(F.col(f"own_{c}"), F.col(f"script_{c}")), tokens[c]), F.lit(False)), F.lit(c)) for c in SIDES]
    out = out.withColumn("rejected_by", F.array_compact(F.array(*tests))).withColumn("base_failed", base_failed())
    return out.select(F.col("_id").alias(id_col), *BASE, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), *SIDES, "rejected_by")
