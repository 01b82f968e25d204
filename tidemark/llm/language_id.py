"""Language identification by cross-parsing against suffix automata of labelled text.

For each language a suffix automaton of a bounded sample of labelled text answers, symbol by symbol,
whether the current phrase still occurs in the sample. A text is cut into the longest phrases that
occur; the language in which the phrases cost the fewest bits wins. A phrase costs what it takes to name a place of
the language's own sample or a symbol by itself, so samples of different lengths compare. The automata become one dense table of
transitions in which a failed step leads to the next phrase's first state, so all lanes of a slice
advance together through one numpy gather per symbol.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, byte_column, column_of, text_slices

SAMPLE_CHARS = 24_000  # symbols of labelled text per language, at most
SAMPLE_DOCS, SAMPLE_DOC_CHARS = 160, 600  # documents per language and characters of each that may serve
SYMBOLS = 48
LANE = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Lower-case letters as code points; 0 for everything else."""
    out = _letters()[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]).tolist():
        low = chr(p).lower()
        out[points == p] = (ord(low) if len(low) == 1 else p) if chr(p).isalpha() else 0
    return out


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``text``; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = twin
                    p = link[p]
        last = new
    return goto


class CrossParser:
    """Automata of all languages as one table: entry = 2 x next state + (1 if a phrase begins)."""

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS, symbols: int = SYMBOLS):
        streams = {}
        for lang, texts in sorted(samples.items()):
            points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            s = symbols_of(points)
            keep = (s != 0) | (np.concatenate([[1], s[:-1]]) != 0)
            s = s[keep]
            if (s != 0).any():
                streams[lang] = s[:sample_chars]
        self.languages = list(streams)
        points, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *streams.values()]), return_counts=True)
        known = points[points != 0][np.argsort(-counts[points != 0], kind="stable")][: symbols - 2]
        # Class 0 is what is no letter, class 1 a letter that the samples hardly show.
        self.known, self.width = np.sort(known), len(known) + 2
        # A phrase is a place of the sample or one symbol; a short sample has cheap places and short phrases.
        self.bits = np.log2(np.array([len(v) + self.width for v in streams.values()], np.float64))
        tables, base = [], 0
        self.roots = []
        for s in streams.values():
            goto = suffix_automaton(self.classes(s).tolist())
            step = np.full((len(goto), self.width), -1, np.int64)
            for state, edges in enumerate(goto):
                step[state, list(edges)] = list(edges.values())
            first = np.where(step[0] < 0, 0, step[0])  # an unknown symbol is a phrase of its own
            tables.append(np.where(step < 0, (first + base) * 2 + 1, (step + base) * 2))
            tables[-1][0] = (first + base) * 2 + 1
            self.roots.append(base)
            base += len(goto)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, symbols)
        hit = self.known[np.minimum(at, len(self.known) - 1)] == symbols if len(self.known) else np.zeros(len(symbols), bool)
        return np.where(symbols == 0, 0, np.where(hit, at + 2, 1)).astype(np.uint8)

    def phrases(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases per row and language; a row's symbols are classes[first[i]:first[i+1]], cut into lanes of LANE."""
        rows = len(first) - 1
        size = np.diff(first)
        lanes = -(-size // LANE)
        row = np.repeat(np.arange(rows), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = first[row] + nth * LANE
        length = np.minimum(LANE, first[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        live = np.searchsorted(-length, -np.arange(LANE), side="left")  # lanes longer than t
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(row), 1)
        count = np.zeros((len(self.roots), len(row)), np.int32)
        for t in range(LANE):
            n = int(live[t])
            if not n:
                break
            c = classes[start[:n] + t]
            for k in range(len(self.roots)):
                step = self.table[state[k, :n] * self.width + c]
                count[k, :n] += step & 1
                state[k, :n] = step >> 1
        out = np.zeros((rows, len(self.roots)), np.int64)
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(row, count[k], rows)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, offsets = byte_column(column)
        begins = (raw & 0xC0) != 0x80
        places = np.concatenate([[0], np.cumsum(begins)])
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        s = symbols_of(points)
        char = places[offsets]
        letters = np.concatenate([[0], np.cumsum(s != 0)])
        has = letters[char[1:]] > letters[char[:-1]]
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        first = kept[char]
        if not self.languages:
            return [UNKNOWN] * len(has), np.zeros(len(has))
        counts = self.phrases(self.classes(s[keep]), first)
        cost = counts * self.bits
        best = cost.argmin(1)
        gap = cost - cost.min(1, keepdims=True)
        score = 1.0 / np.exp2(-gap).sum(1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], np.where(has, score, 0.0)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
        doc_chars: int = SAMPLE_DOC_CHARS, sample_chars: int = SAMPLE_CHARS) -> CrossParser:
    """Automata of a bounded sample: of each language the ``sample_docs`` texts with the smallest hash.

    A hash threshold from the number of the language's distinct texts leaves about four times as many of them before they
    are ranked, so a language with a third of all rows is not ordered as a whole. Copies of a text count once. Rows without text or
    label do not serve. At most sample_docs x doc_chars characters per language reach the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, doc_chars).alias("text"), F.pmod(F.xxhash64(text_col), F.lit(1 << 30)).alias("h"))
    sizes = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = rows.join(F.broadcast(sizes), "lang").where(F.col("h") * F.col("n") <= F.lit(4.0 * sample_docs * (1 << 30)))
    few = few.groupBy("lang", "h", "text").agg(F.lit(1).alias("one"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= sample_docs)
    samples: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "r").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return CrossParser(samples, sample_chars)


def identify(docs: DataFrame, model: CrossParser, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, both new columns; one pass, no shuffle.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when no language was
    learned. Of equally good languages the first by code point wins. Score is the winner's share when
    each phrase costs log2(symbols of the language's sample + kinds of symbols) bits. Repeated rows get equal answers; all columns are kept, and a column named
    like a result is replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def predict(batches):
        parser = shared.value
        for part in text_slices(batches, "_text"):
            langs, scores = parser.predict(column_of(part, "_text"))
            kept = pa.RecordBatch.from_arrays([column_of(part, f"_c{i}") for i in range(len(names))] + [pa.array(langs), pa.array(scores)],
                                              [*names, "lang_pred", "score"])
            yield kept

    given = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(predict, schema)
