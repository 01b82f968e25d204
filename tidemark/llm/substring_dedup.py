"""Removal of passages that occur earlier in the corpus, by suffix automata of reference shards.

A window is ``window`` consecutive words; a word goes when a window over it also starts earlier. The
reference of a passage is every earlier text, which no task can hold, so it is cut into shards by content: every
window has a minimizer, the least hash of its six-word grams, and equal windows have equal minimizers.
Windows in a row with one minimizer form a segment; the segments of one minimizer are a shard. In document order
each segment is streamed through the suffix automaton of the segments before it; where the
matching statistic reaches the window's length, the window occurs earlier. Then the segment joins the automaton.

Instead of a broadcast of all automata, which would grow with the corpus, a shard's automaton lives in the
task that streams the shard. Minimizers that occur once cannot repeat; most are dropped by a bit filter of
bounded size. A shard of more than ``hot`` segments would grow in one task; its windows
are compared as rows instead, first occurrences being gathered by partial aggregation.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import MAX_BITS, MIN_BITS, collect_plane, in_plane, plane_of, repeated_bits, rows_in_plane
from tidemark.llm.textwords import bounded_batches, column_of, grams, text_slices, words_of
from tidemark.session import pin

WINDOW, GRAM, HOT = 20, 6, 256
PIECE = 1 << 22  # words whose windows are compared at once
_PLACE = np.uint64((1 << 23) - 1)


class Automaton:
    """Suffix automaton of word sequences, extended one sequence at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def _add(self, c) -> None:
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                self.link[q] = self.link[new] = twin
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
        self.last = new

    def add(self, words: list) -> None:
        for c in words:
            self._add(c)
        self._add(len(self.next))  # a number is no word: nothing matches across sequences

    def matches(self, words: list, least: int) -> list[int]:
        """First word of every run of ``least`` words that occurs in the automaton."""
        state = length = 0
        found = []
        for i, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
                if length >= least:
                    found.append(i - least + 1)
        return found


def _segments(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word in the row, number of windows and minimizer of every segment."""
    w = words_of(texts)
    g, _ = grams(w, gram)
    width = window - gram + 1
    m = len(g) - width + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    least = np.empty(m, np.int64)  # place of the leftmost least gram of each window; compared by the upper 41 bits
    for a in range(0, m, PIECE):
        part = g[a : a + PIECE + width - 1]
        low, span = part & ~_PLACE | np.arange(len(part), dtype=np.uint64), 1
        while span * 2 <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        least[a : a + PIECE] = (low & _PLACE).astype(np.int64) + a
    row = w.row[:m]
    inside = np.arange(m) + window <= w.first[row + 1]
    at, row, low = np.flatnonzero(inside), row[inside], least[inside]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.concatenate([cut, [len(low)]]))
    return row[cut], at[cut] - w.first[row[cut]], n, g[low[cut]].view(np.int64)


def _order(*more: str) -> Column:
    """Document order: by id, null ids last, then by text, then by what ``more`` names."""
    return F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("key").alias("k"), *more)


def repeated_windows(rows: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(key, _id, start) of the windows of ``rows(_id, key, _text)`` that start earlier elsewhere.

    Every text comes from one document, or from rows that repeat its id.
    """
    spark = rows.sparkSession

    def minimizers(batches):
        for part in text_slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array(_segments(column_of(part, "_text"), window, gram)[3])], ["h"])

    hashes = rows.select("_text").mapInArrow(minimizers, "h long")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    # About one segment per 48 bytes of text, 16 bits each.
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (max(1, size // 3) - 1).bit_length()))
    shared = spark.sparkContext.broadcast(collect_plane(repeated_bits(hashes, bits), bits))
    kind = dict(rows.dtypes)["_id"]

    def maybe_repeated(batches):
        for part in text_slices(batches, "_text"):
            row, start, n, h = _segments(column_of(part, "_text"), window, gram)
            keep = in_plane(shared.value, h, bits)
            row, start, n, h = row[keep], start[keep], n[keep], h[keep]
            pieces, texts, last, words = [], column_of(part, "_text"), -1, []
            for r, a, k in zip(row.tolist(), start.tolist(), n.tolist()):
                if r != last:
                    last, words = r, texts[r].as_py().encode().split()
                pieces.append(b" ".join(words[a : a + k + window - 1]))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([column_of(part, "_id").take(row), column_of(part, "key").take(row), pa.array(start.astype(np.int32)),
                                              pa.array(h), pa.array(pieces, pa.binary())], ["_id", "key", "start", "h", "words"])

    segments = pin(rows.mapInArrow(maybe_repeated, f"_id {kind}, key binary, start int, h long, words binary"), "segments")
    large = pin(segments.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("h"), "large")

    def windows(batches):
        for batch in batches:
            at, starts, texts = [], [], []
            for i, (start, raw) in enumerate(zip(column_of(batch, "start").to_pylist(), column_of(batch, "words").to_pylist())):
                words = raw.split(b" ")
                for k in range(len(words) - window + 1):
                    at.append(i)
                    starts.append(start + k)
                    texts.append(b" ".join(words[k : k + window]))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(batch, "_id").take(at), column_of(batch, "key").take(at), pa.array(starts, pa.int32()), pa.array(texts, pa.binary())],
                                             ["_id", "key", "start", "words"])

    def stream(batches):
        shard, seen, first, automaton, last = None, set(), None, None, None
        for batch in batches:
            at, starts = [], []
            for i, (h, z, key, start, raw) in enumerate(zip(*(column_of(batch, c).to_pylist() for c in ("h", "_id", "key", "start", "words")))):
                if h != shard:
                    shard, seen, first, automaton, last = h, set(), None, None, None
                if (z, key, start) == last:  # a row of the table that repeats id and text
                    continue
                last = (z, key, start)
                words = raw.split(b" ")
                if raw in seen:
                    hits = range(len(words) - window + 1)
                else:
                    seen.add(raw)
                    if first is None:  # an automaton is built when a second text asks for it
                        first, hits = words, ()
                    else:
                        if automaton is None:
                            automaton = Automaton()
                            automaton.add(first)
                        hits = automaton.matches(words, window)
                        automaton.add(words)
                at += [i] * len(hits)
                starts += [start + k for k in hits]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(batch, "key").take(at), column_of(batch, "_id").take(at), pa.array(starts, pa.int32())], ["key", "_id", "start"])

    # Shards of one segment yield nothing, and need no filter of their own.
    cold = segments.join(large, "h", "left_anti").withColumn("z", F.col("_id").isNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streamed = (cold.repartition(n, "h").sortWithinPartitions("h", "z", "_id", "key", "start").select("h", "_id", "key", "start", "words")
                .mapInArrow(stream, f"key binary, _id {kind}, start int"))
    warm = segments.join(large, "h", "left_semi").select("_id", "key", "start", "words").mapInArrow(windows, f"_id {kind}, key binary, start int, words binary")
    first = pin(warm.groupBy("words").agg(F.min(_order("start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "first")
    joined = warm.join(first, "words").where(_order("start") > F.col("first")).select("key", "_id", "start")
    return streamed.unionByName(joined)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text, spans.

    ``spans`` lists the maximal removed runs of words as (from, to), to exclusive. Earlier means a smaller id,
    or an earlier word of the same document; null ids come last, and rows that share an id are ordered by a hash
    of their text. Rows that repeat id and text are one document. A later copy of a whole text of at
    least ``window`` words goes entirely. A null text has no words, and shorter texts keep all. Other columns are not
    read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), text.alias("_text")).withColumn("h", F.xxhash64("key"))
    kind = dict(rows.dtypes)["_id"]
    spark = docs.sparkSession
    units = rows.groupBy("key").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"))).alias("f"), F.count(F.lit(1)).alias("c"))
    units = pin(units.select("key", F.col("f.i").alias("_first"), "c"), "units")
    # Only texts that may have copies are shuffled to find the first document of each; all others pass straight through.
    plane, bits = plane_of(units.where("c > 1").select(F.xxhash64("key").alias("h")))
    copied = spark.sparkContext.broadcast(plane)
    firsts = rows_in_plane(rows, "h", copied, bits, True).join(units.select("key", "_first"), "key").where(F.col("_id").eqNullSafe(F.col("_first")))
    own = rows_in_plane(rows, "h", copied, bits, False).unionByName(firsts.select(*rows.columns))
    repeats = repeated_windows(own.select("_id", "key", "_text"), window, gram, hot).groupBy("key").agg(F.collect_set("start").alias("starts"))
    marks = units.join(repeats, "key", "left").where(F.col("starts").isNotNull() | (F.col("c") > 1)).select("key", "_first", "starts")
    marks = pin(marks, "marks")
    plane2, bits2 = plane_of(marks.select(F.xxhash64("key").alias("h")))
    marked = spark.sparkContext.broadcast(plane2)

    def remove(batches):
        for part in text_slices(batches, "_text"):
            out = []
            for mine, starts, raw in zip(column_of(part, "mine").to_pylist(), column_of(part, "starts").to_pylist(), column_of(part, "_text").cast(pa.binary()).to_pylist()):
                words = raw.split()
                n = len(words)
                if not mine and n >= window:
                    out.append((n, n, "", [{"from": 0, "to": n}]))
                elif not mine or not starts:
                    out.append((n, 0, b" ".join(words).decode(), []))
                else:
                    edge = np.zeros(n + 1, np.int32)
                    s = np.array(starts)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    keep = np.cumsum(edge)[:n] == 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]])))
                    spans = [{"from": int(a), "to": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                    out.append((n, int(n - keep.sum()), b" ".join(compress(words, keep)).decode(), spans))
            n, removed, kept, spans = zip(*out)
            yield pa.RecordBatch.from_arrays([column_of(part, "_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                                              pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], ["_id", "n_words", "n_removed", "kept_text", "spans"])

    touched = rows_in_plane(rows, "h", marked, bits2, True).join(marks, "key", "left").select(
        "_id", (F.col("_first").isNull() & F.col("starts").isNull() | F.col("_id").eqNullSafe(F.col("_first"))).alias("mine"), "starts", "_text")
    whole = rows_in_plane(rows, "h", marked, bits2, False).select("_id", F.lit(True).alias("mine"), F.lit(None).cast("array<int>").alias("starts"), "_text")
    out = touched.unionByName(whole).mapInArrow(remove, f"_id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<from:int,to:int>>")
    return out.withColumnRenamed("_id", id_col)
