"""Words of Arrow text columns as numpy offsets and hashes; slices of bounded size.

A word is ``[^\\x20\\x09-\\x0D]+``. The separators are single bytes that occur in no other UTF-8
sequence, so words are found on the bytes of a whole slice at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20
_FOLD[0x41:0x5B] += 0x20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(NamedTuple):
    data: np.ndarray  # bytes of the slice, padded with eight zeros
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # 64-bit hash of each word's bytes
    first: np.ndarray  # index of each row's first word, and the number of words at the end
    row: np.ndarray  # row of each word

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = offsets[0]
    return data[base : offsets[-1]], offsets - base


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with ASCII marks as spaces and the letters of the first 256 code points in lower case."""
    out = _FOLD[raw]
    wide = np.flatnonzero(raw == 0xC3)
    wide = wide[wide + 1 < len(raw)] + 1  # the second byte of a letter from À on
    out[wide] += np.where((raw[wide] >= 0x80) & (raw[wide] <= 0x9E) & (raw[wide] != 0x97), 0x20, 0).astype(np.uint8)
    return out


def words_of(column: pa.Array, fold: bool = False) -> Words:
    """Words of all rows of a slice; with ``fold`` those of the folded texts."""
    raw, offsets = byte_column(column)
    raw = folded(raw) if fold else raw
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = raw
    inside = ~_SPACE[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]  # a row's end is a word's end, and its start may be a word's start
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, start, end, _hashes(data, start, end), first, row)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = end - start
    h = mixed(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = np.minimum(length[live] - at, 8).astype(np.uint64)
        part = eight[start[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[live] = mixed(h[live] ^ part) + np.uint64(0x9E3779B97F4A7C15)
        at += 8
        live = live[length[live] > at]
    return h


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they are all in the word's row."""
    m = len(w.hash)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h[: m - k] = mixed(h[: m - k] * np.uint64(3) + w.hash[k:] + np.uint64(k + 1)) if m > k else h[: m - k]
    return h, np.arange(m) + n <= w.first[w.row + 1]


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows and end with the row that makes them ``size`` bytes, unless
    the session has a size of its own: whole texts are long, and a batch is held twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(size))


def give_back() -> None:
    """Return freed memory to the system, as workers stay for later tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:  # glibc keeps what lies between pieces still in use
        _TRIM(0)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``budget`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_column(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
