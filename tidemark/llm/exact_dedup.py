"""Exact duplicates by a two-pass Bloom filter: only rows whose hash may repeat are shuffled.

Pass 1 reads one 64-bit hash per text and keeps, for each bit of a filter of bounded size, whether
two or more rows set it. The bits are gathered by chunk of the filter, never by row on the driver.
Pass 2 probes every row: unless all its bits were set twice, its text occurs once and the row goes
straight to the result. The other rows, and only they, are grouped by the SHA-256 of their text.
A filter that is too full sends more rows to the exact step and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import pin

BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28  # at most 32 MB is collected and broadcast
CHUNKS = 256
HELD_SLOTS = 1 << 20  # bit places that a task holds before it hands them on


def slots_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, rows * BITS_PER_ROW) - 1).bit_length()))


def repeated_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """(chunk, twice): for each chunk of the filter, the bits that two or more rows of ``hashes(h)`` set."""
    chunk_bits = bits // CHUNKS

    def packed(slots: np.ndarray) -> pa.RecordBatch:
        slots = np.sort(slots)
        chunk = slots // chunk_bits
        cut = np.flatnonzero(np.diff(chunk, prepend=-1))
        return pa.RecordBatch.from_arrays([
            pa.array(chunk[cut].astype(np.int32)),
            pa.array([(p % chunk_bits).astype("<u4").tobytes() for p in np.split(slots, cut[1:])], pa.binary())], ["chunk", "slots"])

    def spread(batches):
        held, size = [], 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = slots_of(h, bits)
            held += [a, b[b != a]]
            size += 2 * len(h)
            if size >= HELD_SLOTS:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def merge(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                once, twice = planes.setdefault(chunk, (np.zeros(chunk_bits, bool), np.zeros(chunk_bits, bool)))
                slots = np.frombuffer(raw.as_buffer(), "<u4")
                again = np.zeros(len(slots), bool)  # sorted: equal neighbours are two rows
                again[1:] = slots[1:] == slots[:-1]
                twice[slots[again]] = True
                twice[slots[once[slots]]] = True
                once[slots] = True
        if planes:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(planes), pa.int32()),
                pa.array([np.packbits(t, bitorder="little").tobytes() for _, t in planes.values()], pa.binary())], ["chunk", "twice"])

    return hashes.mapInArrow(spread, "chunk int, slots binary").repartition(CHUNKS // 4, "chunk").mapInArrow(merge, "chunk int, twice binary")


def collect_plane(repeated: DataFrame, bits: int) -> np.ndarray:
    """The filter as one array of bits / 8 bytes, at most MAX_BITS / 8."""
    plane, size = np.zeros(bits // 8, np.uint8), bits // CHUNKS // 8
    for chunk, twice in repeated.collect():
        plane[chunk * size : (chunk + 1) * size] = np.frombuffer(twice, np.uint8)
    return plane


def in_plane(plane: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether all bits of each hash were set twice."""
    maybe = np.ones(len(h), bool)
    for s in slots_of(h, bits):
        maybe &= (plane[s >> 3] >> (s & 7) & 1).astype(bool)
    return maybe


def plane_of(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A filter that holds every hash of ``hashes(h)``, and its number of bits."""
    bits = filter_bits(hashes.count())
    return collect_plane(repeated_bits(hashes.unionByName(hashes), bits), bits), bits


def rows_in_plane(rows: DataFrame, h: str, plane, bits: int, inside: bool) -> DataFrame:
    """The rows whose hash ``h`` may be in the broadcast filter, or those for which it cannot be."""

    def chosen(batches):
        for batch in batches:
            hit = in_plane(plane.value, batch.column(batch.schema.get_field_index(h)).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            yield batch.filter(pa.array(hit if inside else ~hit))

    return rows.mapInArrow(chosen, rows.schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    A null text is an empty text. Of equal texts the largest id stays; a null id stays only where no
    other row has the text. Rows that repeat both id and text share their answer. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_sha"), F.xxhash64(text).alias("_h"))
    rows = pin(rows, "exact")
    n = rows.count()
    bits = filter_bits(n)
    shared = docs.sparkSession.sparkContext.broadcast(collect_plane(repeated_bits(rows.select("_h"), bits), bits))

    def probe(batches):
        for batch in batches:
            maybe = in_plane(shared.value, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maybe)], ["_id", "_sha", "_maybe"])

    kind = dict(rows.dtypes)["_id"]
    probed = rows.mapInArrow(probe, f"_id {kind}, _sha string, _maybe boolean")
    candidates = probed.where("_maybe").select("_id", "_sha")
    # Written, so that the join below reads two exchanges and a text with many copies can be split.
    groups = pin(candidates.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")), "groups")
    passed = probed.where("NOT _maybe").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_sha")
    return (candidates.join(groups, "_sha").select("_id", "_keep", "_n", "_sha").unionByName(passed)
            .select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
                    F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256")))
