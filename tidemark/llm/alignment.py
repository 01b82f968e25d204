"""Cross-tokenizer alignment: two vocabularies over the same bytes, each distinct text once.

Documents are shuffled by their full text, so a text is encoded and aligned once however many documents hold it. Places where a
token of both vocabularies ends cut the text into groups, and the two tokens that end there are linked. Two linked tokens
end at the same byte, so one's bytes are a suffix of the other's: all pairs that can ever be linked follow from the
two vocabularies alone. That bounds the table of pair counts, which is the only thing broadcast.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, column_of, text_slices
from tidemark.llm.vocabularies import byte_vocabulary, piece_vocabulary
from tidemark.session import pin

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@lru_cache(maxsize=2)
def possible_pairs(a_path: str, b_path: str) -> np.ndarray:
    """All (a, b) ids of which one's bytes end with the other's, as a * size of B + b, in order."""
    a, b = byte_vocabulary(a_path), piece_vocabulary(b_path)
    size = len(b.bytes)

    def by_bytes(v):
        out: dict[bytes, list[int]] = {}
        for i, x in enumerate(v.bytes):
            if v.emitted[i] and x:
                out.setdefault(x, []).append(i)
        return out

    in_a, in_b = by_bytes(a), by_bytes(b)
    found = {i * size + j for x, ids in in_a.items() for k in range(len(x)) for j in in_b.get(x[k:], ()) for i in ids}
    found |= {i * size + j for y, ids in in_b.items() for k in range(len(y)) for i in in_a.get(y[k:], ()) for j in ids}
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=1)
def _printed(size: int) -> list[str]:
    return [f"{i}{mark}" for i in range(size) for mark in ",|;"]


def aligned(text: str, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of both vocabularies, and the places of the tokens of A and of B that end together; None where the bytes differ."""
    whole = (" " + text).encode("utf-8")
    ids_a, ids_b = a.encode(" " + text), b.encode(text)
    if b"".join(map(a.bytes.__getitem__, ids_a)) != whole or b"".join(map(b.bytes.__getitem__, ids_b)) != whole:
        return None
    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    at = np.searchsorted(end_b, end_a)  # every token has a byte, so an end belongs to one token, and the last ends meet
    meet = np.flatnonzero(end_b[at] == end_a)
    return ids_a, ids_b, meet, at[meet]


def printed_groups(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups that end at the given tokens."""
    codes = np.zeros(len(ids_a) + len(ids_b), np.int64)
    group_a = np.searchsorted(last_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(last_b, np.arange(len(ids_b)))
    before_b = np.concatenate([[0], last_b[:-1] + 1])  # tokens of B in the groups before
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    codes[np.arange(len(ids_a)) + before_b[group_a]] = ids_a * 3 + mark_a
    codes[np.arange(len(ids_b)) + last_a[group_b] + 1] = ids_b * 3 + mark_b
    table = _printed(1 << max(17, int(codes.max()).bit_length() - 1))
    return "".join(map(table.__getitem__, codes.tolist()))[:-1]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte: the planes of high bytes are zeros, which Parquet stores in next to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair numbers and link counts of all rows of a batch, and the row of each."""
    pairs = [np.cumsum(_numbers(x)) for x in column_of(batch, "steps").to_pylist()]
    times = [_numbers(x) for x in column_of(batch, "times").to_pylist()]
    row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(pairs + empty), np.concatenate(times + empty), row


def distinct_alignments(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Per distinct text that aligns: key (SHA-256), copies, measures without counts, and its linked pairs."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    texts = docs.where(text.isNotNull() & (text != "")).groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select("text", "copies", F.unhex(F.sha2("text", 256)).alias("key"))

    def align(batches):
        a, b, known = byte_vocabulary(a_path), piece_vocabulary(b_path), possible_pairs(a_path, b_path)
        for part in text_slices(batches, "text"):
            out = []
            for text, copies, key in zip(*(column_of(part, c).to_pylist() for c in ("text", "copies", "key"))):
                found = aligned(text, a, b)
                if found is None:
                    continue
                ids_a, ids_b, last_a, last_b = found
                linked = ids_a[last_a] * len(b.bytes) + ids_b[last_b]
                number = np.searchsorted(known, linked)
                if (known[np.minimum(number, len(known) - 1)] != linked).any():
                    raise ValueError("linked tokens must end alike")
                number, times = np.unique(number, return_counts=True)
                digest = hashlib.sha256(printed_groups(*found).encode()).hexdigest()
                out.append((key, copies, len(ids_a), len(ids_b), len(last_a), len(linked), digest, _planes(np.diff(number, prepend=0)), _planes(times)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = pa.schema([("key", pa.binary()), *[(c, pa.int64()) for c in ("copies", *MEASURES[:4])],
                        ("groups_sha256", pa.string()), ("steps", pa.binary()), ("times", pa.binary())])
    longs = ", ".join(f"{c} long" for c in ("copies", *MEASURES[:4]))
    return texts.mapInArrow(align, f"key binary, {longs}, groups_sha256 string, steps binary, times binary")


def pair_counts(alignments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per linked pair: a, b and ``links``, how many links of all documents hold it. At most one row per possible pair."""
    known, size = possible_pairs(a_path, b_path), len(piece_vocabulary(b_path).bytes)

    def count(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            pair, times, row = _links(batch)
            copies = np.array(column_of(batch, "copies").to_pylist(), np.int64)
            np.add.at(total, pair, times * copies[row])
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(total[some])], ["_pair", "links"])

    partial = alignments.select("copies", "steps", "times").mapInArrow(count, "_pair long, links long")
    summed = partial.groupBy("_pair").agg(F.sum("links").alias("links"))
    return summed.select(F.floor(F.col("_pair") / size).cast("long").alias("a"), (F.col("_pair") % size).alias("b"), "links")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens do not spell a space and the text, has zeros and an empty digest. Repeated rows
    and null ids are answered row by row, and every copy of a text counts in the pair counts. Texts of any length
    are aligned whole. Ids of any type; other columns are not read. An empty table gives an empty result.
    """
    known = possible_pairs(a_path, b_path)
    size = len(piece_vocabulary(b_path).bytes)
    found = pin(distinct_alignments(docs, a_path, b_path, text_col), "alignments")
    counted = pair_counts(found, a_path, b_path).toArrow()  # at most one row per possible pair of the two vocabularies
    number = np.searchsorted(known, counted["a"].to_numpy() * size + counted["b"].to_numpy())
    links = np.zeros(len(known), np.int64)
    links[number] = counted["links"].to_numpy()
    most = np.zeros(size, np.int64)
    np.maximum.at(most, known % size, links)
    table = docs.sparkSession.sparkContext.broadcast((links, links == most[known % size]))

    def measure(batches):
        links, best = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, times, row = _links(batch)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, row, times * best[pair])
            np.add.at(total, row, times * links[pair])
            kept = [column_of(batch, c) for c in ("key", *MEASURES[:4])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(total), column_of(batch, "groups_sha256")], ["key", *MEASURES, "groups_sha256"])

    longs = ", ".join(f"{c} long" for c in MEASURES)
    measures = found.drop("copies").mapInArrow(measure, f"key binary, {longs}, groups_sha256 string")
    ids = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("key"))
    out = ids.join(measures, "key", "left")
    return out.select(F.col("_id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
