"""Ranked lexical search by norm buckets: the ten best documents of every benchmark item, exact.

A document is a vector of impacts over the words of the items, an item a vector of weights. Both are scaled by the roots of the
weights, which leaves every product as it is. Vectors are ordered by length over all documents and searched bucket by bucket
from the longest. A bucket whose longest vector cannot reach an item's tenth best score is skipped for that item
(Cauchy-Schwarz); inside a bucket, the coordinates of the item's heaviest words bound what a document can still reach; what
is left is scored in integers. The tenth best score starts from a part of the documents, chosen by a hash: it is a lower bound
of the true one, so it decides how much is skipped and never what is found.

Texts are read once per part of the items; what is stored and ordered is the numbers of the item words each text holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, byte_column, column_of, text_slices, words_of
from tidemark.session import pin

TOP = 10
PART_BYTES = 4 << 20  # distinct words of the items that are searched together, as they are sent to every task
BUCKET = 2048  # vectors of a bucket
SEED_PART = 32  # one document in so many gives the first tenth best scores
SLACK = 1 + 1e-9  # bounds are in doubles
SEPARATORS = [c for c in range(128) if not chr(c).isalnum()]
_TERM = np.arange(256, dtype=np.uint8)
_TERM[SEPARATORS] = 0x20
_TERM[0x41:0x5B] += 0x20


def terms_of(column: pa.Array):
    """The terms of all rows: runs of letters and digits of ASCII and of all other characters, only A-Z in lower case."""
    raw, offsets = byte_column(column)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_TERM[raw])])
    return words_of(plain)


class Terms:
    """Numbers of the terms of a part of the items; a hash finds the candidate, its bytes decide."""

    def __init__(self, terms: list[bytes]):
        column = pa.array(terms, pa.large_binary())
        words = words_of(column)
        order = np.argsort(words.hash, kind="stable")
        if (words.hash[order[1:]] == words.hash[order[:-1]]).any():
            raise ValueError("two terms share a hash")
        self.hash, self.start, self.end, self.data = words.hash[order], words.start[order], words.end[order], words.data
        self.terms = [terms[i] for i in order]

    def number(self, words) -> np.ndarray:
        """Each word's term number, or -1."""
        if not len(self.hash):
            return np.full(len(words.hash), -1)
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        at[self.hash[at] != words.hash] = -1
        live = np.flatnonzero(at >= 0)
        size, mine = words.end[live] - words.start[live], at[live]
        same = size == self.end[mine] - self.start[mine]
        for k in range(int(size.max(initial=0))):
            some = np.flatnonzero(same & (size > k))
            if not len(some):
                break
            same[some] = words.data[words.start[live[some]] + k] == self.data[self.start[mine[some]] + k]
        at[live[~same]] = -1
        return at


@lru_cache(maxsize=2)
def _numbered(terms: tuple[bytes, ...]) -> Terms:
    return Terms(list(terms))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of the items: a row number ``_no``, the id, and its distinct terms."""
    kind = dict(items.dtypes)[id_col]

    def split(batches):
        for part in text_slices(batches, "_text"):
            words = terms_of(column_of(part, "_text"))
            found = [sorted({words.data[a:b].tobytes() for a, b in zip(words.start[i:j], words.end[i:j])}) for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([column_of(part, "_id"), pa.array(found, pa.list_(pa.binary()))], ["_id", "_terms"])

    rows = items.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(split, f"_id {kind}, _terms array<binary>").where(F.size("_terms") > 0).withColumn("_no", F.monotonically_increasing_id())


def item_parts(items: DataFrame, limit: int) -> Iterator[list[tuple[int, tuple[bytes, ...]]]]:
    """Items in parts of at most ``limit`` bytes of words, or one item; the driver holds one part at a time."""
    part, size = [], 0
    for row in items.select("_no", "_terms").toLocalIterator():
        terms = tuple(bytes(t) for t in row["_terms"])
        more = sum(map(len, terms)) + 16 * len(terms)
        if part and size + more > limit:
            yield part
            part, size = [], 0
        part.append((row["_no"], terms))
        size += more
    if part:
        yield part


def term_index(docs: DataFrame, terms: tuple[bytes, ...], id_col: str, text_col: str) -> DataFrame:
    """Per document with a term: id, n, and the numbers and occurrences of the given terms it holds."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    told = docs.sparkSession.sparkContext.broadcast(terms)

    def index(batches):
        known = _numbered(told.value)
        for part in text_slices(batches, "_text"):
            words = terms_of(column_of(part, "_text"))
            n = np.diff(words.first)
            number = known.number(words)
            live = np.flatnonzero(number >= 0)
            cell, tf = np.unique(words.row[live] * len(known.terms) + number[live], return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(n) + 1) * max(1, len(known.terms))).tolist()
            held, tf = (cell % max(1, len(known.terms))).astype("<u4"), tf.astype("<u4")
            keep = pa.array(n > 0)
            batch = pa.RecordBatch.from_arrays(
                [column_of(part, "_id"), pa.array(n.astype(np.int64)), pa.array([held[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                 pa.array([tf[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["_id", "n", "held", "tf"])
            yield batch.filter(keep)

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(index, f"_id {kind}, n long, held binary, tf binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of all rows, and where each row's begin."""
    raw, offsets = byte_column(column)
    return np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), offsets // 4


def statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents of each numbered term."""

    def count(batches):
        total, df = [0, 0], np.zeros(size, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1] += int(np.sum(column_of(batch, "n").to_numpy()))
            df += np.bincount(_flat(column_of(batch, "held"))[0], minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([total, df[some]]))], ["k", "c"])

    told = index.select("n", "held").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # one row a term
    df = np.zeros(size + 2, np.int64)
    df[told["k"].to_numpy()] = told["c"].to_numpy()
    return int(df[-2]), int(df[-1]), df[:size]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impact of terms that occur ``tf`` times in documents of ``n`` terms."""
    lengths, back = np.unique(n, return_inverse=True)
    m = np.array([10 + 90 * x * n_docs // n_terms for x in lengths.tolist()], np.int64)[back]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def with_impacts(index: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Documents with a weighted item word: id, numbers, impacts, and the length of the scaled vector."""
    kind = dict(index.dtypes)["_id"]
    told = index.sparkSession.sparkContext.broadcast(weight)

    def value(batches):
        for batch in batches:
            held, first = _flat(column_of(batch, "held"))
            tf, _ = _flat(column_of(batch, "tf"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            p = impacts(column_of(batch, "n").to_numpy()[row], tf, n_docs, n_terms)
            squares = np.bincount(row, told.value[held] * p.astype(np.float64) ** 2, batch.num_rows)
            raw, ends = p.astype("<u4"), first.tolist()
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "_id"), pa.array(np.sqrt(squares)), column_of(batch, "held"), pa.array([raw[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                ["_id", "length", "held", "impact"]).filter(pa.array(squares > 0))

    return index.mapInArrow(value, f"_id {kind}, length double, held binary, impact binary")


class Bucket:
    """Vectors of similar length, by row and by term."""

    def __init__(self, ids: list, length: np.ndarray, held: np.ndarray, impact: np.ndarray, first: np.ndarray, weight: np.ndarray):
        self.ids, self.length, self.held, self.impact, self.first, self.weight = ids, length, held, impact, first, weight
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.argsort(held, kind="stable")
        self.row, self.by_term = row[order], order
        self.begin = np.searchsorted(held[order], np.arange(len(weight) + 1))

    def postings(self, terms: np.ndarray) -> np.ndarray:
        """Places of the entries of the given terms."""
        parts = [self.by_term[self.begin[t] : self.begin[t + 1]] for t in terms.tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def survivors(self, heavy: np.ndarray, rest: float, least: float) -> np.ndarray:
        """Vectors that can reach ``least``: the product over the item's heavy words, plus Cauchy-Schwarz over all other coordinates."""
        at = self.postings(heavy)
        row = np.searchsorted(self.first, at, "right") - 1
        w, p = self.weight[self.held[at]], self.impact[at].astype(np.float64)
        known = np.bincount(row, w * p, len(self.ids))
        left = np.sqrt(np.maximum(self.length**2 * SLACK - np.bincount(row, w * p * p, len(self.ids)), 0))
        return np.flatnonzero((known + rest * left) * SLACK >= least)

    def scores(self, rows: np.ndarray, in_item: np.ndarray) -> np.ndarray:
        """Exact scores of the given vectors with the item whose words are marked."""
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        gain = np.where(in_item[self.held[at]], self.weight[self.held[at]] * self.impact[at], 0)
        return np.concatenate([[0], np.cumsum(gain)])[np.cumsum(size)] - np.concatenate([[0], np.cumsum(gain)])[np.cumsum(size) - size]


def _buckets(batches, weight: np.ndarray, size: int) -> Iterator[Bucket]:
    """Vectors as they come, in buckets of ``size``."""
    held, rows = [], 0

    def close(parts):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        terms, first = _flat(column_of(batch, "held"))
        return Bucket(column_of(batch, "_id").to_pylist(), column_of(batch, "length").to_numpy(), terms, _flat(column_of(batch, "impact"))[0], first, weight)

    for batch in batches:
        while batch.num_rows:
            take = min(size - rows, batch.num_rows)
            held.append(batch.slice(0, take))
            rows, batch = rows + take, batch.slice(take)
            if rows == size:
                yield close(held)
                held, rows = [], 0
    if rows:
        yield close(held)


def _order(entry: tuple) -> tuple:
    score, key = entry
    return (-score, key is None, 0 if key is None else key)


def search(vectors: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, least: np.ndarray, top: int, bucket: int) -> DataFrame:
    """Per item and partition: the ``top`` best vectors with a score of at least ``least`` of the item; ties by id, nulls last."""
    kind = dict(vectors.dtypes)["_id"]
    told = vectors.sparkSession.sparkContext.broadcast((items, weight, least))

    def best(batches):
        items, weight, least = told.value
        queries = []
        for no, terms in items:
            terms = terms[weight[terms] > 0]
            terms = terms[np.argsort(-weight[terms], kind="stable")]
            square = np.cumsum(weight[terms])
            heavy = int(np.searchsorted(square, square[-1] * 0.75)) + 1 if len(terms) else 0
            mask = np.zeros(len(weight), bool)
            mask[terms] = True
            queries.append((no, terms[:heavy], float(np.sqrt(weight[terms[heavy:]].sum())), float(np.sqrt(weight[terms].sum())), mask))
        least, found = least.astype(np.int64).copy(), [[] for _ in queries]
        for b in _buckets(batches, weight, bucket):
            longest = float(b.length.max())
            for k, (_, heavy, rest, length, mask) in enumerate(queries):
                if length * longest * SLACK < least[k] or not len(heavy):
                    continue
                rows = b.survivors(heavy, rest, float(least[k]))
                score = b.scores(rows, mask) if len(rows) else rows
                good = np.flatnonzero(score >= max(1, least[k]))
                if not len(good):
                    continue
                if len(good) > top:  # all that tie with the last that can matter
                    good = good[score[good] >= np.partition(score[good], -top)[-top]]
                found[k] = sorted(found[k] + [(int(score[i]), b.ids[rows[i]]) for i in good], key=_order)[:top]
                if len(found[k]) == top:
                    least[k] = max(least[k], found[k][-1][0])
        out = [(no, score, key) for (no, *_), mine in zip(queries, found) for score, key in mine]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = vectors.limit(0).select(F.lit(0).cast("long").alias("_no"), F.lit(0).cast("long").alias("score"), "_id").toArrow().schema
    return vectors.mapInArrow(best, f"_no long, score long, _id {kind}")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("_no").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", part_bytes: int = PART_BYTES, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``items``: item id, rank, document id, score of its ``top`` best rows of ``docs`` with a score above 0.

    Equal scores are ranked by ascending id, null ids last. Repeated rows of documents compete as documents of their own, and
    repeated items are answered each. Null and empty texts have no terms: such documents are in no count, such
    items have no rows. Words and texts of any length. Other columns are not read. An empty table of either kind gives an empty result.
    """
    asked = pin(item_terms(items, item_col, item_text_col), "items")
    out = asked.select("_no", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("score")).limit(0).join(docs.select(F.col(id_col).alias("_id")).limit(0))
    for part in item_parts(asked, part_bytes):
        known = _numbered(tuple(sorted({t for _, terms in part for t in terms})))
        place = {t: i for i, t in enumerate(known.terms)}
        numbered = [(no, np.array([place[t] for t in terms])) for no, terms in part]
        index = pin(term_index(docs, tuple(known.terms), id_col, text_col), "terms")
        n_docs, n_terms, df = statistics(index, len(known.terms))
        weight = np.where(df > 0, weights(df, n_docs), 0)
        vectors = with_impacts(index, weight, n_docs, max(1, n_terms))
        none = np.zeros(len(numbered), np.int64)
        seed = vectors.where(F.pmod(F.xxhash64("_id", "held"), F.lit(SEED_PART)) == 0)
        floor = _best(search(seed, numbered, weight, none, top, bucket), top).where(F.col("rank") == top).toArrow()  # one row an item
        first = dict(zip(floor["_no"].to_pylist(), floor["score"].to_pylist()))
        least = np.array([first.get(no, 0) for no, _ in numbered], np.int64)
        # The hash parts vectors of one length; which partition a vector is in does not change what is found.
        lined = vectors.repartitionByRange(F.col("length").desc(), F.xxhash64("_id")).sortWithinPartitions(F.col("length").desc())
        out = out.unionByName(pin(_best(search(lined, numbered, weight, least, top, bucket), top).select("_no", "rank", "score", "_id"), "ranked"))
    return out.join(asked.select("_no", F.col("_id").alias("_item")), "_no").select(
        F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
