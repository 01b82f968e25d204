"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 64 words that start every 32 words. Items are taken in groups of at most RANK,
and each group has a latent space of its own, from the matrix A of all passages' TF-IDF vectors over the group's
words and the items as rows that outweigh them: its first singular vectors span the items, the next DIRECTIONS are the
leading ones of what the passages hold beside them. These come from a randomised SVD: tasks add up what
(A^T A) does to a random block, which is as large as vocabulary x DRAWN whatever the corpus size, and the driver
takes singular vectors of the sum. Both items and passages are projected and compared by their cosine in the
latent space, so words of a passage outside it do not hide a copy. A passage is a candidate when its cosine with an item reaches
half of what a copy would give among words of average weight, or when it holds that share of the item's weight
whatever its other words. Every word of an item has a weight, common words a small one. Candidates are decided on the words: by the longest common
subsequence with the item, and for paraphrases also by the item's answer, its last sentence.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textwords import Words, bounded_batches, column_of, text_slices, words_of

STRIDE = 32  # words; a passage is two strides
RANK = 256  # items in a latent space at most; each adds a direction
DIRECTIONS, DRAWN = 32, 48  # of the passages in a latent space, and random vectors that they are taken from
VOCABULARY = 1 << 15  # rows of the partial sums that a task adds up in one pass; further groups take another
CELLS = 1 << 20
COMMON, DENSE = 0.05, 512  # of the words in more than this share of all texts, so many are counted as columns instead of entries
NEAR = 0.5  # of the cosine or the product that a full copy would have
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8  # shares of an item's words, and of its answer's
MAX_ITEMS_BYTES = 4 << 20  # bounds what is broadcast and the vocabulary of a task's partial sum
CHUNK = 1 << 16
SUMS = 64  # keys of partial sums: each is added up in a task of its own


class Space(NamedTuple):
    """What tasks need for one group of items: weights by word, the latent basis, and the items in it."""

    cell: np.ndarray  # sorted hashes of the vocabulary
    often: np.ndarray  # numbers of the commonest words in it
    basis: np.ndarray  # vocabulary x directions: idf x right singular vector
    item: np.ndarray  # items x directions, of length 1
    least: np.ndarray  # per item: the least cosine of a candidate
    holds: np.ndarray  # per item: the product with a passage from which it is a candidate whatever its cosine
    ids: list
    words: list  # per item: its words' hashes
    answer: list  # per item: first word of its answer


def _folded(texts: pa.Array) -> Words:
    """Words in lower case without marks; case and punctuation do not hide a copy."""
    return words_of(texts, fold=True)


def word_texts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts per cell of words, and the number of texts, over the whole corpus."""
    def count(batches):
        total, rows = np.zeros(CELLS, np.int64), 0
        for part in text_slices(batches, "_text"):
            w = _folded(column_of(part, "_text"))
            seen = np.sort(w.row.astype(np.int64) << 20 | (w.hash & np.uint64(CELLS - 1)).astype(np.int64))
            seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] if len(seen) else seen
            total += np.bincount(seen & (CELLS - 1), minlength=CELLS)
            rows += part.num_rows
        n = CELLS // CHUNK
        yield pa.RecordBatch.from_arrays([pa.array([*range(n), -1], pa.int32()), pa.array(
            [total[k * CHUNK : (k + 1) * CHUNK].astype("<i8").tobytes() for k in range(n)] + [np.array([rows], "<i8").tobytes()], pa.binary())], ["chunk", "sums"])

    sums = dict(_added(docs.select("_text").mapInArrow(count, "chunk int, sums binary"), "<i8"))
    none = np.zeros(CHUNK, np.int64)
    return np.concatenate([sums.get(k, none) for k in range(CELLS // CHUNK)]), int(sums.get(-1, [0])[0])


def _added(parts: DataFrame, kind: str) -> list[tuple[int, np.ndarray]]:
    """Arrays of one key added up in tasks; the number and size of the keys is fixed."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer(), kind).astype(np.float64 if kind == "<f4" else kind)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(kind).tobytes() for v in sums.values()], pa.binary())], ["chunk", "sums"])

    return [(k, np.frombuffer(raw, kind)) for k, raw in parts.repartition(SUMS, "chunk").mapInArrow(add, "chunk int, sums binary").collect()]


def _blocks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each word, row of each block and the block's first word; a block is one stride of a row."""
    size = np.diff(w.first)
    per = -(-size // STRIDE)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    first = w.first[row] + nth * STRIDE
    block = np.repeat(np.arange(len(row)), np.minimum(STRIDE, w.first[row + 1] - first)) if len(row) else np.zeros(0, np.int64)
    return block, row, first


def _entries(w: Words, block: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and vocabulary numbers of the words that are in the vocabulary."""
    at = np.minimum(np.searchsorted(cell, w.hash), len(cell) - 1)
    hit = cell[at] == w.hash
    return block[hit], at[hit]


def _split(block: np.ndarray, word: np.ndarray, size: int, often: np.ndarray) -> tuple[tuple, tuple]:
    """Entries of the words ``often`` with the words' places in it, and the other entries."""
    column = np.full(size, -1, np.int32)
    column[often] = np.arange(len(often))
    at = column[word]
    dense = at >= 0
    return (block[dense], at[dense]), (block[~dense], word[~dense])


def _counted(block: np.ndarray, place: np.ndarray, n: int, m: int):
    """(first block, block after the last, counts of blocks x m words) from entries in block order."""
    for a in range(0, n, 4096):
        to = min(n, a + 4096)
        x, y = np.searchsorted(block, (a, to))
        cells = (block[x:y] - a) * m + place[x:y]
        yield a, to, np.bincount(cells, minlength=(to - a) * m).reshape(to - a, m).astype(np.float32)


def _add_runs(out: np.ndarray, key: np.ndarray, matrix: np.ndarray, row: np.ndarray) -> None:
    """out[key] += matrix[row], equal keys side by side."""
    for a in range(0, len(key), 8192):  # a part may end inside a run
        k, part = key[a : a + 8192], matrix[row[a : a + 8192]]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[cut]] += np.add.reduceat(part, cut, axis=0)


def _rows_times(block: np.ndarray, word: np.ndarray, n: int, matrix: np.ndarray, often: np.ndarray) -> np.ndarray:
    """(blocks x vocabulary counts) @ matrix, from entries in block order; the words ``often`` by a dense product."""
    out = np.zeros((n, matrix.shape[1]), np.float32)
    (block, place), (rare, word) = _split(block, word, len(matrix), often)
    if len(block):
        part = matrix[often]
        for a, to, counts in _counted(block, place, n, len(often)):
            np.matmul(counts, part, out=out[a:to])
    _add_runs(out, rare, matrix, word)
    return out


def _times_rows(block: np.ndarray, word: np.ndarray, rows: np.ndarray, total: np.ndarray, often: np.ndarray) -> None:
    """total += (vocabulary x blocks counts) @ rows, as ``_rows_times``."""
    (block, place), (rare, word) = _split(block, word, len(total), often)
    if len(block):
        for a, to, counts in _counted(block, place, len(rows), len(often)):
            total[often] += counts.T @ rows[a:to]
    order = np.argsort(word, kind="stable")
    _add_runs(total, word[order], rows, rare[order])


class _Group(NamedTuple):
    """Items of one latent space before it is factored."""

    items: list
    words: Words
    cell: np.ndarray
    weight: np.ndarray
    often: np.ndarray  # numbers of the words in more than COMMON of all texts, DENSE at most; only how they are counted depends on it
    tfidf: np.ndarray  # items x vocabulary
    own: np.ndarray  # vocabulary x items: the items' span
    drawn: np.ndarray  # vocabulary x random vectors beside the items' span


def _group(items: list[tuple], idf: np.ndarray, share: np.ndarray, seed: int) -> _Group:
    of = lambda h, x=idf: x[(h & np.uint64(CELLS - 1)).astype(np.int64)]
    w = _folded(pa.array([t for _, t in items], pa.large_string()))
    cell = np.unique(w.hash)
    weight = of(cell).astype(np.float32)
    counts = np.zeros((len(items), len(cell)), np.float32)
    np.add.at(counts, (w.row, np.searchsorted(cell, w.hash)), 1)
    seen = of(cell, share)
    often = np.argsort(-seen, kind="stable")[: min(DENSE, int((seen > COMMON).sum()))]
    tfidf = counts * weight
    own, _ = np.linalg.qr(tfidf.T.astype(np.float64))
    drawn = np.random.Generator(np.random.PCG64(seed)).standard_normal((len(cell), min(DRAWN, len(cell) - own.shape[1])))
    return _Group(items, w, cell, weight, often, tfidf, own, _beside(drawn, own))


def _beside(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What is left of the columns of ``x`` without their parts in the span of ``own``."""
    return x - own @ (own.T @ x)


def _passes(groups: list[_Group]) -> list[list[_Group]]:
    """Groups whose vocabularies together have at most VOCABULARY words, or one group."""
    out: list[list[_Group]] = []
    size = 0
    for g in groups:
        if not out or size + len(g.cell) > VOCABULARY:
            out.append([])
            size = 0
        out[-1].append(g)
        size += len(g.cell)
    return out


def _images(docs: DataFrame, groups: list[_Group]) -> list[np.ndarray]:
    """Per group: (A^T A) times its random vectors, A the vectors of all passages over all its words; one pass."""
    shared = docs.sparkSession.sparkContext.broadcast([(g.cell, g.often, g.weight, (g.drawn * g.weight[:, None]).astype(np.float32)) for g in groups])

    def multiply(batches):
        totals = [np.zeros(omega.shape, np.float64) for *_, omega in shared.value]
        for part in text_slices(batches, "_text"):
            words = _folded(column_of(part, "_text"))
            block, row, _ = _blocks(words)
            follows = _follows(row)
            for (cell, often, _, omega), total in zip(shared.value, totals):
                b, v = _entries(words, block, cell)
                if not len(b):
                    continue
                passage = _rows_times(b, v, len(row), omega, often)
                passage[follows] += passage[follows + 1]
                back = passage.copy()  # each block counts in its own passage and in the one before
                back[follows + 1] += passage[follows]
                _times_rows(b, v, back, total, often)
        for k, ((cell, _, weight, _), total) in enumerate(zip(shared.value, totals)):
            total *= weight[:, None]
            height = max(1, -(-len(cell) // SUMS))  # vocabulary rows of one partial sum
            spans = range(0, len(cell), height)
            yield pa.RecordBatch.from_arrays([pa.array(range(k * SUMS, k * SUMS + len(spans)), pa.int32()), pa.array([total[a : a + height].astype("<f4").tobytes() for a in spans], pa.binary())], ["chunk", "sums"])

    sums = dict(_added(docs.select("_text").mapInArrow(multiply, "chunk int, sums binary"), "<f4"))
    images = []
    for k, g in enumerate(groups):
        mine = [sums[c] for c in sorted(sums) if c // SUMS == k]
        images.append(np.concatenate(mine).reshape(g.drawn.shape) if mine else np.zeros(g.drawn.shape))
    return images


def _follows(row: np.ndarray) -> np.ndarray:
    """Blocks whose next block is of the same row; the passage that begins there is both."""
    return np.flatnonzero(row[1:] == row[:-1])


def _directions(drawn: np.ndarray, image: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Leading singular vectors of the passages beside the span of ``own``, from what their (A^T A) makes of ``drawn``."""
    left = _beside(image.astype(np.float64), own)
    inner = drawn.T @ left
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    real = value > 1e-6 * max(value[-1], 1e-9)
    u, s, _ = np.linalg.svd(left @ (vector[:, real] / np.sqrt(value[real])), full_matrices=False)
    u = u[:, :DIRECTIONS][:, s[:DIRECTIONS] > 0]
    return np.linalg.qr(_beside(u, own))[0]


def fit(docs: DataFrame, items: list[tuple], rank: int = RANK, seed: int = 3) -> list[Space]:
    """The latent spaces of all passages and groups of at most ``rank`` items. ``items`` (id, text) fit into MAX_ITEMS_BYTES."""
    texts, n_texts = word_texts(docs)
    idf = np.log1p(max(1, n_texts) / np.maximum(texts, 1))  # at least log 2
    share = texts / max(1, n_texts)
    groups = [g for a in range(0, len(items), rank) if len((g := _group(items[a : a + rank], idf, share, seed)).cell)]
    # Items that span all their words leave nothing beside them.
    beside = [g for g in groups if g.drawn.shape[1]]
    images = {id(g): x for part in _passes(beside) for g, x in zip(part, _images(docs, part))}
    return [_space(g, images.get(id(g)), texts) for g in groups]


def _space(group: _Group, image: np.ndarray | None, texts: np.ndarray) -> Space:
    items, w, cell, weight, often, tfidf, own, drawn = group
    # The items' directions come first and whole, then the passages' singular vectors.
    basis = (own if image is None else np.concatenate([own, _directions(drawn, image, own)], 1)).astype(np.float32)
    latent = tfidf @ basis
    norm = np.sqrt((tfidf**2).sum(1))
    sizes = np.diff(w.first)
    # The squared latent length of a word of the corpus on average.
    basis *= weight[:, None]
    usual = float((texts[(cell & np.uint64(CELLS - 1)).astype(np.int64)] * (basis**2).sum(1)).sum() / max(1, texts.sum()))
    # The cosine of a passage that holds the item, or as much of it as fits, among words of average weight.
    inside = np.minimum(1.0, 2 * STRIDE / np.maximum(sizes, 1))
    full = np.sqrt(inside * norm**2 * inside / np.maximum(norm**2 * inside + np.maximum(0, 2 * STRIDE - sizes) * usual, 1e-9))
    words, answer = [], []
    for k, (_, text) in enumerate(items):
        words.append(w.hash[w.first[k] : w.first[k + 1]])
        tails = [len(_folded(pa.array([s])).hash) for s in re.split(r"(?<=[.!?])\s+", text or "")]
        answer.append(max(0, len(words[-1]) - next((n for n in reversed(tails) if n), 0)))
    item = latent / np.maximum(norm, 1e-9)[:, None]
    return Space(cell, often, basis, item.astype(np.float32), (NEAR * full).astype(np.float32), (NEAR * inside * norm).astype(np.float32), [i for i, _ in items], words, answer)


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one step on ``len(a)`` bits per element of ``b`` that ``a`` has."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    whole = free = (1 << len(a)) - 1  # a bit falls where the length grows by one
    for x in b.tolist():
        at = places.get(x)
        if at:
            at &= free
            free = (free + at | free - at) & whole
    return len(a) - free.bit_count()


def _near(space: Space, latent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``latent`` and items that are candidates of each other."""
    product = latent @ space.item.T
    length = np.sqrt(np.einsum("ij,ij->i", latent, latent))[:, None]
    # An item without a word has product 0 and holds nothing.
    return np.nonzero((product > 0) & (product >= np.minimum(space.least * length, space.holds)))


def _decide(space: Space, k: int, passage: np.ndarray) -> float:
    """Share of item ``k`` that ``passage`` holds in order if it is a copy or a paraphrase, else 0."""
    words = space.words[k]
    if not len(words):
        return 0.0
    # No subsequence is longer than the number of the item's words that the passage has at all.
    has = set(passage.tolist())
    if sum(x in has for x in words.tolist()) < PARAPHRASE * len(words):
        return 0.0
    share = common_length(words, passage) / len(words)
    if share >= COPY:
        return share
    tail = words[space.answer[k] :]
    if share >= PARAPHRASE and len(tail) and common_length(tail, passage) >= ANSWER * len(tail):
        return share
    return 0.0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, best_share, items, n_passages.

    ``items`` lists the ids of the benchmark items whose copy or paraphrase was found, ascending;
    best_share is the largest share of an item's words. A null or empty text has no passage and is clean.
    Null and empty items match nothing, null item ids are listed as null, and of repeated items each is
    listed once. Repeated rows are answered row by row; other columns are not read. An empty table
    gives an empty result. The benchmark is broadcast and must fit into MAX_ITEMS_BYTES.
    """
    bounded_batches(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    if size > MAX_ITEMS_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; pass it in parts of {MAX_ITEMS_BYTES} bytes")
    items = sorted({(r[0], r[1]) for r in benchmark.select(item_col, item_text).collect() if r[1]}, key=str)
    given = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    spaces = fit(given, items, rank)
    shared = [docs.sparkSession.sparkContext.broadcast(s) for s in spaces]

    def search(batches):
        for part in text_slices(batches, "_text"):
            n = part.num_rows
            found: list[dict] = [{} for _ in range(n)]
            ids: list[set] = [set() for _ in range(n)]
            w = _folded(column_of(part, "_text"))
            block, row, first = _blocks(w)
            passages = np.bincount(row, minlength=n)
            follows = _follows(row)
            for g, one in enumerate(shared):
                space = one.value
                b, v = _entries(w, block, space.cell)
                if not len(b):
                    continue
                latent = _rows_times(b, v, len(row), space.basis, space.often)
                latent[follows] += latent[follows + 1]
                live = np.unique(np.concatenate([b, b[b > 0] - 1]))
                for a in range(0, len(live), 4096):
                    p = live[a : a + 4096]
                    for i, k in zip(*_near(space, latent[p])):
                        q, r = p[i], row[p[i]]
                        if found[r].get((g, k), 0) >= 1:
                            continue
                        # The item may begin before the passage or end after it.
                        reach = len(space.words[k])
                        words = w.hash[max(w.first[r], first[q] - reach) : min(w.first[r + 1], first[q] + 2 * STRIDE + reach)]
                        share = _decide(space, k, words)
                        if share:
                            found[r][g, k] = max(share, found[r].get((g, k), 0))
                            ids[r].add(space.ids[k])
            lists = [sorted(x, key=lambda i: (i is None, i)) for x in ids]
            yield pa.RecordBatch.from_arrays([column_of(part, "_id"), pa.array(lists, pa.list_(_arrow(item_kind))), pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
                                              pa.array(passages)], ["_id", "items", "best_share", "n_passages"])

    out = given.mapInArrow(search, f"_id {kind}, items array<{item_kind}>, best_share double, n_passages long")
    return out.select(F.col("_id").alias(id_col), (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "best_share", "items", "n_passages")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
