"""Token files in directly addressable codes, written by Spark and read back.

Ids are split into chunks of eight bits. Level 0 holds the lowest chunk of every id, with one bit per
id that says whether a higher chunk follows on the next level; level k holds the next chunk of those
that continue. A rank directory counts the set bits before every 512th, so a token's place on the next
level is one directory entry and at most 64 bytes of bitmap away: any token is read without decoding
its block. A file is a Parquet part with one row per block of consecutive documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, column_of, give_back, text_slices, words_of

RANK_BITS = 512
BLOCK_TOKENS = 1 << 18
CACHED_WORDS, CACHED_IDS = 1 << 19, 1 << 22  # about 30 MB
CACHED_MARKS = 1 << 14
NEW_WORDS = 1 << 14  # words that are Python objects at a time
SCHEMA = ("shard int, block int, first long, n_tokens long, doc_ids array<{kind}>, ends array<long>, "
          "codes array<binary>, bitmaps array<binary>, ranks array<binary>")
Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def dac_encode(ids: np.ndarray) -> Levels:
    """Levels of (codes, continuation bitmap, rank directory); no ids give no level."""
    levels: Levels = []
    ids = ids.astype(np.uint32)
    while len(ids):
        more = ids > 255
        ones = np.add.reduceat(more, np.arange(0, len(ids), RANK_BITS), dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        levels.append((ids.astype(np.uint8), np.packbits(more, bitorder="little"), rank))
        ids = ids[more] >> np.uint32(8)
    return levels


def dac_decode(levels: Levels) -> np.ndarray:
    out = np.zeros(0, np.uint32)
    for codes, bitmap, _ in reversed(levels):
        more = np.unpackbits(bitmap, count=len(codes), bitorder="little").view(bool)
        upper, out = out, codes.astype(np.uint32)
        out[more] |= upper << np.uint32(8)
    return out


def dac_access(levels: Levels, at: int) -> int:
    """The id at one place, through the rank directories."""
    value = 0
    for k, (codes, bitmap, rank) in enumerate(levels):
        value |= int(codes[at]) << 8 * k
        if not bitmap[at >> 3] >> (at & 7) & 1:
            break
        start = at // RANK_BITS * RANK_BITS
        at = int(rank[at // RANK_BITS]) + int(np.unpackbits(bitmap[start >> 3 : (at >> 3) + 1], bitorder="little")[: at - start].sum())
    return value


# Letters of the first 256 code points and then these marks are two pre-tokens whatever stands around them.
_MARKS = ".,;:!?*#$%&|"


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file whose pre-tokens never cross white space.

    The library encodes the different words of a slice that are not kept from earlier ones; ids are kept in arrays sorted by the
    word's 64-bit hash, of which a task looks up all words of a slice at once. When they are full, words that came again stay. ASCII letters need no normalising and no splitting and go to
    the model itself, other letters in lines that are cut at the end-of-word tokens, all else as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks: dict[str, list[int]] = {"": []}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.again = np.zeros(0, np.uint32), np.zeros(0, bool)

    def _make_room(self) -> None:
        """Keep the words looked up again since the last time, or none if they fill more than half."""
        keep = np.flatnonzero(self.again)
        hashes, size = self.hashes[keep], self.size[keep]
        if 2 * len(keep) > CACHED_WORDS or 2 * int(size.sum()) > CACHED_IDS:
            return self.forget()
        self.ids = self._ids_at(self.first[keep], size)[0]
        self.hashes, self.first, self.size, self.again = hashes, np.cumsum(size) - size, size, np.zeros(len(keep), bool)

    def _ids_at(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these places, one after the other, and where each begins (with the end)."""
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 64):
            line = words[i : i + 64]
            ids = self._library([" ".join(line)])[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            out += [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())] if len(ends) == len(line) else self._library(line)
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a word has no white space of one byte."""
        cores: dict[str, list[int]] = {}
        split, rest = [], []
        for k, w in enumerate(words):
            core = w.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
                split.append((k, core.lower(), w[len(core) :]))
            else:
                rest.append(k)
        for _, core, _ in split:
            if core not in cores:
                cores[core] = [t.id for t in self.model.tokenize(core)] if core.isascii() else []
        wide = [c for c in cores if not c.isascii()]
        cores.update(zip(wide, self._letters(wide)))
        marks = list({m for _, _, m in split if m not in self.marks})
        self.marks.update(zip(marks, self._library(marks)))
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(rest, self._library([words[k] for k in rest])):
            out[k] = ids
        for k, core, mark in split:
            out[k] = cores[core] + self.marks[mark] if mark else cores[core]
        if len(self.marks) > CACHED_MARKS:
            self.marks = {"": []}
        return out

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the place of each row's first id (with the end)."""
        w = words_of(texts)
        different, where, which = np.unique(w.hash, return_index=True, return_inverse=True)
        at, known = self._place(different)
        self.again[at[known]] = True
        if len(self.hashes) + len(different) - int(known.sum()) > CACHED_WORDS or len(self.ids) > CACHED_IDS:
            self._make_room()
            at, known = self._place(different)
        if not known.all():
            new, place = different[~known], where[~known]
            ids, size = [self.ids], []
            for k in range(0, len(new), NEW_WORDS):
                some = place[k : k + NEW_WORDS]
                # A row may begin in the middle of the buffer, never in the middle of a character.
                found = self.words([w.data[a:b].tobytes().decode("utf-8") for a, b in zip(w.start[some].tolist(), w.end[some].tolist())])
                size.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size[-1].sum())))
            size = np.concatenate(size)
            first = len(self.ids) + np.cumsum(size) - size
            to = np.searchsorted(self.hashes, new)
            self.hashes, self.first, self.size = np.insert(self.hashes, to, new), np.insert(self.first, to, first), np.insert(self.size, to, size)
            self.ids, self.again = np.concatenate(ids), np.insert(self.again, to, False)
            at, _ = self._place(different)
        flat, upto = self._ids_at(self.first[at][which], self.size[at][which])
        return flat, upto[w.first]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path].encode


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                 block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """Blocks of documents in ascending id order, null ids first, each document's ids followed by ``end_id``.

    Documents are dealt by ranges of (id, hash of the text), so that even a repeated id is spread, and
    sorted in each shard. A null or empty text has the end id alone. A document is never cut; a block ends
    with the document that fills it. Other columns are not read. An empty table gives no block.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt = dealt.withColumn("_h", F.xxhash64("_text")).repartitionByRange(n, "_id", "_h").sortWithinPartitions("_id", "_h")
    arrow_id = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        ids_of = word_encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        block, first, held, size, names = 0, 0, [], 0, []

        def flush():
            levels = dac_encode(np.frombuffer(b"".join(held), "<u4"))
            lists = [pa.array([[x[k].tobytes() for x in levels]], pa.list_(pa.binary())) for k in range(3)]
            ends = np.cumsum([len(x) // 4 for x in held])
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                pa.array([names], pa.list_(arrow_id)), pa.array([ends.tolist()], pa.list_(pa.int64())), *lists],
                ["shard", "block", "first", "n_tokens", "doc_ids", "ends", "codes", "bitmaps", "ranks"])

        for part in text_slices(batches, "_text"):
            flat, upto = ids_of(column_of(part, "_text"))
            raw, upto = flat.astype("<u4").tobytes(), (upto * 4).tolist()
            for name, a, b in zip(column_of(part, "_id").to_pylist(), upto, upto[1:]):
                held.append(raw[a:b] + end)
                names.append(name)
                size += (b - a) // 4 + 1
                if size >= block_tokens:
                    yield flush()
                    block, first, held, size, names = block + 1, first + size, [], 0, []
        if held:
            yield flush()

    return dealt.mapInArrow(encode, SCHEMA.format(kind=kind))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, **options) -> DataFrame:
    """Write the blocks to ``path``, one part per shard, and return the table read back."""
    blocks = token_blocks(docs, tokenizer, **options)
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(blocks.schema).parquet(path)


def _levels(codes, bitmaps, ranks) -> Levels:
    return [(np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(r, "<u4")) for c, b, r in zip(codes, bitmaps, ranks)]


def stored_documents(stored: DataFrame) -> DataFrame:
    """Per document, decoded from the files: id, start, n_tokens, ids_crc32; in no order.

    ``start`` is the number of ids of all documents before it. Only one total per shard is summed over
    the whole table; the files hold each block's offset in its shard.
    """
    kind = dict(stored.dtypes)["doc_ids"][6:-1]

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]  # one block at a time
                ids = dac_decode(_levels(row["codes"], row["bitmaps"], row["ranks"])).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(starts + row["first"]), pa.array(ends - starts),
                    pa.array([zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())],
                    ["shard", "doc_id", "place", "n_tokens", "ids_crc32"])
        give_back()

    docs = stored.mapInArrow(decode, f"shard int, doc_id {kind}, place long, n_tokens long, ids_crc32 long")
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("shard", before.alias("_before"))  # one row per shard, a number fixed by the writer
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("_before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The token at each ``wanted(doc_id, at)``, read in place from its block; places outside a document are null."""
    docs = stored.select("shard", "block", F.posexplode(F.arrays_zip("doc_ids", F.concat(F.array(F.lit(0).cast("long")), "ends").alias("starts"), "ends")).alias("_k", "d"))
    places = docs.where("d.ends IS NOT NULL").select("shard", "block", F.col("d.doc_ids").alias("doc_id"), F.col("d.starts").alias("_a"), F.col("d.ends").alias("_b"))
    found = wanted.join(places, "doc_id").withColumn("_i", F.when((F.col("at") >= 0) & (F.col("at") < F.col("_b") - F.col("_a")), F.col("_a") + F.col("at")))

    kind = dict(found.dtypes)["doc_id"]

    def access(batches):
        for batch in batches:
            rows = zip(*(column_of(batch, c).to_pylist() for c in ("codes", "bitmaps", "ranks", "_i")))
            token = [None if i is None else dac_access(_levels(c, b, r), i) for c, b, r, i in rows]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "at"), pa.array(token, pa.int64())], ["doc_id", "at", "token"])

    return found.join(stored.select("shard", "block", "codes", "bitmaps", "ranks"), ["shard", "block"]).select("doc_id", "at", "codes", "bitmaps", "ranks", "_i").mapInArrow(
        access, f"doc_id {kind}, at long, token long")
