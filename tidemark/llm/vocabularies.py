"""Vocabulary files of public tokenizers: encoders of whole texts, and the bytes of every entry."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

# The byte order of byte-level vocabularies and the pattern of their pre-tokens.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_MARK = "▁"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocabulary:
    """A byte-level BPE from a ``.json`` or ``.tiktoken`` file; strings of special tokens are plain text.

    Ids come from the merge ranks. A ``.json`` file whose ids do not follow its merges, or that does more than merge bytes, is
    left to its own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = self._ranks(path)
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.emitted = np.ones(size, bool)
        if self.plain:
            import tiktoken

            merger = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
            self.encode = merger.encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids

    def _ranks(self, path: str) -> dict[bytes, int]:
        self.plain = True
        if not path.endswith(".json"):
            with open(path, "rb") as file:
                return {base64.b64decode(t): int(i) for t, i in map(bytes.split, file)}
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        byte_of, model = _byte_of(), told["model"]
        special = {t["content"] for t in told["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        split = told["pre_tokenizer"] or {}
        self.plain = (told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                      and not split.get("add_prefix_space") and not model.get("dropout")
                      and all(vocab["".join(m)] == 256 + i for i, m in enumerate(pairs)))
        return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


class PieceVocabulary:
    """A sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.is_byte = np.array([sp.is_byte(i) for i in ids])
        self.emitted = np.array([not (sp.is_control(i) or sp.is_unknown(i)) for i in ids])
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if self.is_byte[i] else sp.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in ids]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.encode = sp.encode


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


@lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)
