"""Subword ids of whole texts with a public tokenizer, piece by piece from a bounded memo.

A byte-level pre-tokenizer never lets a token cross from a non-space to a
white-space character. So a text is cut there, frequent pieces come from a memo
and the tokenizers library encodes the others; the ids equal those of
the whole text. Tokenizers of another build, and texts that hold the string of
an added token, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

# Unicode white space, as the pre-tokenizer sees it (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# A run of plain letters or digits up to a space or a stop; else all up to a space; else space.
_PIECES = re.compile(
    f" ?[{_LETTERS}0-9]+(?=[.,;:!?{_SPACE}]|$)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_ONE_WORD = re.compile(f" ?[{_LETTERS}]+").fullmatch
_OTHER_SPACE = re.compile(f"[{_SPACE.replace(' ', '')}]").search

MEMO_PIECES = 1 << 18
_MEMO_MAX_LEN = 64
_JOINED_WORDS = 1 << 10


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + k) for k, byte in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """``encode(texts)`` gives for each text its ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self._by_piece = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not spec.get("post_processor")
        )
        added = [token["content"] for token in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self.vocab_size = self._tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._opens = np.zeros(self.vocab_size, bool)
        self._opens[[i for token, i in self._tokenizer.get_vocab().items() if token[:1] == _BYTE_LETTERS[32] and i < self.vocab_size]] = True
        self._model = self._tokenizer.model
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._memo_pieces = memo_pieces

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the memo."""
        memo, old = self._memo, self._old
        others: list[str] = []
        for piece in pieces:
            if piece in old:
                memo[piece] = old[piece]
            elif _ONE_WORD(piece):  # one pre-token: straight to the vocabulary
                tokens = self._model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_LETTERS))
                memo[piece] = self._bytes([token.id for token in tokens])
            else:
                others.append(piece)
        if others:
            for piece, code in zip(others, self._tokenizer.encode_batch(others, add_special_tokens=False)):
                memo[piece] = self._bytes(code.ids)

    def _one(self, text: str) -> bytes:
        if not self._by_piece or (self._added and self._added.search(text)):
            return self._whole(text)
        pieces = _PIECES.findall(text)
        missing = set(pieces).difference(self._memo)
        if missing:
            self._learn(missing)
        ids = b"".join(map(self._memo.__getitem__, pieces))
        for piece in missing:
            if len(piece) > _MEMO_MAX_LEN:
                del self._memo[piece]
        if len(self._memo) > self._memo_pieces:
            self._old, self._memo = self._memo, {}
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(text) for text in texts]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that have no space, each behind one, in a row, and how many each has: those of ``encode``.

        A byte-level pre-tokenizer parts words at the space that begins each, so many are encoded as one text, and an
        id that begins with a space begins a word.
        """
        ids, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for start in range(0, len(words), _JOINED_WORDS):
            some = [" " + word for word in words[start : start + _JOINED_WORDS]]
            text = "".join(some)
            if self._by_piece and not _OTHER_SPACE(text) and not (self._added and self._added.search(text)):
                found = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                first = np.flatnonzero(self._opens[found])
                if len(first) == len(some):
                    ids.append(found)
                    lengths.append(np.diff(first, append=len(found)))
                    continue
            codes = self.encode(some)
            ids.append(np.frombuffer(b"".join(codes), self.dtype))
            lengths.append(np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize)
        return np.concatenate(ids), np.concatenate(lengths)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return Encoder(path)
